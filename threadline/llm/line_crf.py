"""Quality rules: a linear-chain conditional random field marks each line of a text as content or boilerplate.

A text's lines are a sequence; each line has binary features (its length, symbols, case, repetition, place), and
Viterbi decoding finds the likeliest labelling as a whole, so a doubtful line follows its neighbours. A text is kept
if the words of its content lines are at least MIN_SHARE of all its words and the base rules do not fail it.

The field is trained here, by maximum conditional likelihood with forward-backward recursions, on all lines of labelled
documents that inherit their document's quality: MAX_FIT documents of each class at most. Long documents are cut into
runs of FIT_RUN lines, which share their document's weight. Without labels of both classes every line counts as content.

Defined results: a null or blank text has no words, fails the base rules and is not kept; repeated rows are judged
each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Largest share of words in repeated windows, in hundredths.
MAX_REPEATED = 50
WINDOW = 3
MIN_SHARE = 0.5
#: Bound of the training sample: documents of each class. Lines of a run in training.
MAX_FIT, FIT_RUN = 1000, 40
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
BOILERPLATE, CONTENT = 0, 1
NOTICE_WORDS = ("licen", "copyright", "rights reserved", "cookie", "subscribe", "login", "javascript", "click here", "©")
FEATURES = ("bias", "blank", "words 1-2", "words 3-5", "words 6-12", "words 13+", "ends a sentence", "symbols a few", "symbols many", "bars", "capitals many", "exclamations", "seen before", "repeats words", "repeats words much", "digits many", "notice", "long words", "first", "last", "mean word short")


def line_bits(line: str, before: bool, first: bool, last: bool) -> int:
    """The features of a line as bits, in the order of FEATURES."""
    words = line.split()
    n = len(words)
    if not n:
        return 0b11 | first << 18 | last << 19
    symbols = sum(map(line.count, SYMBOLS))
    letters = len(line) - line.count(" ")
    distinct = len(set(words))
    low = line.lower() if n < 40 else ""
    on = (
        True, False, n <= 2, 3 <= n <= 5, 6 <= n <= 12, n >= 13, words[-1][-1] in ".!?:;”\"»", symbols * 10 >= n, symbols * 3 >= n, line.count("|") * 8 >= n,
        n >= 2 and sum(map(str.isupper, words)) * 2 >= n, line.count("!!") * 5 >= n, before, n >= 4 and distinct * 4 < n * 3, n >= 4 and distinct * 10 < n * 4,
        sum(map(line.count, "0123456789")) * 5 >= letters, any(x in low for x in NOTICE_WORDS), letters >= 14 * n, first, last, letters <= 3 * n,
    )
    return sum(1 << i for i, x in enumerate(on) if x)


def text_bits(lines: list[str]) -> list[int]:
    seen: set[str] = set()
    out = []
    for i, line in enumerate(lines):
        out.append(line_bits(line, line in seen, i == 0, i == len(lines) - 1))
        seen.add(line)
    return out


def as_matrix(bits: list[int] | np.ndarray) -> np.ndarray:
    return (np.asarray(bits, np.int64)[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


@dataclass(frozen=True)
class Field:
    """emit: weight of each feature for content (boilerplate has 0); move: 2 x 2 scores from label to label."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels of lines whose content scores are given."""
        (bb, bc), (cb, cc) = self.move.tolist()
        b, c, back = 0.0, 0.0, []
        for i, s in enumerate(scores.tolist()):
            if i == 0:
                b, c = 0.0, s
                continue
            from_b, from_c = b + bc >= c + cc, b + bb >= c + cb
            back.append((BOILERPLATE if from_c else CONTENT, BOILERPLATE if from_b else CONTENT))
            b, c = max(b + bb, c + cb), max(b + bc, c + cc) + s
        labels = np.empty(len(scores), np.int8)
        at = CONTENT if c >= b else BOILERPLATE
        for i in range(len(scores) - 1, -1, -1):
            labels[i] = at
            if i:
                at = back[i - 1][at]
        return labels


def all_content() -> Field:
    emit = np.zeros(len(FEATURES))
    emit[0] = 1.0
    return Field(emit, np.zeros((2, 2)))


def fit(documents: list[list[int]], labels: list[int]) -> Field:
    """Maximum conditional likelihood by gradient ascent (Adagrad) with a ridge; all runs of lines at once, padded.

    Every document of a class counts the same, whatever its lines.
    """
    cut = [(d[i : i + FIT_RUN], y, len(d)) for d, y in zip(documents, labels, strict=True) for i in range(0, len(d), FIT_RUN)]
    sequences, y, of_lines = [s for s, _, _ in cut], np.array([y for _, y, _ in cut]), np.array([n for _, _, n in cut])
    n, longest, k = len(sequences), max(map(len, sequences)), len(FEATURES)
    x, mask = np.zeros((n, longest, k)), np.zeros((n, longest), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = as_matrix(s), True
    lengths = mask.sum(1)
    weight = np.where(y == 1, 0.5 / max(1, labels.count(1)), 0.5 / max(1, labels.count(0)))
    emit, move, g2e, g2m = np.zeros(k), np.zeros((2, 2)), np.full(k, 1e-8), np.full((2, 2), 1e-8)
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for _ in range(STEPS):
        score = np.zeros((n, longest, 2))
        score[:, :, CONTENT] = x @ emit
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], lse(ahead[:, t - 1, :, None] + move, 1) + score[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], lse(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
        total = lse(ahead[:, -1], 1)
        share = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        per_line = weight / of_lines
        ge = np.einsum("n,nt,ntk->k", per_line, (y[:, None] - share[:, :, CONTENT]) * mask, x) - RIDGE * emit
        gm = -RIDGE * move
        for t in range(1, longest):
            pair = np.exp(ahead[:, t - 1, :, None] + move + (score[:, t] + behind[:, t])[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
            gm = gm - np.einsum("n,nab->ab", per_line, pair)
        gm[0, 0] += (per_line * (lengths - 1))[y == 0].sum()
        gm[1, 1] += (per_line * (lengths - 1))[y == 1].sum()
        g2e += ge**2
        g2m += gm**2
        emit, move = emit + RATE * ge / np.sqrt(g2e), move + RATE * gm / np.sqrt(g2m)
    return Field(emit, move)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit the field on a bounded sample of labelled documents, chosen by a hash of their ids."""
    keyed = labels.select(F.col(id_col).alias("fit_id"), F.col(label_col).cast("int").alias("fit_label")).filter("fit_id is not null and fit_label in (0, 1)")
    chosen = [keyed.filter(F.col("fit_label") == y).orderBy(F.xxhash64("fit_id"), "fit_id").limit(MAX_FIT) for y in (0, 1)]
    wanted = F.broadcast(chosen[0].union(chosen[1]))  # MAX_FIT rows of each class at most
    texts = docs.select(F.col(id_col).alias("fit_id"), F.col(text_col).alias("text")).filter("text <> ''")
    texts = texts.join(wanted, "fit_id").select("fit_label", "text")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_bits(t.as_py().split("\n")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fit_label", "bits"])

    rows = map_texts(texts, bits, "fit_label int, bits array<bigint>").collect()
    if len({r["fit_label"] for r in rows}) < 2:
        return all_content()
    rows.sort(key=lambda r: (r["fit_label"], r["bits"]))
    return fit([r["bits"] for r in rows], [r["fit_label"] for r in rows])


def repeated_words(words: list[str]) -> int:
    """Words in windows of WINDOW words that the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = np.zeros(len(words), bool)
    starts = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    for i in range(WINDOW):
        covered[i : i + len(windows)] |= starts
    return int(covered.sum())


def judge(text: str | None, field: Field) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes are split at exactly the six characters of SPACES
    n = len(words)
    lines = text.split("\n")
    counts = Counter(lines)
    dup = sum(c - 1 for line, c in counts.items() if c > 1 and line.strip(SPACES)) if len(counts) < len(lines) else 0
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED * n
    labels = field.decode(as_matrix(text_bits(lines)) @ field.emit)
    sizes = np.fromiter((len(line.encode("utf-8", "replace").split()) for line in lines), np.int64, len(lines))
    share = float((sizes * labels).sum() / n) if n else 0.0
    marks = "".join("BC"[x] for x in labels.tolist())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, failed, not failed and share >= MIN_SHARE, share, marks


def judge_documents(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, line_labels)."""
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = base.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"]
    types = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(judge(t.as_py(), field) for t in b.column(1)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(r, t) for r, t in zip(rows, types, strict=True)]], names=[id_col, *names])

    shown = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_labels string"
    return map_texts(base, run, f"`{id_col}` {kind}, {shown}")


def keep_good(docs: DataFrame, field: Field, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are not kept; all columns stay, and nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py(), field)[6] for t in b.column(at)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
