"""A word n-gram model in Elias-Fano tries of two or three levels, built and queried in parallel over shards.

Level 1 is the vocabulary: words in the order of their 64-bit hashes with exact counts, and two bytes for the quantised
probability of each; a word's id is its place.
Level 2 holds, in each shard, contexts in order (Elias-Fano), monotone pointers to their successors (Elias-Fano), and the
successor ids made monotone by adding the context's place times the vocabulary size (Elias-Fano), with two bytes for the
quantised smoothed probability of each and two for each context's weight of the lower model. A query finds its context and
searches its successor relative to the context. Level 3 holds, beside its shard's level 2, pointers from each bigram to its
successors (Elias-Fano), the successor ids relative to the bigram's place (Elias-Fano), and the same two bytes of each. Levels
are files in the shared folder that workers map into memory; a file that is missing is an error.

Probabilities are smoothed by absolute discounting, the discount estimated from the bigrams that occur once and twice:
P(w | v) = max(c(v, w) - D, 0) / c(v) + D * n(v) / c(v) * P1(w), and P1 the unigram model with half a count for every
word and one unknown; P(w | u, v) likewise from the trigrams, their own discount and P(w | v). A text's first token has the
end token before it, its second that and the first. All logarithms are stored in steps of 1 / STEPS.

A context with a large share of all tokens is dealt over all shards by its successors; a bigram's successors lie in its own
shard. Level 2 of every shard is bounded by tokens / shards, level 3 by that and its most frequent bigram, and the number of shards grows with the corpus. The vocabulary may have 2^32 words.

Defined results: a null text counts as empty: one end token; words unknown to the training texts count as the unknown
word; repeated rows are scored each by itself and train each by itself; without training texts all words are unknown;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grown, materialize, shared_dir, shrunk, worker_cache

END = b""
#: Bytes of text for each shard; shards are a power of two.
SHARD_BYTES = 12 << 20
MIN_SHARDS = 16
#: A context is dealt over all shards if it has more than 1 / HOT of a shard's mean tokens.
HOT = 4
MAX_KEPT = 400_000
BLOCK_BYTES = 4 << 20
#: Steps of a stored logarithm (base 10) in one; 16 bits reach to 10 ** -16.
STEPS = 4096
MAX_WORDS = 1 << 32
#: Trigrams that are smoothed at a time.
PART = 1 << 19


# ---- Elias-Fano ----------------------------------------------------------------------------------------------------


def ef_encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A monotone sequence below ``universe``: low bits packed, high bits in unary, zeros counted by blocks of 512 bits."""
    n = len(values)
    low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + (max(1, universe) >> low) + 2
    bits = np.zeros(-(-size // 512) * 512, np.uint8)
    bits[high + np.arange(n)] = 1
    blocks = bits.reshape(-1, 512)
    ones = np.concatenate([[0], np.cumsum(blocks.sum(axis=1, dtype=np.int64))])
    lows = []
    for i in range(0, n if low else 0, 1 << 14):  # a multiple of 8, so each part ends with a byte
        part = values[i : i + (1 << 14), None] >> np.arange(low, dtype=np.uint64)
        lows.append(np.packbits((part & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
    return {"meta": np.array([n, low, universe], np.int64), "high": np.packbits(bits, bitorder="little"), "ones": ones, "low": np.concatenate([*lows, np.zeros(16, np.uint8)])}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits, self.universe = map(int, parts["meta"])
        self.high, self.ones = parts["high"], parts["ones"]
        self.words = self.high.view("<u8").reshape(-1, 8)
        self.lows = parts["low"][: len(parts["low"]) // 8 * 8].view("<u8")
        self.zeros = np.arange(len(self.ones)) * 512 - self.ones

    def _run_end(self, start: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the first zero from ``start``, which is the ``high``-th; most stand within the next 57 bits."""
        at = np.minimum((start >> 3)[:, None] + np.arange(8), len(self.high) - 1)
        zeros = ~self.high[at].view("<u8")[:, 0] >> (start & 7).astype(np.uint64)
        out = start + np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(zeros == 0)
        if len(far):
            out[far] = self._select(high[far], False)
        return out

    def _select(self, k: np.ndarray, of_ones: bool) -> np.ndarray:
        """Bit places of the k-th (from 0) ones or zeros."""
        before = self.ones if of_ones else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        rest = k - before[block]
        words = self.words[block]
        if not of_ones:
            words = ~words
        counts = np.bitwise_count(words).astype(np.int64)
        sums = np.cumsum(counts, axis=1)
        at = (sums <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        rest = rest - (sums[rows, at] - counts[rows, at])
        word = words[rows, at]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            up = rest >= part
            rest = np.where(up, rest - part, rest)
            word = np.where(up, word >> np.uint64(width), word)
            place += np.where(up, width, 0)
        return block * 512 + at * 64 + place

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        over = self.lows[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1)))
        return (self.lows[word] >> shift | np.where(shift > 0, over, np.uint64(0))) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return ((high << np.uint64(self.bits)) | self.low_of(i)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values, -1 where absent: binary search for the low part in the run of ones of the high part."""
        high = values >> self.bits
        low = (values & ((1 << self.bits) - 1)).astype(np.uint64)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        first, last = start - high, self._run_end(start, high) - high  # elements with this high part
        at, stop = first.copy(), last.copy()
        left = np.flatnonzero(at < stop)
        while len(left):
            middle = (at[left] + stop[left]) >> 1
            below = self.low_of(middle) < low[left]
            at[left[below]] = middle[below] + 1
            stop[left[~below]] = middle[~below]
            left = left[at[left] < stop[left]]
        inside = np.flatnonzero(at < last)
        out = np.full(len(values), -1, np.int64)
        hit = inside[self.low_of(at[inside]) == low[inside]]
        out[hit] = at[hit]
        return out


# ---- files in the shared folder ------------------------------------------------------------------------------------


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, moved into place when whole; a task that runs again writes the same."""
    system, path = fs.FileSystem.from_uri(uri)
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    system.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-(8 + len(head)) % 64))
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 64))
    system.move(attempt, path)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """Arrays mapped from the file; one in a remote store is mapped from a copy without a name, which ends with the mapping."""
    system, path = fs.FileSystem.from_uri(uri)
    if not isinstance(system, fs.LocalFileSystem):
        local = tempfile.NamedTemporaryFile(delete=False)
        with system.open_input_stream(path) as f, local:
            while chunk := f.read(1 << 24):
                local.write(chunk)
        path = local.name
        whole = np.memmap(path, np.uint8, "r")
        os.unlink(path)
    else:
        whole = np.memmap(path, np.uint8, "r")
    size = int(whole[:8].view("<u8")[0])
    at, out = -(-(8 + size) // 64) * 64, {}
    for part in whole[8 : 8 + size].tobytes().decode().split(";"):
        name, kind, n = part.split(",")
        width = int(n) * np.dtype(kind).itemsize
        out[name] = np.asarray(whole[at : at + width]).view(kind)
        at += -(-width // 64) * 64
    return out


def write_shrunk(uri: str, arrays: dict[str, np.ndarray]) -> None:
    write_arrays(uri, {k: np.frombuffer(shrunk(v), np.uint8) for k, v in arrays.items()})


def read_shrunk(uri: str) -> dict[str, np.ndarray]:
    return {k: grown(v.tobytes()) for k, v in read_arrays(uri).items()}


# ---- counts --------------------------------------------------------------------------------------------------------


def blocks_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        texts, start, size = b.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                yield b.slice(start, i + 1 - start), [x.lower() for x in texts[start : i + 1]]
                start, size = i + 1, 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes], numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all tokens, each text's end token included, and the tokens of each text."""
    split = [[*t.split(), END] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes


def packed(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray, longer: tuple[np.ndarray, ...] = ()) -> pa.RecordBatch:
    """A row for each shard with its keys (as steps) and counts, which are ordered by shard and key; ``longer``: how many successors each key has, the
    successors in the keys' order and their counts."""
    at = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(shards))
    steps = keys.astype("<u8")
    steps[1:] -= keys[:-1]
    steps[at] = keys[at]
    columns, names = [(steps, at, ends), (counts.astype("<u4"), at, ends)], ["keys", "counts"]
    if longer:
        before = np.concatenate([[0], np.cumsum(longer[0])])
        columns += [(longer[0].astype("<u4"), at, ends), *((x.astype("<u4"), before[at], before[ends]) for x in longer[1:])]
        names += ["widths", "words", "word_counts"]
    made = [pa.array([shrunk(x[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()) for x, first, last in columns]
    return pa.RecordBatch.from_arrays([pa.array(shards[at].astype(np.int32), pa.int32()), *made], names=["shard", *names])


def keys_of(steps: bytes) -> np.ndarray:
    return np.cumsum(grown(steps), dtype=np.uint64)


def gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [keys_of(x) for x in group.column("keys").to_pylist()]
    counts = [grown(x).astype(np.int64) for x in group.column("counts").to_pylist()]
    return summed(np.concatenate(keys), np.concatenate(counts))


def successors_of(group: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (place of the key, successor), the place in the upper 32 bits, and their counts."""
    of, counts = [], []
    for mine, widths, w, n in zip(*(group.column(c).to_pylist() for c in ("keys", "widths", "words", "word_counts")), strict=True):
        of.append(np.repeat(np.searchsorted(keys, keys_of(mine)).astype(np.uint64) << np.uint64(32), grown(widths)) | grown(w))
        counts.append(grown(n).astype(np.int64))
    return summed(np.concatenate(of), np.concatenate(counts))


# ---- the model -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    starts: tuple[int, ...]  # ids of each vocabulary shard's first word
    tokens: int
    words: int
    discount: float = 0.75
    #: Successors of the contexts that are dealt over all shards.
    hot: dict[int, int] = field(default_factory=dict)
    #: Levels, 2 or 3, and the discount of the third.
    order: int = 2
    discount3: float = 0.75

    def __hash__(self) -> int:
        return hash((self.folder, self.discount, self.discount3))

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words of these counts by the unigram model."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    @property
    def hot_from(self) -> float:
        return max(64.0, self.tokens / self.shards / HOT)


class Vocabulary:
    def __init__(self, model: Model):
        self.model = model
        self.shift = 64 - (model.shards.bit_length() - 1)
        self.files: dict[int, dict[str, np.ndarray]] = {}
        self.singles: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def single_codes(self, ids: np.ndarray) -> np.ndarray:
        """Stored codes of the probabilities of words alone; an unknown word's (the vocabulary's size) is worked out."""
        out = np.full(len(ids), code_of(self.model.single(np.zeros(1)))[0], np.int64)
        shards = np.searchsorted(self.model.starts, ids, side="right") - 1
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(self.model.shards + 1))
        for s in np.unique(shards).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            mine = mine[ids[mine] < self.model.words]
            if len(mine):
                if s not in self.singles:
                    self.singles[s] = read_arrays(f"{self.model.folder}/single-{s}")["codes"]
                out[mine] = self.singles[s][ids[mine] - self.model.starts[s]]
        return out

    def shard(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.files:
            self.files[i] = read_arrays(f"{self.model.folder}/words-{i}")
        return self.files[i]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (the vocabulary's size for unknown words) and counts of hashes."""
        ids, counts = np.full(len(hashes), self.model.words, np.int64), np.zeros(len(hashes), np.int64)
        shards = (hashes >> np.uint64(self.shift)).astype(np.int64)
        order = np.argsort(shards, kind="stable")
        cuts = np.searchsorted(shards[order], np.arange(self.model.shards + 1))
        for s in np.unique(shards):
            mine = order[cuts[s] : cuts[s + 1]]
            part = self.shard(int(s))
            words = part["hashes"]
            if not len(words):
                continue
            at = np.minimum(np.searchsorted(words, hashes[mine]), len(words) - 1)
            hit = words[at] == hashes[mine]
            ids[mine[hit]] = at[hit] + self.model.starts[s]
            counts[mine[hit]] = part["counts"][at[hit]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids in order."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, [*self.model.starts, self.model.words])
        for s in range(self.model.shards):
            if cuts[s] < cuts[s + 1]:
                out[cuts[s] : cuts[s + 1]] = self.shard(s)["counts"][ids[cuts[s] : cuts[s + 1]] - self.model.starts[s]]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, sizes) of all tokens of the texts."""
        if len(self.numbers) > MAX_KEPT:
            self.forget()
        at, sizes = numbered(texts, self.numbers)
        new = list(islice(self.numbers, len(self.ids), None))
        if new:
            ids, counts = self.look_up(np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return self.ids[at], self.counts[at], sizes


def vocabulary(model: Model) -> Vocabulary:
    kept = worker_cache("ngram_trie")
    if ("words", model.folder) not in kept:
        kept.clear()
        kept["words", model.folder] = Vocabulary(model)
    return kept["words", model.folder]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def pair_shards(context: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By the context; by both for a hot context."""
    key = spread(context)
    key = np.where(hot, spread(key ^ word.astype(np.uint64)), key)
    return ((key >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


def pairs_of(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context ids, context counts, has a context) of all tokens; a text's first token has the end token before it."""
    first = np.cumsum(sizes) - sizes
    last = first + sizes - 1
    context, total = np.roll(ids, 1), np.roll(counts, 1)
    context[first], total[first] = ids[last], counts[last]
    return context, total, (context < model.words) & (total > 0)


def code_of(p: np.ndarray) -> np.ndarray:
    """Two bytes for each probability: its logarithm in steps."""
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-30)) * STEPS), 65535).astype("<u2")


def log_of(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEPS


def estimated_discount(once: int, twice: int) -> float:
    return min(0.98, max(0.1, once / (once + 2 * twice))) if once else 0.75


def train(docs: DataFrame, *, text_col: str = "text", total_bytes: int | None = None, order: int = 2) -> Model:
    """Count and write the levels for all texts of ``docs``; ``order``: 2 for bigrams, 3 for trigrams too."""
    if order not in (2, 3):
        raise ValueError(f"a model of order {order}: 2 or 3 levels are built")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if total_bytes is None:
        total_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = MIN_SHARDS
    while shards * SHARD_BYTES < total_bytes:
        shards *= 2
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    shift = 64 - (shards.bit_length() - 1)
    shape = "shard int, keys binary, counts binary"

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = Numbers(), np.zeros(0, np.int64)

        def found() -> pa.RecordBatch:
            keys, summed_counts = summed(np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers)), counts)
            return packed((keys >> np.uint64(shift)).astype(np.int64), keys, summed_counts)

        for _, part in blocks_of(batches, 0):
            more = np.bincount(numbered(part, numbers)[0], minlength=len(numbers))
            more[: len(counts)] += counts
            counts = more
            if len(numbers) > MAX_KEPT:
                yield found()
                numbers, counts = Numbers(), np.zeros(0, np.int64)
        if numbers:
            yield found()

    def write_words(key: tuple, group: pa.Table) -> pa.Table:
        keys, counts = gathered(group)
        write_arrays(f"{folder}/words-{key[0].as_py()}", {"hashes": keys, "counts": counts})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    written = materialize(texts.mapInArrow(unigrams, shape).groupBy("shard").applyInArrow(write_words, "shard int, words long, tokens long"), "words").collect()  # a row for each shard
    sizes = {r["shard"]: r["words"] for r in written}
    for s in set(range(shards)) - sizes.keys():
        write_arrays(f"{folder}/words-{s}", {"hashes": np.zeros(0, np.uint64), "counts": np.zeros(0, np.int64)})
    starts, at = [], 0
    for s in range(shards):
        starts.append(at)
        at += sizes.get(s, 0)
    if at >= MAX_WORDS:
        raise ValueError(f"{at} different words: a word's id has 32 bits")
    model = Model(folder, shards, tuple(starts), sum(r["tokens"] for r in written), at, order=order)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for _, part in blocks_of(batches, 0):
            ids, counts, sizes = vocab.encode(part)
            context, total, _ = pairs_of(ids, counts, sizes, model)
            keys = (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
            found, at, back, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            to = pair_shards(context[at], ids[at], total[at] > model.hot_from, shards)
            by_shard = np.argsort(to, kind="stable")
            longer = ()
            if order > 2:
                place = np.empty(len(found), np.int64)
                place[by_shard] = np.arange(len(found))
                later = np.ones(len(ids), bool)
                later[np.cumsum(sizes) - sizes] = False
                later = np.flatnonzero(later)
                triples, m = np.unique((place[back[later - 1]].astype(np.uint64) << np.uint64(32)) | ids[later].astype(np.uint64), return_counts=True)
                longer = np.bincount((triples >> np.uint64(32)).astype(np.int64), minlength=len(found)), triples & np.uint64(0xFFFFFFFF), m
            yield packed(to[by_shard], found[by_shard], n[by_shard], longer)

    def write_pairs(key: tuple, group: pa.Table) -> pa.Table:
        keys, counts = gathered(group)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        contexts, first = np.unique(context, return_index=True)
        pointers = np.append(first, len(keys))
        totals = vocabulary(model).counts_of(contexts)
        narrow = counts.astype("<u4") if not len(counts) or counts.max() < MAX_WORDS else counts
        write_shrunk(f"{folder}/counts-{key[0].as_py()}", {"contexts": contexts.astype("<u4"), "totals": totals, "pointers": pointers, "words": word.astype("<u4"), "counts": narrow})
        longer, more = successors_of(group, keys) if order > 2 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if order > 2:
            widths = np.bincount((longer >> np.uint64(32)).astype(np.int64), minlength=len(keys))
            write_shrunk(f"{folder}/longer-{key[0].as_py()}", {"widths": widths.astype("<u4"), "words": (longer & np.uint64(0xFFFFFFFF)).astype("<u4"), "counts": more.astype("<u4") if not len(more) or more.max() < MAX_WORDS else more})
        # Contexts that other shards share: as many at most as can pass hot_from.
        shared = np.flatnonzero(totals > model.hot_from)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()),
            "once": pa.array([int((counts == 1).sum())], pa.int64()), "twice": pa.array([int((counts == 2).sum())], pa.int64()),
            "once3": pa.array([int((more == 1).sum())], pa.int64()), "twice3": pa.array([int((more == 2).sum())], pa.int64()),
            "hot": pa.array([contexts[shared].tolist()], pa.list_(pa.int64())), "successors": pa.array([np.diff(pointers)[shared].tolist()], pa.list_(pa.int64())),
        })

    gram_shape = shape + (", widths binary, words binary, word_counts binary" if order > 2 else "")
    stat_shape = "shard int, once long, twice long, once3 long, twice3 long, hot array<bigint>, successors array<bigint>"
    stats = materialize(texts.mapInArrow(grams, gram_shape).groupBy("shard").applyInArrow(write_pairs, stat_shape), "pairs").collect()  # a row for each shard
    hot: dict[int, int] = {}
    for r in stats:
        for c, n in zip(r["hot"], r["successors"], strict=True):
            hot[c] = hot.get(c, 0) + n
    once, twice, once3, twice3 = (sum(r[name] for r in stats) for name in ("once", "twice", "once3", "twice3"))
    model = Model(folder, shards, tuple(starts), model.tokens, model.words, estimated_discount(once, twice), hot, order, estimated_discount(once3, twice3))
    counted = {r["shard"] for r in stats}

    def each_shard(write: Callable[[int], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column(0).to_pylist():
                    write(shard)
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["id"])

        return run

    def smooth(shard: int) -> None:
        found = read_shrunk(f"{folder}/counts-{shard}") if shard in counted else {n: np.zeros(int(n == "pointers"), np.int64) for n in ("contexts", "totals", "pointers", "words", "counts")}
        write_arrays(f"{folder}/pairs-{shard}", smoothed(found, model))
        write_arrays(f"{folder}/single-{shard}", {"codes": code_of(model.single(vocabulary(model).shard(shard)["counts"]))})

    def smooth_longer(shard: int) -> None:
        if shard in counted:
            write_arrays(f"{folder}/triples-{shard}", smoothed_longer(read_shrunk(f"{folder}/counts-{shard}"), read_shrunk(f"{folder}/longer-{shard}"), model))

    # The third level is smoothed by the second of all shards, so that has to be whole before.
    for write in (smooth, smooth_longer)[: order - 1]:
        materialize(spark.range(0, shards, 1, min(shards, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(each_shard(write), "id long"), "smoothed")
    return model


def smoothed(found: dict[str, np.ndarray], model: Model) -> dict[str, np.ndarray]:
    """The second level of a shard from its counts."""
    contexts, pointers, totals, words = found["contexts"].astype(np.int64), found["pointers"], found["totals"], found["words"].astype(np.int64)
    distinct, back = np.unique(words, return_inverse=True)
    word_counts = vocabulary(model).counts_of(distinct)[back]
    width = np.diff(pointers)
    successors = np.array([model.hot.get(c, n) for c, n in zip(contexts.tolist(), width.tolist(), strict=True)], np.int64)
    weight = np.minimum(model.discount * successors / np.maximum(totals, 1), 1.0)
    rank = np.repeat(np.arange(len(contexts)), width)
    p = np.maximum(found["counts"] - model.discount, 0) / np.maximum(totals, 1)[rank] + weight[rank] * model.single(word_counts)
    arrays = {"codes": code_of(p), "weights": code_of(weight)}
    for name, part in (("context", ef_encode(contexts, model.words + 1)), ("pointer", ef_encode(pointers, len(rank) + 1)), ("next", ef_encode(rank * model.words + words, len(contexts) * model.words + 1))):
        arrays |= {f"{name}.{k}": v for k, v in part.items()}
    return arrays


def smoothed_longer(pairs: dict[str, np.ndarray], longer: dict[str, np.ndarray], model: Model) -> dict[str, np.ndarray]:
    """The third level of a shard from its counts and the second level of all shards."""
    width, counts, words = longer["widths"].astype(np.int64), longer["counts"], longer["words"]
    ends = np.cumsum(width)
    totals = np.bincount(np.repeat(np.arange(len(width)), width), weights=counts, minlength=len(width))
    weight = np.where(width > 0, np.minimum(model.discount3 * width / np.maximum(totals, 1), 1.0), 1.0)
    codes = np.zeros(len(words), "<u2")
    for a in range(0, len(words), PART):
        here = slice(a, min(a + PART, len(words)))
        rank = np.searchsorted(ends, np.arange(here.start, here.stop), side="right")
        asked, back = np.unique((pairs["words"][rank].astype(np.uint64) << np.uint64(32)) | words[here], return_inverse=True)
        v, w = (asked >> np.uint64(32)).astype(np.int64), (asked & np.uint64(0xFFFFFFFF)).astype(np.int64)
        contexts, of = np.unique(v, return_inverse=True)
        lower = 10 ** scorer(model).pairs(v, w, vocabulary(model).counts_of(contexts)[of], log_of(vocabulary(model).single_codes(w)))[0]
        codes[here] = code_of(np.maximum(counts[here] - model.discount3, 0) / totals[rank] + weight[rank] * lower[back])
    values = np.repeat(np.arange(len(width)) * model.words, width) + words
    arrays = {"codes": codes, "weights": code_of(weight)}
    for name, part in (("pointer", ef_encode(np.concatenate([[0], ends]), len(words) + 1)), ("next", ef_encode(values, len(width) * model.words + 1))):
        arrays |= {f"{name}.{k}": v for k, v in part.items()}
    return arrays


def sequences(parts: dict[str, np.ndarray], *names: str) -> Iterator[EliasFano]:
    return (EliasFano({k.partition(".")[2]: v for k, v in parts.items() if k.startswith(name + ".")}) for name in names)


class TripleLevels:
    """The third level of one shard."""

    def __init__(self, parts: dict[str, np.ndarray], words: int):
        self.codes, self.weights, self.words = parts["codes"], parts["weights"], words
        self.pointer, self.next = sequences(parts, "pointer", "next")

    def successors(self, place: int) -> np.ndarray:
        """All successors of the bigram at a place of the second level."""
        a, b = self.pointer.get(np.array([place, place + 1]))
        return self.next.get(np.arange(a, b)) - place * self.words

    def query(self, place: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word behind the bigram at a place, ``lower`` being that behind its second word."""
        out = lower + log_of(self.weights[place])
        ask = np.flatnonzero(word < self.words)
        found = self.next.find(place[ask] * self.words + word[ask])
        hit = found >= 0
        out[ask[hit]] = log_of(self.codes[found[hit]])
        return out


class PairLevels:
    """The second level of one shard."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.codes, self.weights = parts["codes"], parts["weights"]
        self.context, self.pointer, self.next = sequences(parts, "context", "pointer", "next")

    def successors(self, context: int) -> np.ndarray:
        """All successors of a context, by its two pointers."""
        rank = self.context.find(np.array([context]))[0]
        if rank < 0:
            return np.zeros(0, np.int64)
        a, b = self.pointer.get(np.array([rank, rank + 1]))
        return self.next.get(np.arange(a, b)) % max(1, self.next.universe // max(1, self.context.n))

    def query(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each word behind its context, ``lower`` being that of the word alone, and the bigram's place (-1 where absent)."""
        out, places = lower.copy(), np.full(len(word), -1, np.int64)
        if not self.context.n:
            return out, places
        first = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        rank = self.context.find(context[first])[np.cumsum(first) - 1]
        there = np.flatnonzero(rank >= 0)
        out[there] += log_of(self.weights[rank[there]])
        ask = there[word[there] < words]
        if len(ask):
            found = self.next.find(rank[ask] * words + word[ask])
            hit = found >= 0
            out[ask[hit]] = log_of(self.codes[found[hit]])
            places[ask] = found
        return out, places


class Scorer:
    def __init__(self, model: Model):
        self.model, self.levels, self.thirds = model, {}, {}

    def level(self, i: int) -> PairLevels:
        if i not in self.levels:
            self.levels[i] = PairLevels(read_arrays(f"{self.model.folder}/pairs-{i}"))
        return self.levels[i]

    def third(self, i: int) -> TripleLevels:
        if i not in self.thirds:
            self.thirds[i] = TripleLevels(read_arrays(f"{self.model.folder}/triples-{i}"), self.model.words)
        return self.thirds[i]

    def pairs(self, c: np.ndarray, w: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probabilities of words ``w`` behind the contexts ``c`` of counts ``n``, all in order; the bigrams' shards and places there."""
        m = self.model
        hot = n > m.hot_from
        to = pair_shards(c, w, hot, m.shards)
        found, places = np.zeros(len(c)), np.full(len(c), -1, np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(m.shards + 1))
        for s in np.unique(to).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            found[mine], places[mine] = self.level(s).query(c[mine], w[mine], lower[mine], m.words)
        # A hot context's weight is the same in every shard; one of which it has no successor cannot tell it.
        if hot.any():
            unseen = hot & (found == lower)
            found[unseen] += [-np.rint(-np.log10(min(m.discount * m.hot[x] / t, 1.0)) * STEPS) / STEPS if x in m.hot else 0.0 for x, t in zip(c[unseen].tolist(), n[unseen].tolist(), strict=True)]
        return found, to, places

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        ids, counts, sizes = vocabulary(m).encode(texts)
        low = np.log10(m.single(counts))
        distinct, back = np.unique(ids, return_inverse=True)
        high = log_of(vocabulary(m).single_codes(distinct))[back]
        context, total, has = pairs_of(ids, counts, sizes, m)
        keys = (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        asked, at, back = np.unique(keys[has], return_index=True, return_inverse=True)
        found, to, places = self.pairs(context[has][at], ids[has][at], total[has][at], high[has][at])
        high[has] = found[back]
        if m.order > 2:
            pair = np.full(len(ids), -1, np.int64)
            pair[has] = np.where(places >= 0, np.arange(len(asked)), -1)[back]
            before = np.roll(pair, 1)
            before[np.cumsum(sizes) - sizes] = -1
            held = np.flatnonzero(before >= 0)
            triples, at, back = np.unique((before[held].astype(np.uint64) << np.uint64(32)) | ids[held].astype(np.uint64), return_index=True, return_inverse=True)
            of, word, lower = before[held][at], ids[held][at], high[held][at]
            found, shards = np.zeros(len(triples)), to[of]
            order = np.argsort(shards, kind="stable")
            cuts = np.searchsorted(shards[order], np.arange(m.shards + 1))
            for s in np.unique(shards).tolist():
                mine = order[cuts[s] : cuts[s + 1]]
                found[mine] = self.third(s).query(places[of[mine]], word[mine], lower[mine])
            high[held] = found[back]
        first = np.cumsum(sizes) - sizes
        total_of = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return sizes, total_of((counts > 0).astype(np.int64)), total_of(low), total_of(high)


def scorer(model: Model) -> Scorer:
    vocabulary(model)  # begins a new cache for a new model
    kept = worker_cache("ngram_trie")
    if ("levels", model.folder) not in kept:
        kept["levels", model.folder] = Scorer(model)
    return kept["levels", model.folder]


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score); scores are log10 probabilities of whole texts."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for b, texts in blocks_of(batches, 1):
            n, known, low, high = s.score(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return base.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all documents by the model of those for which ``training`` holds."""
    return score_documents(docs, train(docs.filter(training), text_col=text_col, order=order), id_col=id_col, text_col=text_col)
