"""BPE encoding by traversal of a trie of distinct words.

Byte pair encoding gives every prefix of a word one encoding, and that encoding ends in one token: the last-token
state of the prefix. The encoding of a prefix is that of the shorter prefix before its last token, then this token.
So the distinct words of a block of texts are put in order, which is the depth-first order of their trie, and states
are propagated from each node to its children: a prefix that many words share is encoded once. A candidate token
fits behind a state if the pair is stable, which the merge table tells without encoding anything.

Words end in symbols of their own (``x</w>``), so a word's last symbol is a separate leaf below its path.

Texts are taken apart at ASCII white space, where no token can cross, and each distinct piece is brought to words by
the tokenizer's own normalizer and splitter. What was encoded stays in a table of bounded size for later blocks. A file
with another model, normalizer or splitter is not taken apart here: its texts go to the library whole.

Defined results: a null text counts as empty and has no tokens and an empty decoded text; the strings of special
tokens in a text become those tokens, as the library has it; repeated rows are encoded each by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END = "</w>"
#: Pieces of text whose ids a worker keeps in each of two generations, about 60 MB each.
MAX_KEPT = 400_000
#: The same where a new piece costs little.
MAX_FEW = 120_000
#: Places between an ASCII letter and ASCII punctuation but the apostrophe, which begins contractions: always a border of words.
LETTER_MARK = re.compile(rb"([a-z])([!-&(-/:-@\[-`{-~])")
MARK_LETTER = re.compile(rb"([!-&(-/:-@\[-`{-~])([a-z])")
#: Texts are taken in blocks of about this many bytes.
BLOCK_BYTES = 2 << 20


#: The splitter's rule for printable ASCII in lower case.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(rb"[!-~]+")
TOKEN = ""
#: Pieces that are one word to the splitter, whatever stands beside them.
SINGLE = re.compile(rb"[a-z]+|[!-&(-/:-@\[-`{-~]+")


#: The byte alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
#: Fixed values of a tokenizer file: the normalizer and splitter whose borders of words are known here.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def has_known_rules(path: str) -> bool:
    """Whether the file's words are those that the borders here assume; texts go to the library whole if not."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == END and not spec["model"].get("continuing_subword_prefix") and not spec["model"].get("ignore_merges")
        and (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": SPLITTER} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        and all(t["content"].startswith("<|") and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec["added_tokens"])
    )


def backwards(tokens: dict[str, int]) -> dict:
    """A trie of tokens read from their ends; the id stands under TOKEN."""
    root: dict = {}
    for token, i in tokens.items():
        node = root
        for c in reversed(token):
            node = node.setdefault(c, {})
        node[TOKEN] = i
    return root


class PieceTable:
    """Ids of distinct pieces of text, kept in a table of bounded size and joined to the ids of texts."""

    def __init__(self, vocabulary: int, path: str):
        self.known_rules = has_known_rules(path)
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, pieces: Iterable[bytes]) -> None:
        raise NotImplementedError

    def pieces(self, text: bytes) -> list[bytes]:
        """Parts of a text that no token crosses. ASCII case is folded, as the normalizer does, and marks are cut off words; not in texts that may hold a special token."""
        if b"<|" in text:
            return text.split()
        text = LETTER_MARK.sub(rb"\1 \2", text.lower())
        return MARK_LETTER.sub(rb"\1 \2", text).split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, in ``dtype``; call with blocks of bounded size."""
        pieces = [self.pieces(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        if new:
            if len(self.known) + len(new) > MAX_KEPT:
                # What the older generation knows and is met again moves to the younger one.
                self.older, self.known = self.known, {}
                new = set().union(*pieces)
            again = {p for p in new if p in self.older}
            self.known.update((p, self.older[p]) for p in again)
            self.learn(new - again)
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def by_library(library: Tokenizer, texts: list[bytes], dtype: np.dtype) -> list[bytes]:
    """Whole texts by the library, for a file whose borders of words are not known here."""
    found = library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
    return [array(dtype.char, e.ids).tobytes() for e in found]


class TrieEncoder(PieceTable):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        if not has_known_rules(path):
            super().__init__(library.get_vocab_size(with_added_tokens=True), path)
            return
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        super().__init__(size, path)
        self.strings = np.empty(size, dtype=object)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(size)), list(range(size))
        #: A token's place in the order of merges; single symbols come first.
        self.rank = [-1] * size
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], n
        # Only tokens that merging can reach take part, by their strings; those that end a word apart.
        inner = {t: i for t, i in vocab.items() if self.rank[i] >= 0 or len(t.removesuffix(END)) == 1}
        self.open = backwards({t: i for t, i in inner.items() if not t.endswith(END)})
        self.closing = backwards({t.removesuffix(END): i for t, i in inner.items() if t.endswith(END) and t != END})
        self.pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether encoding the two tokens' text gives back the two tokens: no earlier merge crosses their border."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 4 * MAX_KEPT:
                self.pairs.clear()
            found = self.pairs[a, b] = self._stable(a, b)
        return found

    def _stable(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' merges step by step. A merge across the border happens first if its
        # rank is below that of the merge undone last (for an equal pair on the left, below or equal).
        rank, merged = self.rank, self.merged
        bound = math.inf
        while True:
            across = merged.get((a, b))
            if across is not None and rank[across] < bound:
                return False
            if rank[a] > rank[b]:
                bound, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                bound, b = rank[b] + 0.5, self.left[b]
            else:
                return True

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in the byte alphabet), by depth-first traversal of their trie."""
        out: dict[str, list[int]] = {}
        pairs_get, stable = self.pairs.get, self.stable
        path, states = "", [(-1, 0)]  # states[i]: last token and its length, of the path's first i symbols
        for word in sorted(words):
            n, shared = len(word), 0
            top = min(len(path), n - 1)
            while shared < top and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            path = word[:-1]
            for i in range(shared + 1, n + 1):
                node, fitting, j = self.open if i < n else self.closing, [], i
                while j:
                    node = node.get(word[j - 1])
                    if node is None:
                        break
                    j -= 1
                    if TOKEN in node:
                        fitting.append((node[TOKEN], j))
                for token, j in reversed(fitting):
                    before = states[j][0]
                    if before < 0:
                        if j == 0 or before == -2:
                            break
                        continue
                    fits = pairs_get((before, token))
                    if fits or fits is None and stable(before, token):
                        break
                else:
                    token, j = -2, i - 1  # a symbol that the vocabulary lacks: the library drops it
                k = i - j
                if i < n:
                    states.append((token, k))
            ids, i, step = [token], n - k, 0
            while i > 0:
                token, step = states[i]
                ids.append(token)
                i -= step
            out[word] = [x for x in reversed(ids) if x >= 0]
        return out

    def words_of(self, piece: str) -> list[str | int]:
        """Words in the byte alphabet, and ids of special tokens."""
        out: list[str | int] = []
        for part in self.special_at.split(piece) if self.special_at and "<|" in piece else (piece,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.split(self.normalize(part))]
        return out

    def learn(self, pieces: Iterable[bytes]) -> None:
        split = {p: ASCII_WORDS.findall(p.decode().lower()) if PRINTABLE.fullmatch(p) and b"<|" not in p else self.words_of(p.decode("utf-8", "replace")) for p in pieces}
        words = self.encode_words({w for ws in split.values() for w in ws if isinstance(w, str)})
        for p, ws in split.items():
            self.known[p] = array(self.dtype.char, [i for w in ws for i in (words[w] if isinstance(w, str) else (w,))]).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return super().encode(texts) if self.known_rules else by_library(self.library, texts, self.dtype)

    def decode(self, ids: bytes) -> str:
        """Tokens' strings joined by spaces, as the library does for a tokenizer without decoder."""
        if not self.known_rules:
            return self.library.decode(np.frombuffer(ids, self.dtype).tolist(), skip_special_tokens=False)
        return " ".join(self.strings[np.frombuffer(ids, self.dtype)].tolist())


class Kept(dict):
    """Ids of pieces; what is missing is taken from the older generation or made when first asked for."""

    def __init__(self, make: Callable[[bytes], bytes], older: dict[bytes, bytes]):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.make(piece)
        self[piece] = found
        return found


class LibraryEncoder(PieceTable):
    """Encodes new pieces by the tokenizers library itself, for operators that only need ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(self.library.get_vocab_size(with_added_tokens=True), path)
        self.normalize, self.merge = self.library.normalizer.normalize_str if self.known_rules else None, self.library.model.tokenize
        self.known = Kept(self.make, {})

    def make(self, piece: bytes) -> bytes:
        """Ids of one piece; a single word needs no splitter, only the model."""
        if SINGLE.fullmatch(piece):
            return array(self.dtype.char, [t.id for t in self.merge(piece.decode())]).tobytes()
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and self.known_rules and (folded := self.normalize(text)).isalpha():
            return array(self.dtype.char, [t.id for t in self.merge(folded.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        return array(self.dtype.char, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.known_rules:
            return by_library(self.library, texts, self.dtype)
        if len(self.known) > MAX_FEW:
            self.known.older = {}
            self.known = Kept(self.make, self.known)
        get = self.known.__getitem__
        return [b"".join(map(get, self.pieces(t))) for t in texts]


def encoder(path: str) -> TrieEncoder:
    kept = worker_cache("bpe_trie")
    if path not in kept:
        kept[path] = TrieEncoder(path)
    return kept[path]


def blocks(texts: list[bytes]) -> Iterator[slice]:
    """Slices of about BLOCK_BYTES; a longer text is a block of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_texts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in blocks(texts):
                ids = enc.encode(texts[part])
                wide = [np.frombuffer(x, enc.dtype).astype("<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part.start : part.stop], pa.array([len(x) // 4 for x in wide], pa.int64()),
                    pa.array(wide, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string()),
                ], names=[id_col, "n_tokens", "ids", "decoded"])

    return base.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")
