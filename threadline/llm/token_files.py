"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-sorted by id, each task encodes its range and writes files of at most about FILE_IDS ids; a table with
one row a file (the listing) tells which files count, so what a lost or repeated task has left behind is never read. A
document's start is its place in its file plus the ids of all files before it.

A file holds its documents' ids and lengths (as an Arrow table), the index of block starts, and blocks of BLOCK ids: the
block's minimum is subtracted, the rest is packed at a width at which one of PERCENTILES of the block fits, whichever makes
the block smallest, and what does not fit stands in the block's exception list (places, and the bits above the width).
With the index a span of ids is read from its blocks alone.

Encoding is the tokenizers library's. A text is taken apart before single spaces that follow no white space, where no
byte-level token can cross; each distinct piece is encoded once a block of texts, many in one call, and kept in a table of
bounded size. A tokenizer file of another kind is given whole texts.

Defined results: a null text counts as empty and has the end id alone; null document ids come first; equal ids are in the
order of a hash of their texts, rows alike in both each for itself; an empty table gives no file and no row; other columns
are ignored. The strings of special tokens in a text become those tokens, as the library has it.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_trie import blocks
from .common import map_texts, materialize, shared_dir, shuffle_partitions, worker_cache

BLOCK = 512
#: Ids of a file, whose documents stay whole; a longer document is a file of its own.
FILE_IDS = 4 << 20
PERCENTILES = (0.75, 0.9, 0.95, 0.98, 1.0)
#: Bytes of an exception: its place in the block and the bits above the width.
PLACE, ABOVE = np.dtype("<u2"), np.dtype("<u4")
HEAD = np.dtype([("least", "<u4"), ("ids", "<u2"), ("exceptions", "<u2"), ("width", "<u2")])
MAGIC = b"PFORIDS1"
#: Pieces that a worker keeps in each of two generations.
MAX_PIECES = 300_000
#: Between a letter or digit and a mark behind it two tokens always meet.
SPACED = re.compile(r"\s ")
BORDER = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ɏ])(?=[!-/:-@\[-`{-~])")


# ---- blocks --------------------------------------------------------------------------------------------------------


def _bits_of_16() -> np.ndarray:
    return np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


BITS_OF_16 = _bits_of_16()


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 32-bit value; 0 has none."""
    if not values.size or values.max() < 1 << 16:
        return BITS_OF_16[values]
    high = values >> np.uint32(16)
    return np.where(high > 0, BITS_OF_16[high] + np.uint8(16), BITS_OF_16[values & np.uint32(0xFFFF)])


def packed(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of equally many values below 2**width, as rows of little-endian bit strings (bytes), the lowest bit first."""
    n, k = rows.shape
    words = np.zeros((-(-k * width // 64) + 1, n), np.uint64)
    turned = np.ascontiguousarray(rows.T, np.uint64)
    for i in range(k if width else 0):
        at, shift = divmod(i * width, 64)
        words[at] |= turned[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= turned[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T.astype("<u8")).view(np.uint8)[:, : -(-k * width // 8)]


def unpacked(data: np.ndarray, k: int, width: int) -> np.ndarray:
    """The inverse of ``packed`` for rows of bytes."""
    n = len(data)
    rows = np.zeros((n, -(-k * width // 64) + 1), "<u8")
    rows.view(np.uint8)[:, : data.shape[1]] = data
    words = np.ascontiguousarray(rows.T)
    out = np.zeros((k, n), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(k if width else 0):
        at, shift = divmod(i * width, 64)
        v = words[at] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[at + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def chosen_widths(rows: np.ndarray) -> np.ndarray:
    """For each row of values the width, among those of its percentiles, that takes the fewest bytes."""
    bits = bit_lengths(rows)
    ranked = np.sort(bits, axis=1, kind="stable")
    k = bits.shape[1]
    best, cost = None, None
    for p in PERCENTILES:
        width = ranked[:, min(k - 1, int(np.ceil(p * k)) - 1)]
        size = -(-k * width.astype(np.int64) // 8) + np.count_nonzero(bits > width[:, None], axis=1) * (PLACE.itemsize + ABOVE.itemsize)
        if best is None:
            best, cost = width, size
        else:
            best, cost = np.where(size < cost, width, best), np.minimum(size, cost)
    return best


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids each (the last may be shorter)."""
    whole = len(ids) // BLOCK * BLOCK
    out: list[bytes] = []
    for rows in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if not rows.size:
            continue
        least = rows.min(axis=1)
        rest = (rows - least[:, None]).astype(np.uint32)
        widths = chosen_widths(rest)
        made: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            here = rest[at]
            low = packed(here & np.uint32((1 << width) - 1), width)
            above = here >> np.uint32(width) if width < 32 else np.zeros_like(here)
            of, places = np.nonzero(above)
            high, places, stops = above[of, places].astype(ABOVE), places.astype(PLACE), np.searchsorted(of, np.arange(len(at) + 1))
            heads = np.zeros(len(at), HEAD)
            heads["least"], heads["ids"], heads["exceptions"], heads["width"] = least[at], rows.shape[1], np.diff(stops), width
            for j, i in enumerate(at.tolist()):
                here = slice(stops[j], stops[j + 1])
                made[i] = b"".join((heads[j].tobytes(), low[j].tobytes(), places[here].tobytes(), high[here].tobytes()))
        out += made
    return out


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the consecutive blocks that begin at ``starts`` of ``data`` (bytes)."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    heads = data[starts[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0]
    out = np.zeros(int(heads["ids"].sum()), np.uint32)
    ends = np.cumsum(heads["ids"].astype(np.int64))
    for k, width in {(int(h["ids"]), int(h["width"])) for h in np.unique(heads[["ids", "width"]])}:
        at = np.flatnonzero((heads["ids"] == k) & (heads["width"] == width))
        size = -(-k * width // 8)
        rows = unpacked(data[(starts[at] + HEAD.itemsize)[:, None] + np.arange(size)], k, width)
        for j in np.flatnonzero(heads["exceptions"][at]).tolist():
            n, first = int(heads["exceptions"][at[j]]), int(starts[at[j]]) + HEAD.itemsize + size
            places = data[first : first + n * PLACE.itemsize].view(PLACE)
            first += n * PLACE.itemsize
            rows[j, places] |= data[first : first + n * ABOVE.itemsize].view(ABOVE) << np.uint32(width)
        rows += heads["least"][at][:, None]
        out[(ends[at] - k)[:, None] + np.arange(k)] = rows
    return out


# ---- files ---------------------------------------------------------------------------------------------------------


def file_bytes(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"doc": doc_ids, "ids": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    listed = sink.getvalue().to_pybytes()
    made = encode_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in made])]).astype("<u8")
    head = MAGIC + np.array([len(ids), len(made), len(listed)], "<u8").tobytes()
    return b"".join((head, listed, starts.tobytes(), *made))


def opened(data: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Documents, block starts in ``data``, and the number of ids of a file's bytes."""
    if data[:8].tobytes() != MAGIC:
        raise ValueError("not a file of token ids")
    n_ids, n_blocks, size = data[8:32].view("<u8").tolist()
    table = pa.ipc.open_stream(data[32 : 32 + size].tobytes()).read_all()
    first = 32 + size
    starts = np.frombuffer(data[first : first + 8 * (n_blocks + 1)].tobytes(), "<u8").astype(np.int64) + first + 8 * (n_blocks + 1)
    return table, starts, n_ids


def span(data: np.ndarray, start: int, length: int) -> np.ndarray:
    """Ids from ``start`` of a file's bytes, read from the blocks that hold them alone."""
    _, starts, n_ids = opened(data)
    if start < 0 or length < 0 or start + length > n_ids:
        raise IndexError(f"{start} and {length} more of {n_ids} ids")
    first, last = start // BLOCK, -(-(start + length) // BLOCK)
    return decode_blocks(data, starts[first:last])[start - first * BLOCK :][:length]


def put(uri: str, data: bytes) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def get(uri: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


# ---- encoding ------------------------------------------------------------------------------------------------------


class Known(dict):
    """Ids of pieces. One that is missing is taken from the older generation, or an empty place is kept for its ids."""

    def __init__(self, older: dict[str, bytes]):
        super().__init__()
        self.older = older
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytes | bytearray:
        found = self.older.get(piece)
        if found is None:
            found = bytearray()
            self.new.append(piece)
        self[piece] = found
        return found


class SpacedEncoder:
    """Ids of texts by the library, each distinct piece once; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(self.library.to_str())
        model, splitter, added = rules["model"], rules["pre_tokenizer"] or {}, rules["added_tokens"]
        self.known_rules = (
            model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and model.get("unk_token") is None and not model.get("ignore_merges") and rules["normalizer"] is None
            and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in added)
        )
        self.sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(token)
        for a in added:
            self.sizes[a["id"]] = len(a["content"].encode())
        self.small = np.dtype("<u2" if len(self.sizes) <= 1 << 16 else "<u4")
        self.known = Known({})
        #: Parts of pieces behind a border.
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.small).tobytes()

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words behind a space, many in one call; the tokens' sizes tell where each ends."""
        made, size = {}, self.small.itemsize
        for i in range(0, len(words), 300):
            part = words[i : i + 300]
            text = " " + " ".join(part)
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, self.small)
            lengths = map(len, part) if text.isascii() else (len(w.encode()) for w in part)
            ends = (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(lengths, np.int64, len(part)) + 1)) + 1) * size
            raw, at = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                made[w] = raw[at:end]
                at = end
        return made

    def tail(self, part: str) -> bytes:
        """Ids of what no space stands before."""
        found = self.tails.get(part)
        if found is None:
            found = self.tails[part] = self.whole(part)
        return found

    def learn(self) -> None:
        """Fills the places of new pieces: a piece behind a space is its word and the marks at its borders, each encoded once."""
        known, tail, new = self.known, self.tail, self.known.new
        if not new:
            return
        plain, cut, made = [], [], {}
        for p in new:
            if p.isalpha():
                plain.append(p)
            elif not p or p[-1].isspace() or "<|" in p:
                made[p] = self.whole(" " + p)
            else:
                cut.append((p, BORDER.split(p)))
        heads = {parts[0] for _, parts in cut}
        made |= self.words([*plain, *(heads - known.keys()), *(p for p, parts in cut if len(parts) == 1)])
        for p, parts in cut:
            if len(parts) > 1:
                head = made.get(parts[0])
                made[p] = b"".join((known[parts[0]] if head is None else head, *map(tail, parts[1:])))
        for p in new:
            known[p].extend(made[p])
            known[p] = made[p]
        new.clear()

    def pieces(self, text: str) -> list[str]:
        """The text before its first space, then what follows each space, as far as no white space is before one."""
        parts = text.split(" ")
        if not SPACED.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if len(out) > 1 and not out[-1] or out[-1][-1:].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.known_rules:
            return [np.frombuffer(self.whole(t), self.small) for t in texts]
        if len(self.known) > MAX_PIECES:
            self.known = Known(dict(self.known))
        if len(self.tails) > MAX_PIECES:
            self.tails = {}
        gc.disable()  # many small objects and no cycles among them
        try:
            look, parts = self.known.__getitem__, [self.pieces(t) for t in texts]
            heads = [b"".join(map(self.tail, BORDER.split(p[0]) if "<|" not in p[0] else p[:1])) for p in parts]
            found = [list(map(look, p[1:])) for p in parts]
            self.learn()
            return [np.frombuffer(head + b"".join(p), self.small) for head, p in zip(heads, found, strict=True)]
        finally:
            gc.enable()


def encoder(path: str) -> SpacedEncoder:
    kept = worker_cache("token_files")
    if path not in kept:
        kept[path] = SpacedEncoder(path)
    return kept[path]


# ---- the operator --------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; returns their listing (file, start, n_ids, n_docs), a row a file, ``start`` counting ids of all files before."""
    spark = docs.sparkSession
    folder = f"{folder or shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The row's own number parts rows alike in both; it only breaks ties between equal rows.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc", "tie", "row").sortWithinPartitions("doc", "tie", "row").select("doc", "text")
    names = ["part", "number", "file", "n_ids", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[pa.Array] = []
        ids: list[np.ndarray] = []
        filled = number = 0
        end = np.array([end_id], enc.small if end_id < 1 << 8 * enc.small.itemsize else "<u4")

        def written() -> pa.RecordBatch:
            uri = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}"
            lengths = np.array([len(x) for x in ids], np.int64)
            put(uri, file_bytes(pa.concat_arrays(held), lengths, np.concatenate(ids).astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((part, pa.int64()), (number, pa.int64()), (uri, pa.string()), (int(lengths.sum()), pa.int64()), (len(ids), pa.int64()))], names=names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for block in blocks(texts):
                for i, x in enumerate(enc.encode(texts[block]), block.start):
                    if filled and filled + len(x) >= file_ids:
                        yield written()
                        held, ids, filled, number = [], [], 0, number + 1
                    held.append(batch.column(0).slice(i, 1))
                    ids.append(np.concatenate([x, end]))
                    filled += len(x) + 1
        if ids:
            yield written()

    listed = materialize(map_texts(ordered, run, "part long, number long, file string, n_ids long, n_docs long"), "listing")
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)  # a row a file
    return listed.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", "n_docs")


def read_token_files(listing: DataFrame, kind: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document from the files; ids as little-endian unsigned 32-bit integers.

    ``kind``: the type of the documents' ids.
    """
    n = shuffle_partitions(listing.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = get(uri)
                table, starts, _ = opened(data)
                lengths = table.column(1).to_numpy()
                ends = np.cumsum(lengths)
                ids = decode_blocks(data, starts[:-1]).astype("<u4")
                docs = table.column(0).combine_chunks()
                at = 0
                while at < len(lengths):
                    stop = max(at + 1, min(at + 2000, int(np.searchsorted(ends, ends[at] - lengths[at] + (1 << 20), "right"))))
                    raw = [ids[e - m : e].tobytes() for e, m in zip(ends[at:stop], lengths[at:stop], strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.slice(at, stop - at), pa.array(first + ends[at:stop] - lengths[at:stop], pa.int64()), pa.array(lengths[at:stop], pa.int64()), pa.array(raw, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])
                    at = stop

    return listing.select("file", "start").repartition(n).mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as they are read back from files written for them."""
    listing = write_token_files(docs, tokenizer_path, end_id, id_col=id_col, text_col=text_col)
    return read_token_files(listing, docs.schema[id_col].dataType.simpleString(), id_col=id_col)
