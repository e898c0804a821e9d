"""Packing of documents into training sequences in the order of a space-filling curve.

A document's token counts are hashed to a vector and projected to three dimensions, the projection is laid on a
grid, and the grid cell's place on the Hilbert curve is the document's key. Documents are range-sorted by key (equal
keys by a hash of the id, so a large group of copies is split), and each range is cut into sequences in that order:
neighbours in a sequence are neighbours on the curve.

Every range fills sequences to the brim, cutting documents where a sequence ends. What is left at a range's end is
cut into sequences whose lengths are powers of two, which need no padding.

Defined results: a null text counts as empty, and is packed as its end token alone; repeated rows are packed each by
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_trie import LibraryEncoder, blocks
from .common import map_texts, materialize, shuffle_partitions, worker_cache

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 10
HASHED = 256
#: Bytes of ids in a range: what one task sorts and packs.
RANGE_BYTES = 32 << 20
#: Steepness of the map from projections to the grid.
SCALE = 6.0
SEED = 20240


def projection(vocabulary: int) -> np.ndarray:
    """For each token the projected image of its hashed unit vector (a bucket of HASHED and a sign)."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket, sign = (mixed >> np.uint64(40)) % np.uint64(HASHED), np.where(mixed >> np.uint64(63), 1.0, -1.0)
    basis = np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))
    return (basis[bucket.astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert(grid: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (BITS bits each), by Gray-code rotations."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(BITS - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, given their token ids; an empty document lies in the middle of the grid."""
    means = np.zeros((len(ids), DIMENSIONS))
    for i, x in enumerate(ids):
        if len(x):
            means[i] = table[x].mean(axis=0)
    cells = (0.5 + np.arctan(means * SCALE) / np.pi) * (1 << BITS)
    return hilbert(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1))


def _encoder(path: str) -> tuple[LibraryEncoder, np.ndarray]:
    kept = worker_cache("packing")
    if path not in kept:
        enc = LibraryEncoder(path)
        kept[path] = enc, projection(enc.library.get_vocab_size(with_added_tokens=True))
    return kept[path]


def sequence_lengths(left: int) -> list[int]:
    """Powers of two, the largest first, that sum to what is left."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """Pieces: (id, start, length, ids, doc_tokens, sequence_id, offset); ids as little-endian unsigned 32-bit integers.

    ``n_ranges``: ranges of the curve, each packed by one task; if not given as many as shuffle partitions, and more
    where a range would pass RANGE_BYTES.
    """
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = base.schema[id_col].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = _encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in blocks(texts):
                found = enc.encode(texts[part])
                keys = curve_keys([np.frombuffer(x, enc.dtype) for x in found], table)
                wide = enc.dtype.itemsize == 4
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(keys, pa.int64()), pa.array([wide] * len(found)), pa.array(found, pa.binary())], names=[id_col, "key", "wide", "ids"])

    coded = map_texts(base, tokens, f"`{id_col}` {kind}, key long, wide boolean, ids binary")
    coded = materialize(coded.withColumn("tie", F.xxhash64(id_col, "ids")).withColumn("size", F.octet_length("ids").cast("long")), "curve")
    n = n_ranges or max(shuffle_partitions(docs.sparkSession), (coded.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES + 1)
    ordered = coded.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", id_col)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        # The open sequence's pieces wait until it is full; at the end they are cut again.
        waiting: list[tuple] = []
        filled = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(columns[i], pa.int64()) for i in (1, 2)], pa.array(columns[3], pa.binary()), *[pa.array(columns[i], pa.int64()) for i in (4, 5, 6)]], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = None
        out: list[tuple] = []
        for batch in batches:
            id_type = batch.column(0).type
            for doc, wide, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), np.uint32(END_ID))
                at = 0
                while at < len(ids):
                    length = min(SEQUENCE - filled, len(ids) - at)
                    waiting.append((doc, at, length, ids[at : at + length], len(ids), filled))
                    at += length
                    filled += length
                    if filled == SEQUENCE:
                        out += [(d, s, m, x.tobytes(), t, sequence, o) for d, s, m, x, t, o in waiting]
                        waiting, filled, sequence = [], 0, sequence + 1
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        for size in sequence_lengths(filled):
            room = size
            while room:
                d, s, m, x, t, _ = waiting.pop(0)
                take = min(room, m)
                out.append((d, s, take, x[:take].tobytes(), t, sequence, size - room))
                room -= take
                if take < m:
                    waiting.insert(0, (d, s + take, m - take, x[take:], t, 0))
            sequence += 1
        if out:
            yield batch_of(out)

    return map_texts(ordered.select(id_col, "key", "wide", "ids"), pieces, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
