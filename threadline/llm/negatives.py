"""Hard negatives by exact integer inner products, several candidates in one multiplication.

Vectors become integers, and rows and anchors are cut into blocks. For a block of candidates the components are made
non-negative by a bias and several candidates' components are put side by side into fields of one wide integer (Kronecker
substitution). One multiplication an anchor component and integer then adds to all fields at once; a field is wide enough
for the largest sum, so none spills into its neighbour. Unpacking takes the fields apart and subtracts what the biases added:
the products are exact. The wide integer is what a double holds exactly (53 bits) where two fields fit, else 64 bits, else a
Python integer.

Each task walks over its blocks of rows and keeps for each anchor the best so far, twice: first the positives (the same label),
then, with the positives' scores known, the negatives whose score lies in each positive's range. Blocks are ordered by label, and
pairs of blocks without a common label (or with one alone) are left out of the first (second) walk. Anchors are sent to the
tasks in passes of about PASS_ANCHORS; rows are never shuffled.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; a shorter vector
counts as followed by zeros; repeated rows are rows of their own (a repeated anchor is answered twice and may be its own
positive); an empty table gives an empty result; other columns are ignored. A score beyond 55 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, materialize, shuffle_partitions

BLOCK_ROWS = 4096
ANCHOR_ROWS = 512
#: Anchors that are sent to all tasks at once (a few MB at usual lengths of vectors).
PASS_ANCHORS = 16384
POSITIVES = 5
NEGATIVES = 10
SCALE = 256
#: A negative's score is at least LOW and at most HIGH percent of the positive's.
LOW, HIGH = 30, 90
#: Stands for no score.
NONE = -(1 << 62)
#: Scores stay below, so that their percentages fit in 64 bits.
MOST = 1 << 55


# ---- products ------------------------------------------------------------------------------------------------------


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, anchors x rows, by Kronecker-packed multiplication."""
    m, n = len(anchors), len(rows)
    dims = max(anchors.shape[1], rows.shape[1])
    if not (m and n and dims):
        return np.zeros((m, n), np.int64)
    bias_a, bias_c = (max(0, -int(x.min())) for x in (anchors, rows))
    most_a, most_c = int(anchors.max()) + bias_a, int(rows.max()) + bias_c
    width = max(1, (dims * most_a * most_c).bit_length())
    if 2 * width <= 53:
        fields, wide, kind = 53 // width, np.float64, np.int64
    elif width <= 63:
        fields, wide, kind = 63 // width, np.int64, np.int64
    else:
        fields, wide, kind = 4, object, object
    groups = -(-n // fields)
    biased = np.zeros((groups * fields, dims), kind)
    biased[:n] = rows.astype(kind) + bias_c
    # Row g * fields + f stands in field f of integer g.
    packed = np.zeros((groups, dims), kind)
    for f in range(fields):
        packed += biased[f::fields] * (1 << width * f)
    up = anchors.astype(kind) + bias_a
    sums = up.astype(wide) @ packed.astype(wide).T
    sums = sums.astype(kind)
    out = np.zeros((m, groups * fields), kind)
    for f in range(fields):
        out[:, f::fields] = (sums >> width * f) & ((1 << width) - 1)
    # (a + A)(c + C) = ac + C(a + A) + A(c + C) - AC, summed over the components.
    out = out[:, :n] - bias_c * up.sum(1)[:, None] - bias_a * biased[:n].sum(1)[None, :] + dims * bias_a * bias_c
    if width > 53 and (out.max() >= MOST or out.min() <= -MOST):
        raise OverflowError("a score passes 55 bits")
    return out.astype(np.int64)


# ---- blocks --------------------------------------------------------------------------------------------------------

BLOCK_SCHEMA = "least long, most long, n long, dims long, ids binary, labels binary, numbers binary, vectors binary, bounds binary"


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, components as floor(SCALE * x)."""
    vector = F.col(vector_col).cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    return rows.where(usable).withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")))


def small_kind(values: np.ndarray) -> np.dtype:
    top = int(max(-int(values.min()), int(values.max()))) if values.size else 0
    return np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def dense(lists: pa.ListArray) -> np.ndarray:
    """Lists of integers as rows, short ones followed by zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, number, vector, bounds) as blocks of at most ``size``; a partition's blocks by label, rows of a block by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids, labels, numbers = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.lexsort((numbers, ids))
                vectors, bounds = dense(part.column(3))[order], dense(part.column(4))[order]
                raw = vectors.astype(small_kind(vectors)).tobytes()
                values = [int(labels.min()), int(labels.max()), len(ids), vectors.shape[1], ids[order].tobytes(), labels[order].tobytes(), numbers[order].tobytes(), raw, bounds.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 4 else pa.binary()) for i, v in enumerate(values)], names=["least", "most", "n", "dims", "ids", "labels", "numbers", "vectors", "bounds"])

    return map_texts(rows.sortWithinPartitions("label", "id", "number").select("id", "label", "number", "vector", "bounds"), run, BLOCK_SCHEMA)


class Block:
    def __init__(self, row: dict):
        self.least, self.most = row["least"], row["most"]
        self.ids, self.labels, self.numbers = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels", "numbers"))
        n, dims, raw = row["n"], row["dims"], row["vectors"]
        self.vectors = np.frombuffer(raw, f"<i{len(raw) // (n * dims)}" if n * dims else "<i8").reshape(n, dims)
        self.bounds = np.frombuffer(row["bounds"], np.int64).reshape(n, -1)  # scores of an anchor's positives

    def wide(self, dims: int) -> np.ndarray:
        return np.pad(self.vectors, ((0, 0), (0, dims - self.vectors.shape[1])))


class Best:
    """The ``k`` best (scores falling, then ids and row numbers rising) for each query, over the blocks met so far."""

    def __init__(self, k: int):
        self.k, self.kept = k, None

    def add(self, *found: np.ndarray) -> None:
        """Scores, ids and numbers, with queries before the last axis."""
        both = found if self.kept is None else tuple(np.concatenate(x, axis=-1) for x in zip(self.kept, found, strict=True))
        order = np.lexsort((both[2], both[1], -both[0]), axis=-1)[..., : self.k]
        self.kept = tuple(np.take_along_axis(x, order, axis=-1) for x in both)


def first_of(scores: np.ndarray, allowed: np.ndarray, k: int, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the first ``k`` allowed places of each row, ties to the earlier place; NONE where there are fewer.

    ``tops``: for each row several scores, and then the first ``k`` at or below each.
    """
    m, n = scores.shape
    base = int(scores.min())
    if (int(scores.max()) - base + 1) * n < 2**62:  # score and place in one number sort fast
        keys = np.where(allowed, (scores - base) * n + (n - 1 - np.arange(n)), -1)
        keys.sort(axis=1)
        at_or_below = (np.full((m, 1), 2**62) if tops is None else (np.clip(tops, base - 1, base + 2**62 // n - 1) - base) * n + n - 1)
    else:
        order = np.argsort(np.where(allowed, -scores, 2**62), axis=1, kind="stable")[:, ::-1]
        keys, at_or_below = np.take_along_axis(np.where(allowed, scores, NONE), order, axis=1), (np.full((m, 1), 2**62) if tops is None else tops)
    ends = np.stack([np.searchsorted(row, top, "right") for row, top in zip(keys, at_or_below, strict=True)])
    at = ends[:, :, None] - 1 - np.arange(k)
    inside, flat = at >= 0, np.maximum(at, 0).reshape(m, -1)
    found = np.take_along_axis(keys, flat, axis=1).reshape(at.shape)
    if (int(scores.max()) - base + 1) * n < 2**62:
        good = inside & (found >= 0)
        return np.where(good, found // n + base, NONE), np.where(good, n - 1 - found % n, 0)
    good = inside & (found != NONE)
    return np.where(good, found, NONE), np.where(good, np.take_along_axis(order, flat, axis=1).reshape(at.shape), 0)


# ---- walks ---------------------------------------------------------------------------------------------------------


def walk(rows: DataFrame, anchors: DataFrame, positives: bool, k: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, score, id, number) with at most ``k`` rows a task, anchor and slot. ``rows``, ``anchors``: blocks. The anchors come in passes of bounded size, each written out."""
    spark = rows.sparkSession
    before = W.orderBy("least", "most", "ids").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    numbered = materialize(anchors.withColumn("pass", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / PASS_ANCHORS).cast("long")), "anchors")
    out = None
    for number in range((numbered.agg(F.max("pass")).first()[0] or 0) + 1):
        sent = spark.sparkContext.broadcast([r.asDict() for r in numbered.where(F.col("pass") == number).drop("pass").toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = [(Block(r), Best(k)) for r in sent.value]
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row)
                    for anchor, best in queries:
                        if positives and (block.most < anchor.least or anchor.most < block.least) or not positives and block.least == block.most == anchor.least == anchor.most:
                            continue
                        dims = max(anchor.vectors.shape[1], block.vectors.shape[1])
                        scores = packed_products(anchor.wide(dims), block.wide(dims))
                        same = anchor.labels[:, None] == block.labels[None, :]
                        if positives:
                            found, places = first_of(scores, same & (anchor.numbers[:, None] != block.numbers[None, :]), k)
                        else:
                            found, places = first_of(scores, ~same, k, np.where(anchor.bounds == NONE, NONE, high * anchor.bounds // 100))
                            least = -(-low * anchor.bounds // 100)[:, :, None]
                            found = np.where((anchor.bounds[:, :, None] != NONE) & (found >= least), found, NONE)
                        best.add(found, block.ids[places], block.numbers[places])
            for anchor, best in queries:
                if best.kept is None:
                    continue
                scores, ids, numbers = best.kept
                i, slot, _ = at = np.nonzero(scores != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.numbers[i], slot, scores[at], ids[at], numbers[at])], names=["anchor", "slot", "score", "id", "number"])

        part = materialize(map_texts(rows, run, "anchor long, slot long, score long, id long, number long"), "walk")
        out = part if out is None else out.union(part)
    return out


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: a condition on the column ``id``. An anchor's positives are its ``positives`` best other rows of its label; for
    each of them the first ``negatives`` rows of other labels with low * p <= 100 * n <= high * p, for scores p and n.
    """
    parts = shuffle_partitions(rows.sparkSession)
    whole = materialize(quantised(rows, id_col, vector_col, F.col("label") if label is None else label).withColumn("number", F.monotonically_increasing_id()), "vectors")
    no_bounds = F.lit([]).cast("array<long>")
    blocks = materialize(blocked(whole.withColumn("bounds", no_bounds), BLOCK_ROWS), "blocks")
    anchors = whole.where(is_anchor)
    laid = anchors.withColumn("bounds", no_bounds).repartitionByRange(parts, "label", "id", "number")
    near = walk(blocks, blocked(laid, ANCHOR_ROWS), True, positives, low, high)
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id", "number"))
    near = materialize(near.withColumn("slot", place - 1).where(F.col("slot") < positives), "positives")
    bounds = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda x: x["score"]).alias("found"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("found", i + 1), F.lit(NONE)))
    ready = anchors.join(bounds.withColumnRenamed("anchor", "number"), "number").withColumn("bounds", filled).drop("found")
    far = walk(blocks, blocked(ready.repartitionByRange(parts, "label", "id", "number"), ANCHOR_ROWS), False, negatives, low, high)
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "number"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("anchor", F.col("slot").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(far, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
