"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A text's elements are its shingles of SHINGLE words, weighted by how often they occur. Every element sends arrivals of
a Poisson process with its weight as rate, each to a random register; a register keeps the element of its earliest
arrival, and an element stops once its next arrival would come after the latest register (early termination). Two
texts agree in a register with their probability Jaccard similarity. Texts that agree in all registers of a band meet
in a bucket.

In a bucket all are compared with a pivot: the member that meets most others over all its buckets, the centre of a
group of copies. So a large group of copies costs one comparison each and not one for each of its pairs. Buckets whose
members these links leave in several components are settled by all pairs of members of different components, but for
pairs whose sketches of SKETCH registers show them to be far below the threshold and pairs that links found on the way
have joined; a pair is looked at in the first bucket only that both share. Members of large buckets are dealt to blocks,
and each task compares two blocks, so no pair is a row unless it is a link. Pairs are
verified by the exact probability Jaccard similarity of whole texts; the pivot of a large group is dealt out to many
tasks by a salt. Links are closed to classes by minimum labels. Exact copies are one node from the start.

Defined results: a null text counts as empty; texts without words are similar to equal texts only; texts of fewer
than SHINGLE words are one shingle; repeated rows fall in one class; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_trie import blocks
from .common import let_go, map_texts, materialize, shuffle_partitions, worker_cache

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 6 registers miss a pair of similarity 0.8 with a chance of 6e-5.
BANDS, ROWS = 32, 6
#: Registers of a sketch.
SKETCH = 1536
#: Pairs whose sketches agree in less than this are no links: five standard errors below 0.8.
SURELY_BELOW = 0.05
#: Registers that a block of texts may have in memory.
MAX_REGISTERS = 1 << 22
#: Members and characters of a block of a large bucket; pairs whose sketches are compared at once.
BLOCK, BLOCK_CHARS, AT_ONCE = 256, 4_000_000, 2048
#: Members that one copy of a pivot serves.
SALT = 256
#: Nodes (16 bytes each) sent to all tasks to pick texts; beyond, texts are shuffled by node.
MAX_BROADCAST_NODES = 500_000
MAX_KEPT = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts in order, and the number of words of each text."""
    split = [t.split() for t in texts]
    known = worker_cache("near_dups")
    if len(known) > MAX_KEPT:
        known.clear()
    for w in set().union(*split).difference(known) if split else ():
        known[w] = xxhash.xxh64_intdigest(w)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    get = known.__getitem__
    return np.fromiter((x for words in split for x in map(get, words)), np.uint64, int(sizes.sum())), sizes


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of the distinct shingles of each text, by index and hash."""
    words, sizes = word_ids(texts)
    starts = np.cumsum(sizes) - sizes
    n = len(words)
    h = np.zeros(n, np.uint64)
    short = sizes < SHINGLE
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # words from here to the text's end
    for i in range(SHINGLE):
        # A text shorter than a shingle hashes what it has, from its first word.
        here = np.zeros(n, np.uint64)
        here[: max(0, n - i)] = words[i:]
        h = np.where(left > i, mix(h * GOLDEN + here + np.uint64(i + 1)), h)
    valid = (left >= SHINGLE) | short[owner] & (np.arange(n) == starts[owner]) if n else np.zeros(0, bool)
    owner, h = owner[valid], h[valid]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of each text (n_texts x m registers, 32 bits of the element that came first)."""
    # A register holds the arrival time's float bits above the element's low bits: the least word is the earliest.
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    registers = np.full(n_texts * m, empty, np.uint64)
    low = mix(element + GOLDEN) & np.uint64(0xFFFFFFFF)
    alone = np.bincount(owner, minlength=n_texts) == 1
    single = alone[owner]
    registers.reshape(n_texts, m)[owner[single]] = low[single][:, None]
    active = np.flatnonzero(~single)
    time, rate = np.zeros(len(owner), np.float64), weight.astype(np.float64)
    step = 0
    while len(active):
        step += 1
        random = mix(element[active] + np.uint64(step * int(GOLDEN) % (1 << 64)))
        gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time[active] += gap / rate[active]
        register = owner[active] * m + (mix(random + GOLDEN) % np.uint64(m)).astype(np.int64)
        bits = time[active].astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(registers, register, (bits << np.uint64(32)) | low[active])
        if step < 2 or step % 2 == 0:
            latest = (registers.reshape(n_texts, m).max(axis=1) >> np.uint64(32)).astype(np.uint32)
            limit = np.where(latest == 0xFFFFFFFF, np.inf, latest.view(np.float32).astype(np.float64))
            active = active[time[active] <= limit[owner[active]]]
    return (registers & np.uint64(0xFFFFFFFF)).reshape(n_texts, m)


def band_keys(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands keys, each of one band's registers and its number."""
    parts = found.reshape(len(found), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(found), bands)).copy()
    for i in range(parts.shape[2]):
        keys = mix(keys * GOLDEN + parts[:, :, i] + np.uint64(1))
    return keys.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (hashes in order, counts).

    With elements in the order of x/y, an element's denominator is the x of those not before it over its own x plus
    the y of those before it over its own y.
    """
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = ca[ia].astype(float), cb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_x, only_y = ca.sum() - x.sum(), cb.sum() - y.sum()
    return float((1.0 / ((x[::-1].cumsum()[::-1] + only_x) / x + (y.cumsum() - y + only_y) / y)).sum())


def as_words(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(node, keys, sketch) of (node, text); the sketch is a byte of each register."""
    most = max(1, MAX_REGISTERS // (bands * rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [as_words(t) for t in b.column(1).to_pylist()]
            for part in blocks(texts):
                for start in range(part.start, part.stop, most):
                    stop = min(start + most, part.stop)
                    mine = texts[start:stop]
                    owner, element, weight = shingles(mine)
                    found = signatures(owner, element, weight, len(mine), bands * rows)
                    keys, sketch = band_keys(found, bands), (found & np.uint64(255)).astype(np.uint8)
                    has = np.bincount(owner, minlength=len(mine)) > 0
                    yield pa.RecordBatch.from_arrays([b.column(0)[start:stop], pa.array([k.tolist() if h else [] for k, h in zip(keys, has, strict=True)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["node", "keys", "sketch"])
        let_go()

    return map_texts(docs.select("node", "text"), run, "node binary, keys array<bigint>, sketch binary")


def verified(pairs: DataFrame) -> DataFrame:
    """(node, pivot, similarity) of (node, pivot, text, pivot_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine, pivots = [[as_words(t) for t in b.column(i).to_pylist()] for i in (2, 3)]
            out, last, kept = [], None, None
            for t, p in zip(mine, pivots, strict=True):
                if p != last:
                    last, kept = p, shingles([p])[1:]
                out.append(similarity(shingles([t])[1:], kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["node", "pivot", "similarity"])
        let_go()

    return map_texts(pairs.select("node", "pivot", "text", "pivot_text"), run, "node binary, pivot binary, similarity double")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One (node, text) for each node asked for."""
    few = nodes.count() <= MAX_BROADCAST_NODES
    found = docs.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    return materialize(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def with_degrees(keyed: DataFrame) -> DataFrame:
    """(key, band, node, degree) of the buckets of two or more; degree counts whom a node meets in all its buckets."""
    rows = keyed.select(F.posexplode("keys").alias("band", "key"), "node")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(rows.join(sizes, "key"), "shared")
    return shared.select("key", "band", "node").join(shared.groupBy("node").agg(F.sum("size").alias("degree")), "node")


def pivot_links(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame | None:
    """Verified (node, pivot) of each member with its bucket's member of most degree; None if nobody meets."""
    buckets = members.groupBy("key").agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("pivot"))
    met = members.join(buckets, "key").filter("pivot <> node")
    pairs = materialize(met.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("other"), "pivot").groupBy("node", "other").agg(F.min("pivot").alias("pivot")).select(F.when(F.col("node") == F.col("pivot"), F.col("other")).otherwise(F.col("node")).alias("node"), "pivot"), "pairs")
    if pairs.isEmpty():
        return None
    wanted = pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct()
    texts = texts_of(docs, wanted)
    copies = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SALT).cast("int").alias("copies"))
    dealt = copies.join(texts.withColumnRenamed("node", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("text").alias("pivot_text"))
    salted = pairs.join(copies, "pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    both = salted.join(texts, "node").join(dealt, ["pivot", "salt"])
    return materialize(verified(both), "checked").filter(F.col("similarity") >= threshold).select("node", "pivot")


def settled(t: pa.Table, threshold: float) -> pa.Table:
    """Verified (node, pivot) between components of one bucket: within a block, or between two."""
    n, key, one_block = t.num_rows, t["key"][0].as_py(), t["low"][0].as_py() == t["high"][0].as_py()
    nodes, texts = t["node"].to_pylist(), t["text"].to_pylist()
    keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(n, -1)
    block = t["block"].to_numpy()
    label = np.unique(np.array([x.hex() for x in t["label"].to_pylist()]), return_inverse=True)[1]
    left, right = np.triu_indices(n, 1)
    open_pairs = label[left] != label[right]
    if not one_block:
        open_pairs &= block[left] != block[right]
    left, right = left[open_pairs], right[open_pairs]
    hopeful = []
    for at in range(0, len(left), AT_ONCE):
        i, j = left[at : at + AT_ONCE], right[at : at + AT_ONCE]
        # The first band that both share is this bucket's, or another bucket has the pair.
        mine = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key
        i, j = i[mine], j[mine]
        # A byte agrees by chance once in 256 times, which only lets more pairs pass.
        agree = (sketch[i] == sketch[j]).mean(axis=1)
        hopeful += [(-a, x, y) for a, x, y in zip(agree.tolist(), i.tolist(), j.tolist(), strict=True) if a >= threshold - SURELY_BELOW]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found = []
    for _, i, j in sorted(hopeful):
        a, b = root(int(label[i])), root(int(label[j]))
        if a == b:
            continue
        for x in (i, j):
            if x not in known:
                known[x] = shingles([as_words(texts[x])])[1:]
        if similarity(known[i], known[j]) >= threshold:
            parent[a] = b
            found.append((nodes[i], nodes[j]))
    return pa.table({"node": pa.array([a for a, _ in found], pa.binary()), "pivot": pa.array([b for _, b in found], pa.binary())})


def cross_links(docs: DataFrame, keyed: DataFrame, members: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Verified (node, pivot) that join components of ``found`` which share a bucket, as many as it takes."""
    labelled = materialize(members.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    # Buckets of the same members are one, that of the first band. The pivot's component is mostly the largest.
    buckets = labelled.groupBy("key").agg(F.min("band").alias("band"), F.min("label").alias("a"), F.max("label").alias("b"), F.min_by("label", F.struct(-F.col("degree"), "node")).alias("main"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    unsettled = buckets.filter("a <> b").groupBy("x", "y", "size").agg(F.min_by(F.struct("key", "main"), "band").alias("first")).select("first.*")
    rows = materialize(labelled.join(unsettled, "key").select("key", "node", "label", (F.col("label") != F.col("main")).alias("outside")), "unsettled")
    open_nodes = materialize(rows.select("node").distinct(), "open")
    texts = texts_of(docs, open_nodes)
    # Long signatures cost much for few bytes, so the texts are spread over all tasks.
    spread = texts.repartition(shuffle_partitions(docs.sparkSession), "node")
    profiles = materialize(signed(spread, 1, SKETCH).select("node", "sketch").join(texts, "node").join(keyed, "node"), "profiles")
    rows = rows.join(profiles.select("node", (1 / BLOCK + F.length("text") / BLOCK_CHARS).alias("weight")), "node")
    blocks_of = lambda of: F.ceil(F.coalesce(F.sum(F.when(of, F.col("weight"))), F.lit(0.0))).cast("int")
    sizes = rows.groupBy("key").agg(blocks_of(F.lit(True)).alias("n"), blocks_of(F.col("outside")).alias("n_outside"), blocks_of(~F.col("outside")).alias("n_inside"))
    # Blocks of the main component follow the others; they are compared with those, not with each other.
    sizes = sizes.select("key", F.when(F.col("n") == 1, 1).otherwise(F.col("n_outside")).alias("n_outside"), F.when(F.col("n") == 1, 0).otherwise(F.col("n_inside")).alias("n_inside"))
    rows = rows.join(sizes, "key").withColumn("first", F.col("outside") | (F.col("n_inside") == 0))
    place = F.xxhash64("node", "key")
    rows = rows.withColumn("block", F.when(F.col("first"), F.pmod(place, F.greatest("n_outside", F.lit(1)))).otherwise(F.col("n_outside") + F.pmod(place, F.greatest("n_inside", F.lit(1)))).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("n_outside") + F.col("n_inside")).otherwise(F.col("n_outside")) - 1)))
    dealt = rows.select("key", F.least("block", "with").cast("int").alias("low"), F.greatest("block", "with").cast("int").alias("high"), "block", "node", "label").join(profiles, "node")
    return materialize(dealt.groupBy("key", "low", "high").applyInArrow(lambda t: settled(t, threshold), "node binary, pivot binary"), "cross")


def links(docs: DataFrame, threshold: float) -> DataFrame:
    """Verified (node, pivot) that join all texts of a class; ``docs`` has (node, text), copies included."""
    keyed = materialize(signed(docs, BANDS, ROWS).select("node", "keys").dropDuplicates(["node"]), "bands")
    members = materialize(with_degrees(keyed), "members")
    found = pivot_links(docs, members, threshold)
    if found is None:
        return keyed.select("node", F.col("node").alias("pivot")).limit(0)
    return found.union(cross_links(docs, keyed, members, found, threshold))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (node, pivot): the least node of its component, by minimum labels with shortcuts."""
    both = materialize(edges.union(edges.select("pivot", "node")).distinct().toDF("a", "b"), "edges")
    labels = materialize(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("to"))
        # A label's own label is at least as good: paths halve in each round.
        hop = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = materialize(better.join(hop, "to", "left").select("node", F.col("label").alias("old"), F.least("to", F.coalesce("beyond", "to")).alias("label")), "labels")
        changed = not new.filter("old <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def labelled(base: DataFrame, threshold: float) -> DataFrame:
    """The columns of ``base`` but the text, with the label of the node's class; ``base`` has text (no nulls) and node."""
    labels = components(links(base.select("node", "text"), threshold))
    return materialize(base.drop("text").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "members")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size) of every row: class_id is the least id of the class, class_size its rows."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), node_of(F.col(text_col)).alias("node"))
    rows = labelled(base, threshold).select(id_col, "label")
    classes = rows.groupBy("label").agg(F.min(id_col).alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "label").select(id_col, "class_id", "class_size")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, that of the least id (nulls first), then text and row by their hashes; all columns stay."""
    # Names that no column of the caller has.
    marks = "_" * (1 + max(map(len, docs.columns), default=0))
    node, row = marks + "node", marks + "row"
    others = F.struct(F.col(text_col).isNull().alias("no_text"), *[F.col(c) for c in docs.columns if c not in (id_col, text_col)])
    marked = docs.withColumn(node, node_of(F.col(text_col))).withColumn(row, F.unhex(F.md5(F.to_json(others).cast("binary"))))
    base = marked.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(node).alias("node"), F.col(row).alias("row"))
    rows = labelled(base, threshold)
    # Two rows alike in all columns are one row here.
    kept = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNotNull().alias("has_id"), "id", "node", "row")).alias("least"))
    kept = materialize(kept.select(F.col("least.id").alias("kept_id"), F.col("least.node").alias("kept_node"), F.col("least.row").alias("kept_row")), "kept")
    few = kept.count() <= MAX_BROADCAST_NODES
    same = marked[id_col].eqNullSafe(kept["kept_id"]) & (marked[node] == kept["kept_node"]) & (marked[row] == kept["kept_row"])
    out = marked.join(F.broadcast(kept) if few else kept, same, "left_semi")
    repeated = rows.groupBy("id", "node", "row").count().filter("count > 1")
    return (out if repeated.isEmpty() else out.dropDuplicates([id_col, node, row])).drop(node, row)
