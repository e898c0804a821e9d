"""Typed edges between facts, integrity, components and heads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.operators.tables import materialize


def shared_source_edges(nodes: DataFrame, source: list[str], rank: Column) -> DataFrame:
    """Edges between facts of one source, from the lower rank to the next: every fact is linked to the first fact of
    each higher rank that its source holds, so a large source gives edges in proportion to its facts."""
    ranked = nodes.withColumn("rank", rank)
    heads = ranked.groupBy(*source, "rank").agg(F.min("fact_id").alias("head_id")).withColumnRenamed("rank", "head_rank")
    joined = ranked.join(heads, source).filter("rank < head_rank")
    return joined.select(*source, F.col("fact_id").alias("from_id"), F.col("head_id").alias("to_id"), F.col("rank").alias("from_rank"), F.col("head_rank").alias("to_rank"))


def transition_edges(versions: DataFrame) -> DataFrame:
    """Edges from each version to its predecessor's: persists for an equal value, else updates."""
    w = W.partitionBy("subject_id", "family", "factor_key").orderBy("ingest_seq")
    rows = versions.select("subject_id", F.col("fact_id").alias("to_id"), F.lag("fact_id").over(w).alias("from_id"), F.lag("value").over(w).alias("before"), "value")
    return rows.filter("from_id is not null").select("subject_id", "from_id", "to_id", F.when(F.col("value") == F.col("before"), "persists").otherwise("updates").alias("relation"))


def asof_by_ingest(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each left row (fact_id, event_ts) the last-ingested right row with an earlier event time; one pass over the
    union of both sides in event order with a running maximum of the ingest number, no range join."""
    both = left.select(*keys, F.col("fact_id").alias("left_id"), "event_ts", F.lit(None).cast("long").alias("right_id")).unionByName(
        right.select(*keys, F.lit(None).cast("long").alias("left_id"), "event_ts", F.col("fact_id").alias("right_id")))
    # A RANGE frame that ends before the current time keeps strict order among equal times.
    w = W.partitionBy(*keys).orderBy(F.unix_micros(F.col("event_ts").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn("match_id", F.max("right_id").over(w)).filter("left_id is not null").select(*keys, F.col("left_id").alias("fact_id"), "match_id")


def dangling(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference does not resolve."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


#: Nodes that a task holds at once; beyond, what it has found goes out and it starts anew.
STAR_NODES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as edges from each node to the least node that it is joined to there; a lone node keeps its loop."""
    parent: dict = {}

    def root(x: object) -> object:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def found() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for start in range(0, len(nodes), 10_000):
            part = nodes[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, shape.field(0).type), pa.array([root(x) for x in part], shape.field(0).type)], names=["a", "b"])

    shape = None
    for batch in batches:
        shape = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > STAR_NODES:
            yield from found()
            parent.clear()
    if shape is not None:
        yield from found()


def components(edges: DataFrame, left: str, right: str, near: str | None = None) -> DataFrame:
    """(node, component) of an undirected graph, the least node of each component.

    Each partition first brings its edges to stars. A node that lies in several stars joins their centres: these edges between
    centres are all that is left to solve, by minimum labels with shortcuts, and no further round sees the other nodes.
    ``near``: a column whose equal values are likely to lie in one component; such edges go to one partition first, which
    changes no result. Every round is written to the session's checkpoint folder, so lineage stays short and lost executors do no harm.
    """
    pairs = edges if near is None else edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), near)
    pairs = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"))
    kind = pairs.schema["a"].dataType.simpleString()
    stars = pairs.mapInArrow(_stars, f"a {kind}, b {kind}")
    centres = materialize(stars.groupBy("a").agg(F.collect_set("b").alias("all")).select("a", F.array_min("all").alias("b"), "all"), "stars")
    between = centres.filter(F.size("all") > 1).select(F.col("b").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    solved = _least_labels(materialize(between.distinct(), "centres"))
    solved = solved.withColumnRenamed("node", "centre")
    return centres.select(F.col("a").alias("node"), F.col("b").alias("centre")).join(solved, "centre", "left").select("node", F.coalesce("component", "centre").alias("component"))


def _least_labels(edges: DataFrame) -> DataFrame:
    """(node, component) by minimum labels with shortcuts, a round of joins at a time."""
    cut = lambda df: materialize(df, "components")
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("component")).withColumnRenamed("a", "node"))
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        hop = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        new = cut(step.join(hop, "to", "left").select("node", "old", F.least("to", F.coalesce("beyond", "to")).alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def label_changes(labels: DataFrame, edges: DataFrame, left: str, right: str) -> DataFrame:
    """(component, becomes): the stored labels (node, component) that new edges join to a lesser one. Only the labels that the edges
    meet are walked, so the rounds are as large as the edges, not as the graph; an end without a label is a component of its own."""
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias("__at")), end, "left").withColumn(end, F.coalesce("__at", end)).drop("__at")
    return components(pairs, "a", "b").filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("becomes"))


def merge_components(labels: DataFrame, edges: DataFrame, left: str, right: str) -> DataFrame:
    """Labels after new edges, as ``components`` gives them of all edges old and new: the least node of each component.

    Edges that repeat, loops and edges inside a component change nothing; without new edges the labels come back as they are.
    """
    ends = edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.explode(F.array(left, right)).alias("node")).distinct()
    known = labels.select("node", "component").unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return known.join(label_changes(labels, edges, left, right), "component", "left").select("node", F.coalesce("becomes", "component").alias("component"))


def current_heads(nodes: DataFrame, group: list[str], order: Column, is_conflict: Column) -> DataFrame:
    """The newest node of each lineage group; a group whose head is in conflict is in conflict as a whole."""
    head = F.max_by(F.struct(F.col("fact_id"), is_conflict.alias("conflict")), order)
    return nodes.groupBy(*group).agg(head.alias("h"), F.count("*").alias("n_nodes")).select(*group, F.col("h.fact_id").alias("head_id"), F.when(F.col("h.conflict"), "conflict").otherwise("current").alias("state"), "n_nodes")


def snapshot_differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that only one side has or whose content differs, by a hash of the content."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    a, b = old.select(key, digest(old).alias("old_hash")), new.select(key, digest(new).alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(key, kind.alias("difference"))
