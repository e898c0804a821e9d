"""Snapshots of a record's graph: rebuilt from the log, compared, fingerprinted, kept or let go; edges and labels without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as JSON with its keys in order and nulls kept, so a null differs from an empty text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows and a SHA-256 that does not depend on their order: the sums of four parts of the rows' hashes.

    Sums are combined on the map side, so a key of any size is never gathered in one place.
    """
    hashed = rows.select(*keys, row_hash([c for c in rows.columns if c not in keys]).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws(":", "n_rows", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def as_of(log: DataFrame, order: Column, limit: Column) -> DataFrame:
    """The rows that an append-only log held up to a point."""
    return log.filter(order <= limit)


def compare(stored: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of both sides and whether the two hold the same rows, repeats included."""
    a, b = fingerprint(stored, keys).withColumnsRenamed({"n_rows": "n_stored", "fingerprint": "stored"}), fingerprint(rebuilt, keys).withColumnsRenamed({"n_rows": "n_rebuilt", "fingerprint": "rebuilt"})
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("n_rebuilt", F.lit(0)).alias("n_rebuilt"), F.coalesce(F.col("stored") == F.col("rebuilt"), F.lit(False)).alias("equal"))


def first_of_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def label_repeats(labels: Column) -> tuple[Column, Column]:
    """Labels without repeats, and ``label@place<first`` of each repeat that was removed (places from 0)."""
    places = F.transform(labels, lambda x, i: F.struct(x.alias("label"), i.alias("at"), (F.array_position(labels, x) - 1).alias("first")))
    removed = F.transform(F.filter(places, lambda p: p["at"] > p["first"]), lambda p: F.concat(p["label"], F.lit("@"), p["at"].cast("string"), F.lit("<"), p["first"].cast("string")))
    return F.array_distinct(labels), removed


def scope_merge(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and family the strongest priority of (family, weight) rows."""
    return scopes.groupBy(*keys, "family").agg(F.max("weight").alias("weight"))
