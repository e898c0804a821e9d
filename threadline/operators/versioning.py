"""Facts to versions: order, predecessors, operations, current values, also for facts that arrive late."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.operators.tables import numbered

KEY = ["subject_id", "family", "factor_key"]


def in_order_versions(facts: DataFrame) -> DataFrame:
    """Version number, predecessor, successor and chain of facts that arrive in event order: one shuffle by key."""
    w = W.partitionBy(*KEY).orderBy("ingest_seq")
    chain = F.collect_list(F.col("fact_id").cast("string")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return facts.select("*", F.row_number().over(w).cast("long").alias("version"), F.lag("fact_id").over(w).alias("predecessor_id"), F.lead("fact_id").over(w).alias("successor_id"), F.array_join(chain, ",").alias("version_chain"))


def operation(value: Column, prior: Column, tolerance: float = 0.0) -> Column:
    """ADD without a prior, NOOP for an equal value, else UPDATE."""
    return F.when(prior.isNull(), "ADD").when(F.abs(value - prior) <= tolerance, "NOOP").otherwise("UPDATE")


def fact_operations(facts: DataFrame, tolerance: float = 0.0) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("ingest_seq")
    return facts.select("*", operation(F.col("value"), F.lag("value").over(w), tolerance).alias("operation"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Insert facts, sorted by key and ingest order, into their key's list, which is kept in event order."""
    key, seen = None, []
    for rows in batches:
        prior, following, version = [], [], []
        for *now, order, ingest, fact in zip(*(rows[c] for c in (*KEY, "event_order", "ingest_seq", "fact_id")), strict=True):
            now = [None if pd.isna(x) else x for x in now]
            if now != key:
                key, seen = now, []
            at = bisect_right(seen, (order, ingest, fact))
            prior.append(seen[at - 1][2] if at else None)
            # What stands after is later in event order, or equal and ingested later, which cannot be yet.
            following.append(seen[at][2] if at < len(seen) else None)
            seen.insert(at, (order, ingest, fact))
            version.append(len(seen))
        yield rows.assign(version=version, predecessor_id=pd.array(prior, "Int64"), successor_id=pd.array(following, "Int64"))


def backfill_versions(facts: DataFrame) -> DataFrame:
    """Versions in ingest order where event order may differ: the predecessor is the latest earlier-ingested fact not
    after the new one, the successor the first earlier-ingested fact after it.

    Partitions hold whole keys in ingest order and are folded as a stream, with one key's list in memory at a time.
    """
    columns = ["fact_id", *KEY, "ingest_seq", "event_order"]
    kinds = ", ".join(f"`{c}` {facts.schema[c].dataType.simpleString()}" for c in columns)
    rows = facts.select(*columns).repartition(*KEY).sortWithinPartitions(*KEY, "ingest_seq", "fact_id")
    return rows.mapInPandas(_fold, f"{kinds}, version long, predecessor_id long, successor_id long")


def current_facts(facts: DataFrame) -> DataFrame:
    """The latest fact of each key by (has time, time, ingest): a map-side combined maximum, no window."""
    order = F.struct(F.col("event_ts").isNotNull(), F.col("event_ts"), F.col("ingest_seq"))
    return facts.groupBy(*KEY).agg(F.max_by(F.struct("fact_id", "value", "event_ts"), order).alias("f"), F.count("*").alias("n_versions")).select(*KEY, "f.*", "n_versions")


def keep_newest(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Per key the row of the greatest order; give an order without ties, or which of equals is kept is not defined."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def timeline(facts: DataFrame, subject: str) -> DataFrame:
    """Chronological place of each fact within its subject; unknown times first."""
    return numbered(facts, [subject], [F.col("event_ts").asc_nulls_first(), F.col("family"), F.col("fact_id")], "place")



def _fold_operations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert states, sorted by key and ingest order, into their key's list in event order, and classify each by its prior."""
    key, seen, kept = None, [], {}
    for batch in batches:
        out = {n: [] for n in ("version", "predecessor_id", "successor_id", "operation", "status", "conflicts_with")}
        rows = zip(*(batch.column(c).to_pylist() for c in FOLD_COLUMNS), strict=True)
        for now, state, order, ingest, source, polarity, same, correction, reconciled, opposite, resolved in rows:
            if now != key:
                key, seen, kept = now, [], {}
            at = bisect_right(seen, (order, ingest, state))
            prior = seen[at - 1][2] if at else None
            operation, conflict = "ADD", None
            if prior is not None:
                p_status, p_source, p_polarity, p_same, p_opposite, p_conflict = kept[prior]
                if p_status == "conflict":
                    operation = "RESOLVE" if correction or reconciled else "CONFLICT"
                elif correction and p_source == source:
                    operation = "SUPERSEDE"
                elif p_source != source and p_opposite != opposite:
                    operation = "CONFLICT"
                elif p_polarity != "negated" and (polarity == "negated" or resolved):
                    operation = "RESOLVE"
                elif p_polarity == polarity and p_same == same:
                    operation = "NOOP"
                else:
                    operation = "UPDATE"
                if operation == "CONFLICT":
                    conflict = p_conflict if p_status == "conflict" and p_conflict is not None else prior
            status = {"CONFLICT": "conflict", "RESOLVE": "resolved"}.get(operation, "active")
            for name, value in zip(out, (len(seen) + 1, prior, seen[at][2] if at < len(seen) else None, operation, status, conflict), strict=True):
                out[name].append(value)
            seen.insert(at, (order, ingest, state))
            kept[state] = status, source, polarity, same, opposite, conflict
        columns = [batch.column("state_id"), *[pa.array(out[n], pa.string() if n in ("operation", "status") else pa.int64()) for n in out]]
        yield pa.RecordBatch.from_arrays(columns, names=["state_id", *out])


FOLD_COLUMNS = ("key", "state_id", "event_order", "ingest_seq", "source_type", "polarity", "same", "correction", "reconciled", "opposite", "resolved")


def fold_states(states: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Versions, neighbours in time, operation and status of states that may arrive late.

    A state's prior is the latest earlier-ingested state of its key not after it in event order; a conflict stays until
    it is corrected or reconciled. Texts are reduced to flags and a hash before the shuffle; a partition holds whole keys
    in ingest order and is read as a stream, so a key costs memory for its states' flags only. Null keys are equal.
    """
    t = F.col(text)
    rows = states.select(
        F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).cast("binary")).alias("key"), "state_id", "event_order", "ingest_seq", "source_type", F.coalesce("polarity", F.lit("affirmed")).alias("polarity"),
        F.md5(F.concat_ws("#", rules.assertion(t), rules.quantity_signature(t), rules.status_signature(t)).cast("binary")).alias("same"), rules.is_correction(t).alias("correction"), rules.is_reconciliation(t).alias("reconciled"),
        rules.has(t, fx.OPPOSITE).alias("opposite"), rules.has(t, fx.RESOLVED).alias("resolved"),
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", "ingest_seq", "state_id")
    return ordered.mapInArrow(_fold_operations, "state_id long, version long, predecessor_id long, successor_id long, operation string, status string, conflicts_with long")


def state_transitions(folded: DataFrame) -> DataFrame:
    """Typed edges of versions: SUPERSEDE, CONFLICT and RESOLVE point back, the others forward; a late state is tied to its
    successor too, unless one of the two is in conflict."""
    prior = F.when(F.col("operation") == "CONFLICT", F.col("conflicts_with")).otherwise(F.col("predecessor_id"))
    names = F.create_map(*[F.lit(x) for pair in (("SUPERSEDE", "supersedes"), ("CONFLICT", "conflicts"), ("RESOLVE", "resolves"), ("NOOP", "persists"), ("UPDATE", "updates")) for x in pair])
    back = F.col("operation").isin("SUPERSEDE", "CONFLICT", "RESOLVE")
    own = folded.filter(prior.isNotNull()).select(F.when(back, F.col("state_id")).otherwise(prior).alias("from_id"), F.when(back, prior).otherwise(F.col("state_id")).alias("to_id"), names[F.col("operation")].alias("relation"), F.lit("version_transition").alias("source"))
    later = folded.select(F.col("state_id").alias("successor_id"), F.col("status").alias("later_status"))
    late = folded.filter("successor_id is not null and status <> 'conflict'").join(later, "successor_id").filter("later_status <> 'conflict'")
    late = late.select(F.col("state_id").alias("from_id"), F.col("successor_id").alias("to_id"), F.lit("updates").alias("relation"), F.lit("backfill_successor_transition").alias("source"))
    first = F.max("source")  # a version transition wins over a backfill of the same key
    return own.union(late).groupBy("from_id", "to_id", "relation").agg(first.alias("source"))
