"""Registered queries that run as streams to the end of their input; their SQL is that of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators.tables import materialize, shared_folder
from threadline.plans.base import FACTORS, ORACLES, STATEMENTS, register, statements, table
from threadline.streaming import ordered_state, streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_stream(spark, f"{sf_dir}/events.parquet")


LOADS = 7


@register(ORACLES["backfill_versions"])
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of facts that arrive late: the table comes in LOADS loads, each of them of events of all times, and the stream stops
    after each and goes on from its log."""
    base = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    facts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.col("event_type").alias("family"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(FACTORS)).alias("factor_key"), F.col("event_id").alias("fact_id"),
        F.col("event_id").alias("event_order"), (F.pmod("event_id", F.lit(LOADS)) * 1_000_000_000 + F.col("event_id")).alias("ingest_seq"))
    with ordered_state.store_of_keys(spark):
        for n in range(LOADS):
            facts.filter(F.pmod("fact_id", F.lit(LOADS)) == n).write.mode("append").parquet(f"{base}/in")
            source = spark.readStream.schema(facts.schema).parquet(f"{base}/in")
            streams.resumed(ordered_state.late_versions(source, ["subject_id", "family", "factor_key"]), f"{base}/out", f"{base}/log")
    return spark.read.schema(ordered_state.VERSIONS).parquet(f"{base}/out")


@register(ORACLES["activity_sessions"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a gap of half an hour, as a stream sees them after its last batch."""
    events = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n_events"))
    out = streams.complete_of_batches(found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events"), shared_folder(spark))
    return out.select("user_id", "session_start", "session_end", "n_events")


@register("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same input committed three times, twice with one log and once with another: every event counts once."""
    base = f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}"
    for path, log in (("a", "x"), ("a", "x"), ("b", "y")):
        streams.commit_batches(event_stream(spark, sf_dir).select("event_id", "event_type"), f"{base}/out/part={path}", f"{base}/log-{log}", ["event_id"])
    rows = streams.committed_rows(spark, f"{base}/out", ["event_id"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


ARRIVALS = 5


@register(f"""WITH {STATEMENTS}, d AS (SELECT DISTINCT subject_id, session_no FROM st)
    SELECT d.subject_id, d.session_no, d.subject_id * 100000 + d.session_no AS question_id, count(*) AS n_facts, max(st.state_id) AS last_fact_id, array_to_string(list_sort(list_distinct(list(st.family))), ',') AS families, false AS late
    FROM d JOIN st ON st.subject_id = d.subject_id AND st.session_no <= d.session_no GROUP BY 1, 2""")
def stream_boundary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about each session of a subject, answered when the session is committed: the table comes in ARRIVALS parts, after each
    of which the stream stops and goes on from its log. Questions come a part before their session, or with it."""
    base = f"{shared_folder(spark)}/boundaries-{uuid.uuid4().hex}"
    rows = statements(spark, sf_dir)
    part = F.least(F.lit(ARRIVALS - 1), F.floor(F.col("session_no") * ARRIVALS / F.col("last_session"))).cast("int")
    facts = rows.join(F.broadcast(rows.agg(F.max("session_no").alias("last_session")))).withColumn("part", part)
    shape = ["subject_id", "session_no", "kind", "item_id", "family", "part"]
    said = facts.withColumns({"kind": F.lit("fact"), "item_id": F.col("state_id")}).select(*shape)
    ends = facts.groupBy("subject_id", "session_no").agg(F.max("part").alias("part")).withColumns({"kind": F.lit("commit"), "item_id": F.lit(None).cast("long"), "family": F.lit(None).cast("string")})
    asks = ends.withColumns({"kind": F.lit("question"), "item_id": F.col("subject_id") * 100000 + F.col("session_no"), "part": F.greatest(F.lit(0), F.col("part") - F.pmod("session_no", F.lit(2)).cast("int"))})
    came = materialize(said.union(ends.select(*shape)).union(asks.select(*shape)), "arrivals")
    for n in range(ARRIVALS):
        came.filter(F.col("part") == n).drop("part").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(came.drop("part").schema).parquet(f"{base}/in")
        streams.resumed(streams.answers_at_boundaries(source), f"{base}/out", f"{base}/log")
    return spark.read.schema(streams.BOUNDARY_ANSWERS).parquet(f"{base}/out")
