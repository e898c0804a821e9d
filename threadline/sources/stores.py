"""Tables that a record is kept in: commits, upserts, snapshots, listings, exports. All are Parquet or JSON in a shared folder."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.operators import quality

#: Folders that subjects are dealt to, so a scan of one subject reads one of them.
SUBJECT_BUCKETS = 64


def bucket(subject: str = "subject_id") -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(SUBJECT_BUCKETS)).cast("int")


MARKERS = "commit string, at long, tables array<string>"


def commit(tables: dict[str, tuple[DataFrame, Column]], folder: str) -> str:
    """Append rows of several tables as one unit. Each table is written under the commit's number, what was written is checked (a
    column of errors, empty if there are none), and the commit counts from when its marker is there. Returns the number.

    A frame is evaluated once, so what is checked is what is read later. After an error the rows stay without a marker, unseen.
    """
    number = uuid.uuid4().hex
    spark = None
    for name, (rows, errors) in tables.items():
        spark, path = rows.sparkSession, f"{folder}/{name}/commit={number}"
        rows.withColumn("subject_bucket", bucket()).write.partitionBy("subject_bucket").parquet(path)
        bad = spark.read.schema(rows.schema).parquet(path).select(errors.alias("e")).filter("e <> ''").limit(1).collect()
        if bad:
            raise ValueError(f"{name}: {bad[0]['e']}")
    if spark is not None:
        spark.createDataFrame([(number, time.time_ns(), sorted(tables))], MARKERS).coalesce(1).write.mode("append").json(f"{folder}/commits")
    return number


def markers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MARKERS).json(f"{folder}/commits").select("commit", "at")


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of all commits whose marker is there; what a broken commit left is not seen."""
    return spark.read.parquet(f"{folder}/{name}").join(markers(spark, folder), "commit", "left_semi").drop("commit", "subject_bucket")


def of_subject(spark: SparkSession, folder: str, name: str, subject: int) -> DataFrame:
    """One subject's committed rows in the order of their commits; other subjects' folders are not read."""
    number = spark.range(1).select(bucket_of(subject)).first()[0]
    rows = spark.read.parquet(f"{folder}/{name}").filter((F.col("subject_bucket") == number) & (F.col("subject_id") == subject))
    return rows.join(markers(spark, folder), "commit").orderBy("at", "commit").drop("commit", "at", "subject_bucket")


def bucket_of(subject: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(subject).cast("long")), F.lit(SUBJECT_BUCKETS)).cast("int")


def in_request_order(rows: DataFrame, key: str, wanted: DataFrame, ids: str) -> DataFrame:
    """Rows for an array of ids, in the order of the request, each once."""
    places = wanted.select(F.posexplode(ids).alias("place", key)).groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(places, key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the newest row of both; of equals the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("__new").desc())
    return both.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth", "__new")


def save_snapshot(rows: DataFrame, folder: str, subject: int, session: int, key: str) -> None:
    """A subject's rows under their session and content key; saving the same one again overwrites it."""
    rows.write.mode("overwrite").parquet(f"{folder}/snapshots/subject={subject}/session={session}/key={key}")


def restore_snapshot(spark: SparkSession, folder: str, subject: int, session: int, key: str, evidence: DataFrame) -> DataFrame:
    """The rows of a snapshot, if every evidence id that they refer to is there."""
    rows = spark.read.parquet(f"{folder}/snapshots/subject={subject}/session={session}/key={key}")
    missing = rows.select(F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("the snapshot refers to evidence that is not there")
    return rows


def newest(rows: DataFrame, columns: list[str], order: str, limit: int) -> DataFrame:
    """A listing: light columns of the newest rows."""
    return rows.select(*columns).orderBy(F.desc(order)).limit(limit)


def error_cases(scores: DataFrame, wrong: Column, states: DataFrame, observations: DataFrame) -> DataFrame:
    """One nested row for each wrong answer: its states and the observations of its episodes."""
    bad = scores.filter(wrong)
    held = bad.select("answer_id", "subject_id").join(states.select("subject_id", F.struct(*[c for c in states.columns if c != "subject_id"]).alias("state")), "subject_id").groupBy("answer_id").agg(F.array_sort(F.collect_list("state")).alias("states"))
    seen = bad.select("answer_id", "episode_id").join(observations.select("episode_id", F.struct(*[c for c in observations.columns if c != "episode_id"]).alias("observation")), "episode_id").groupBy("answer_id").agg(F.array_sort(F.collect_list("observation")).alias("observations"))
    return bad.join(held, "answer_id", "left").join(seen, "answer_id", "left")


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, secrets redacted first."""
    rows.select(quality.redact_json(F.to_json(F.struct(*rows.columns))).alias("value")).write.mode("overwrite").text(path)


def run_bundles(runs: DataFrame, traces: DataFrame) -> DataFrame:
    """(run_id, bundle): each run with its traces in order, as one JSON text."""
    steps = traces.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in traces.columns if c not in ("run_id", "ordinal")]))).alias("traces"))
    return runs.join(steps, "run_id", "left").select("run_id", F.to_json(F.struct(*runs.columns, "traces")).alias("bundle"))
