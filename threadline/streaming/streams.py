"""Incremental forms: sessions by gaps, versions of facts, rolling progress. Each is driven to the end of its input."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process all that is there and read back what was written to the shared folder."""
    spark = stream.sparkSession
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def latest_of_batches(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """An update-mode aggregation through foreachBatch: each batch is written under its number, so a batch that runs
    again overwrites itself, and the latest row of each key is what counts."""
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{base}/out")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream; the schema is read from its files. A single file is matched by its own name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of activity without a gap, in append mode after the watermark."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def progress(stream: DataFrame, key: str, value: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def counted_versions(stream: DataFrame, keys: list[str], shape: str, step: Callable[[pd.DataFrame, int], pd.DataFrame]) -> DataFrame:
    """Number the facts of a key across batches; the state is the count so far."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True)
        state.update((seen + len(rows),))
        yield step(rows, seen)

    return stream.groupBy(*keys).applyInPandasWithState(run, shape, "seen long", "append", GroupStateTimeout.NoTimeout)


def complete_of_batches(stream: DataFrame, folder: str) -> DataFrame:
    """A whole result after each batch: the last batch's."""
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{base}/out")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def commit_batches(stream: DataFrame, path: str, log: str, keys: list[str]) -> None:
    """Each batch under its number, so one that runs again replaces itself; repeats of a key within a batch are dropped."""
    write = lambda batch, number: batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def committed_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What was committed, each key once, from the first batch that had it."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def with_feedback(turns: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies come back as the next turns of their record."""
    return turns.unionByName(replies, allowMissingColumns=True)


def resumed(stream: DataFrame, out: str, log: str) -> None:
    """Process what has come since the last call with the same ``log``, and append it to ``out``."""
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


BOUNDARY_ANSWERS = "subject_id long, session_no long, question_id long, n_facts long, last_fact_id long, families string, late boolean"


#: Groups of subjects whose state is kept together; a stream that goes on from its log needs the number that it began with.
SUBJECT_BUCKETS = 1 << 10


def answers_at_boundaries(stream: DataFrame) -> DataFrame:
    """Questions of a session, answered when the session is committed, from the facts of all sessions up to it.

    ``stream``: subject_id, session_no, kind (fact, question, commit), item_id, family. The facts of a session come before its
    commit or with it, its questions too; sessions of a subject are committed in order. A question waits in its subject's state;
    facts are folded there into the sum of the committed sessions and one sum for each session still open, so the state grows with
    open sessions and waiting questions, not with the history. A fact of a committed session counts from the next commit on; a
    question that comes after its commit is given back as ``late``, with nulls, for the batch form to answer. Subjects are dealt over
    SUBJECT_BUCKETS groups by hash, as a call for each of many small subjects costs more than its rows.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        subjects = json.loads(state.get[0]) if state.exists else {}
        came: dict[int | None, list[tuple]] = {}
        for frame in frames:
            columns = [frame[c].where(frame[c].notna(), None).tolist() for c in shape]
            for subject, *row in zip(*columns, strict=True):
                came.setdefault(None if subject is None else int(subject), []).append(tuple(row))
        out = []
        for subject, rows in came.items():
            name = "" if subject is None else str(subject)
            answers, subjects[name] = _of_subject(rows, subjects.get(name, [[0, None, []], None, {}, {}]))
            out += [(subject, *answer) for answer in answers]
        state.update((json.dumps(subjects),))
        made = pd.DataFrame(out, columns=["subject_id", "session_no", "question_id", "n_facts", "last_fact_id", "families", "late"], dtype=object)
        yield made.astype({**dict.fromkeys(("subject_id", "session_no", "question_id", "n_facts", "last_fact_id"), "Int64"), "late": "bool"})

    # As texts, since numbers beside nulls would come as floating point.
    shape = ("subject_id", "session_no", "kind", "item_id", "family")
    buckets = stream.select(F.pmod(F.xxhash64("subject_id"), F.lit(SUBJECT_BUCKETS)).alias("bucket"), *[F.col(c).cast("string").alias(c) for c in shape])
    return buckets.groupBy("bucket").applyInPandasWithState(run, BOUNDARY_ANSWERS, "subjects string", "append", GroupStateTimeout.NoTimeout)


def _of_subject(rows: list[tuple], held: list) -> tuple[list[tuple], list]:
    """Answers of one subject, and its state after the rows (session_no, kind, item_id, family): the sum of the committed sessions,
    the last of them, the sums of open sessions and the questions that wait. A row without a session counts for none."""
    done, shut, sums, asked = held[0], held[1], {int(k): v for k, v in held[2].items()}, {int(k): v for k, v in held[3].items()}
    kinds: dict[str, list[tuple]] = {"fact": [], "question": [], "commit": []}
    for session, kind, item, family in rows:
        if session is not None and kind in kinds:
            kinds[kind].append((int(session), item, family))
    out = []
    for session, item, family in kinds["fact"]:
        total = sums.setdefault(session, [0, None, []])
        total[0] += 1
        total[1] = int(item) if total[1] is None else max(total[1], int(item))
        if family is not None and family not in total[2]:
            total[2] = sorted([*total[2], family])
    for session, item, _ in kinds["question"]:
        if shut is not None and session <= shut:
            out.append((session, int(item), None, None, None, True))
        else:
            asked.setdefault(session, []).append(int(item))
    for session in sorted({s for s, _, _ in kinds["commit"]}):
        for ready in sorted(x for x in sums if x <= session):
            done = merged(done, sums.pop(ready))
        for now in sorted(x for x in asked if x <= session):
            out += [(now, i, done[0], done[1], ",".join(done[2]), False) for i in asked.pop(now)]
        shut = session if shut is None else max(shut, session)
    return out, [done, shut, sums, asked]


def merged(a: list, b: list) -> list:
    """Sums of facts: how many, the greatest id, the families."""
    return [a[0] + b[0], max((x for x in (a[1], b[1]) if x is not None), default=None), sorted({*a[2], *b[2]})]
