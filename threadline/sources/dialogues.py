"""Readers of nested JSON dialogues and question files; every file is one row until its sessions are exploded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALOGUES = "sessions ARRAY<STRUCT<session_id: STRING, noise_id: STRING, event_info: STRUCT<date: STRING>, messages: ARRAY<STRUCT<role: STRING, turn: BIGINT, content: STRING>>>>"
QUERIES = "queries ARRAY<STRUCT<query_id: STRING, query_type: STRING, session_id: STRING, question: STRING, answers: ARRAY<STRUCT<content: STRING, is_correct: BOOLEAN>>>>"
TASKS = "task_id STRING, task_type STRING, case_id STRING, question STRING, reference_answer STRING"


def _subject(pattern: str):
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def read_dialogues(spark: SparkSession, path: str, subject_pattern: str = r"persona_([^/]+)/") -> DataFrame:
    """Turns: (subject_id, episode_id, position, is_noise, event_time, turn, role, text), in file order within an episode."""
    files = spark.read.schema(DIALOGUES).option("multiLine", True).json(path).withColumn("subject_id", _subject(subject_pattern))
    sessions = files.select("subject_id", F.posexplode("sessions").alias("position", "s"))
    turns = sessions.select("subject_id", "position", "s", F.posexplode("s.messages").alias("place", "m"))
    episode = F.coalesce(F.col("s.session_id"), F.col("s.noise_id"))
    return turns.select("subject_id", episode.alias("episode_id"), "position", F.col("s.noise_id").isNotNull().alias("is_noise"), F.col("s.event_info.date").alias("event_time"), F.coalesce("m.turn", F.col("place").cast("long")).alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def read_queries(spark: SparkSession, path: str, subject_pattern: str = r"persona_([^/]+)/") -> DataFrame:
    """Cases: (subject_id, query_id, query_type, session_id, question, gold): the correct answers are the gold."""
    files = spark.read.schema(QUERIES).option("multiLine", True).json(path).withColumn("subject_id", _subject(subject_pattern))
    rows = files.select("subject_id", F.explode("queries").alias("q"))
    gold = F.transform(F.filter("q.answers", lambda a: a["is_correct"]), lambda a: a["content"])
    return rows.select("subject_id", "q.query_id", "q.query_type", "q.session_id", "q.question", gold.alias("gold"))


def read_tasks(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """Rows of several task folders; a task without a type gets its folder's."""
    out = None
    for kind, path in folders.items():
        rows = spark.read.schema(TASKS).option("multiLine", True).json(path).withColumn("task_type", F.coalesce("task_type", F.lit(kind)))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no folders given")
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


ADMISSIONS = "admissions ARRAY<STRUCT<hadm_id: STRING, admission_start: STRING, admission_end: STRING, conversation_lines: ARRAY<STRUCT<speaker: STRING, turn_number: STRING, time: STRING, text: STRING>>>>"
QUESTIONS = "qas ARRAY<STRUCT<qa_id: STRING, question_type: STRING, question: STRING, answer: STRING, scope: STRING>>"
FOLDER = r"([^/]+)/[^/]+$"


def read_admissions(spark: SparkSession, path: str) -> DataFrame:
    """Turns: (subject_id, episode_id, position, turn, event_time, source_type, text) of admissions; who is not the patient is a doctor."""
    files = spark.read.schema(ADMISSIONS).option("multiLine", True).json(path).withColumn("subject_id", _subject(FOLDER))
    stays = files.select("subject_id", F.posexplode("admissions").alias("position", "a"))
    lines = stays.select("subject_id", "position", "a.hadm_id", F.explode("a.conversation_lines").alias("l"))
    source = F.when(F.lower("l.speaker") == "patient", "patient").otherwise("doctor")
    return lines.select("subject_id", F.col("hadm_id").alias("episode_id"), "position", F.col("l.turn_number").alias("turn"), F.col("l.time").alias("event_time"), source.alias("source_type"), F.col("l.text").alias("text"))


def read_admission_questions(spark: SparkSession, path: str, mode: str = "all", question_type: str | None = None) -> DataFrame:
    """Cases: (subject_id, query_id, task, question, gold, scope) of one scope and type, or of all."""
    files = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).withColumn("subject_id", _subject(FOLDER))
    rows = files.select("subject_id", F.explode("qas").alias("q"))
    scope = "single_admission" if "single" in mode.lower() else "cross_admission" if "cross" in mode.lower() else None
    if scope:
        rows = rows.filter(F.col("q.scope") == scope)
    if question_type:
        rows = rows.filter(F.col("q.question_type") == question_type)
    return rows.select("subject_id", F.col("q.qa_id").alias("query_id"), F.col("q.question_type").alias("task"), "q.question", F.array("q.answer").alias("gold"), "q.scope")


def catalog(spark: SparkSession, path: str, subject_pattern: str) -> DataFrame:
    """(subject_id, n_files, n_bytes) of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select(F.regexp_extract("path", subject_pattern, 1).alias("subject_id"), "length").filter("subject_id <> ''").groupBy("subject_id").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def with_rubrics(spark: SparkSession, tasks: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Tasks with the rubric text of their type; a handful of texts that go to all tasks."""
    texts = [read_texts(spark, path).select(F.lit(kind).alias("task_type"), F.col("text").alias("rubric")) for kind, path in folders.items()]
    rubrics = texts[0]
    for t in texts[1:]:
        rubrics = rubrics.union(t)
    return tasks.join(F.broadcast(rubrics), "task_type", "left")
