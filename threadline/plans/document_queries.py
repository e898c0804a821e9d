"""Registered queries over JSON outputs, clauses, transcripts and quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import rules
from threadline.operators import documents as dc
from threadline.plans.base import STATEMENTS, matches, quoted, register, statements, table

ITEM = "concat('{\"text\": \"', replace(text, '\"', ''), '\", \"n\": ', CAST(state_id % 9 AS VARCHAR(9)), '}')"
CUT = f"concat('{{\"evidence\": [', {ITEM}, ', {{\"text\": \"b }} }}\", \"n\": 2}}', CASE WHEN state_id % 3 = 0 THEN ', {{\"text\": \"cut' ELSE ']}}' END)"


@register(f"WITH {STATEMENTS} SELECT state_id, 2 AS n_objects, state_id % 3 = 0 AS repaired FROM st")
def recovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of objects, a third of them cut off in the middle of an object."""
    rows = statements(spark, sf_dir).select("state_id", F.expr(CUT).alias("raw"))
    return dc.recover(rows, "state_id", "raw").select("state_id", F.size("objects").alias("n_objects"), "repaired")


SHAPES = f"CASE state_id % 4 WHEN 0 THEN concat('[', {ITEM}, ']') WHEN 1 THEN concat('{{\"evidence\": [', {ITEM}, ']}}') WHEN 2 THEN concat('{{\"atomic_evidence\": [', {ITEM}, ', {{\"statement\": \"s\"}}]}}') ELSE '{{\"other\": 1}}' END"


@register(f"WITH {STATEMENTS} SELECT state_id, CASE state_id % 4 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 1 END AS n_items, CASE WHEN state_id % 4 < 3 THEN replace(text, '\"', '') END AS first_text FROM st")
def output_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of outputs in the shapes that models give them."""
    rows = statements(spark, sf_dir).select("state_id", dc.envelope(F.expr(SHAPES)).alias("items"))
    return rows.select("state_id", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), F.coalesce(F.get("items", F.lit(0))["text"], F.get("items", F.lit(0))["statement"]).alias("first_text"))


@register(f"""WITH {STATEMENTS}, j AS (SELECT *, '{{"family":"' || family || '","polarity":"' || polarity || '","session_no":' || session_no || ',"status":"' || status || '"}}' AS js FROM st), p AS (SELECT *, lag(js) OVER (PARTITION BY subject_id ORDER BY state_id) AS before FROM j)
    SELECT state_id, js AS json, before IS NULL OR before <> js AS changed, length(js) AS n_out, coalesce(length(before), 4) AS n_in FROM p""")
def step_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with keys in order, and whether each differs from the one before it of its subject."""
    from pyspark.sql import Window as W

    rows = statements(spark, sf_dir).withColumn("json", dc.stable_json(["status", "family", "session_no", "polarity"]))
    before = F.lag("json").over(W.partitionBy("subject_id").orderBy("state_id"))
    return rows.select("state_id", "json", before.alias("b")).select("state_id", "json", (F.col("b").isNull() | (F.col("b") != F.col("json"))).alias("changed"), F.length("json").cast("long").alias("n_out"), F.coalesce(F.length("b"), F.lit(4)).cast("long").alias("n_in"))


@register("SELECT n_regionkey, sha256('[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']') AS manifest, count(*) AS n FROM nation GROUP BY 1")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of the frozen set of ids of each group, whatever their order."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("n_nationkey"))), 256).alias("manifest"), F.count("*").alias("n"))


@register(f"""WITH {STATEMENTS}, s AS (SELECT state_id, text, unnest(regexp_extract_all(text, {quoted(dc.SENTENCE)})) AS sentence, unnest(range(len(regexp_extract_all(text, {quoted(dc.SENTENCE)})))) AS i FROM st), c AS (SELECT state_id, text, i, trim(unnest(string_split_regex(trim(sentence), {quoted(dc.CLAUSE_BORDER)}))) AS clause, unnest(range(len(string_split_regex(trim(sentence), {quoted(dc.CLAUSE_BORDER)})))) AS j FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY i, j) - 1 AS nth FROM c WHERE length(clause) > 1) SELECT state_id, nth, clause FROM k""")
def statement_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.clauses(statements(spark, sf_dir), "state_id", "text").select("state_id", "nth", "clause")


@register(f"""WITH {STATEMENTS}, k AS (SELECT state_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}|[0-9]+')) AS word FROM st) SELECT word, count(*) AS n, min(state_id) AS first_id FROM k GROUP BY 1""")
def statement_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir).select("state_id", F.explode(rules.found(F.lower("text"), r"[a-z][a-z0-9-]{2,}|[0-9]+")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.min("state_id").alias("first_id"))


@register(f"""WITH {STATEMENTS} SELECT state_id, 'Task: ' || task || chr(10) || 'Session ' || session_no || chr(10) || source_type || ': ' || text AS question FROM st""")
def template_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and a turn laid out as one question."""
    return statements(spark, sf_dir).select("state_id", F.format_string("Task: %s\nSession %d\n%s: %s", "task", "session_no", "source_type", "text").alias("question"))


@register()
def clause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of all turns with their places; each place holds its clause, which the tests check."""
    return dc.clauses(table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", "text")


@register()
def quote_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations of documents, some with other spacing or a changed letter, found again in the whole documents."""
    quote = F.substring("text", F.greatest(F.floor(F.length("text") / 3), F.lit(1)).cast("int"), F.lit(60))
    i = F.col("doc_id")
    changed = F.when(i % 3 == 0, quote).when(i % 3 == 1, F.upper(F.regexp_replace(quote, " ", "  "))).otherwise(F.concat(F.substring(quote, F.lit(1), F.lit(20)), F.lit("q"), F.substring(quote, F.lit(22), F.lit(60))))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", changed.alias("quote"))
    return dc.aligned_quotes(rows, "doc_id", "text", "quote")
