"""Registered queries that check, summarise and compare records, and expand the states that a question has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import quality, snapshots
from threadline.operators import states as st
from threadline.plans.base import STATEMENTS, register, statements, table
from threadline.plans.rule_queries import FOLLOWED
from threadline.plans.state_queries import LINKS, PAIRS, RELATION, evidence_of, pairs_of

# ---- checks --------------------------------------------------------------------------------------------------------


def _errors(*checks: tuple[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {bad} THEN '{message}' END" for message, bad in checks) + ")"


def _empty(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c} must be a non-empty string", f"{c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''") for c in columns]


PAYLOAD = "concat('{\"subject_id\": \"', CASE WHEN state_id % 15 = 0 THEN ' ' ELSE CAST(subject_id AS VARCHAR(20)) END, '\", \"source_type\": \"', CASE state_id % 11 WHEN 0 THEN 'gold_answer' WHEN 1 THEN 'other' ELSE source_type END, '\", \"episode_id\": \"session-', CAST(session_no AS VARCHAR(20)), '\"', CASE WHEN state_id % 9 = 0 THEN '' ELSE ', \"turn_id\": \"1\"' END, ', \"event_time\": \"', CASE state_id % 6 WHEN 0 THEN 'some day' WHEN 1 THEN '' ELSE '2024-03-05' END, '\", \"raw_text\": \"said\"', CASE WHEN state_id % 8 = 0 THEN ', \"score\": 1, \"gold\": \"x\"' ELSE '' END, '}')"


@register(f"""WITH {STATEMENTS} SELECT state_id, concat_ws(';', CASE WHEN state_id % 15 = 0 THEN 'subject_id must be a non-empty string' END, CASE WHEN state_id % 9 = 0 THEN 'turn_id must be a non-empty string' END, CASE WHEN state_id % 11 IN (0, 1) THEN 'source_type is unknown' END,
    CASE WHEN state_id % 11 = 0 THEN 'gold_answer is not a core observation source' END, CASE WHEN state_id % 6 = 0 THEN 'event_time must be ISO-compatible' END, CASE WHEN state_id % 8 = 0 THEN 'unsupported observation fields: gold, score' END) AS errors FROM st""")
def observation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as JSON with what is wrong with them, unknown fields included."""
    return statements(spark, sf_dir).select("state_id", F.expr(PAYLOAD).alias("payload")).select("state_id", quality.payload_errors("payload").alias("errors"))


EVIDENCE_ROW = {"evidence_id": "evidence_id", "subject_id": "subject_id", "text": "CASE WHEN state_id % 14 = 0 THEN '  ' ELSE text END", "source_type": "CASE WHEN state_id % 10 = 0 THEN 'derived' ELSE source_type END", "polarity": "CASE WHEN state_id % 12 = 0 THEN 'maybe' ELSE polarity END", "certainty": "CAST(CASE WHEN state_id % 16 = 0 THEN 1.5 ELSE certainty END AS DOUBLE)", "span_start": "CASE WHEN state_id % 3 = 0 THEN state_id % 5 - 1 END", "span_end": "CASE WHEN state_id % 3 = 0 THEN state_id % 4 END"}


@register(f"WITH {STATEMENTS}, e AS (SELECT state_id, {', '.join(f'{x} AS {n}' for n, x in EVIDENCE_ROW.items())} FROM st) SELECT state_id, " + _errors(*_empty("evidence_id", "subject_id", "text", "source_type"), ("invalid evidence source_type", f"source_type NOT IN {quality.SOURCES}"), ("invalid polarity", f"polarity NOT IN {quality.POLARITIES}"), ("certainty must be 0..1", "NOT certainty BETWEEN 0 AND 1"), ("span must be null or integer [start,end) offsets", "span_start IS NOT NULL AND (span_start < 0 OR NOT coalesce(span_end > span_start, false))")) + " AS errors FROM e")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).selectExpr("state_id", *[f"{x} AS {n}" for n, x in EVIDENCE_ROW.items()]).select("state_id", quality.evidence_errors().alias("errors"))


STATE_ROW = {"value": "CASE WHEN state_id % 14 = 0 THEN '' ELSE text END", "family": "CASE WHEN state_id % 10 = 0 THEN 'ZZ' ELSE family END"}


@register(f"WITH {STATEMENTS}, e AS (SELECT state_id, subject_id, status, {', '.join(f'{x} AS {n}' for n, x in STATE_ROW.items())} FROM st) SELECT state_id, " + _errors(*_empty("state_id", "subject_id", "family", "value", "status"), ("invalid state family", f"family NOT IN {quality.FAMILIES}"), ("state requires evidence_ids", "state_id % 13 = 0"), ("version_chain must be an array", "state_id % 17 = 0")) + " AS errors FROM e")
def state_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir).selectExpr("state_id", "subject_id", "status", *[f"{x} AS {n}" for n, x in STATE_ROW.items()], "CASE WHEN state_id % 13 = 0 THEN cast(array() AS array<bigint>) ELSE array(evidence_id) END AS evidence_ids", "CASE WHEN state_id % 17 <> 0 THEN array(state_id) END AS version_chain")
    return rows.select("state_id", quality.state_errors().alias("errors"))


@register(f"WITH {STATEMENTS}, e AS (SELECT state_id, CASE WHEN state_id % 6 = 0 THEN 'MERGE' ELSE 'UPDATE' END AS operation, CASE WHEN state_id % 10 = 0 THEN 'ZZ' ELSE family END AS family, CASE WHEN state_id % 21 <> 0 THEN evidence_id END AS evidence_id FROM st) SELECT state_id, " + _errors(("invalid operation", f"operation NOT IN {quality.OPERATIONS}"), ("invalid family", f"family NOT IN {quality.FAMILIES}"), *_empty("evidence_id")) + " AS errors FROM e")
def delta_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir).selectExpr("state_id", "CASE WHEN state_id % 6 = 0 THEN 'MERGE' ELSE 'UPDATE' END AS operation", "CASE WHEN state_id % 10 = 0 THEN 'ZZ' ELSE family END AS family", "CASE WHEN state_id % 21 <> 0 THEN evidence_id END AS evidence_id")
    return rows.select("state_id", quality.delta_errors().alias("errors"))


EDGE_ROW = {
    "edge_id": "state_id", "subject_id": "subject_id", "from_id": "CASE WHEN state_id % 22 = 0 THEN state_id ELSE from_id END", "to_id": "state_id", "edge_family": "CASE WHEN state_id % 10 = 0 THEN 'other' ELSE 'temporal' END", "relation": "CASE WHEN state_id % 12 = 0 THEN 'causes' ELSE 'updates' END", "status": "CASE WHEN state_id % 14 = 0 THEN 'open' ELSE 'verified' END",
    "support": "CASE WHEN state_id % 16 = 0 THEN 'guess' ELSE 'structural' END", "confidence": "CAST(CASE WHEN state_id % 18 = 0 THEN -1 ELSE 1 END AS DOUBLE)", "persistent": "state_id % 20 <> 0", "causal": "state_id % 24 = 0",
}


@register(f"WITH {STATEMENTS}, {PAIRS}, e AS (SELECT {', '.join(f'{x} AS {n}' for n, x in EDGE_ROW.items())}, state_id % 26 = 0 AS bare FROM pairs) SELECT edge_id, " + _errors(
    *_empty("edge_id", "subject_id", "from_id", "to_id", "edge_family", "relation", "status"), ("invalid edge_family", f"edge_family NOT IN {quality.EDGE_FAMILIES}"), ("invalid relation_type", f"relation NOT IN {quality.RELATIONS}"), ("invalid edge status", f"status NOT IN {quality.EDGE_STATUSES}"), ("invalid support_kind", f"support NOT IN {quality.SUPPORTS}"),
    ("graph edge cannot be a self-loop", "from_id = to_id"), ("graph edge requires evidence_ids", "bare"), ("confidence must be 0..1", "NOT confidence BETWEEN 0 AND 1"), ("patient graph edge must be persistent", "NOT persistent"), ("patient graph edge cannot claim causality", "causal")) + " AS errors FROM e")
def graph_edge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    rows = rows.select("*", F.lag("state_id").over(W.partitionBy("subject_id").orderBy("state_id")).alias("from_id"))
    return rows.selectExpr(*[f"{x} AS {n}" for n, x in EDGE_ROW.items()], "CASE WHEN state_id % 26 = 0 THEN cast(array() AS array<bigint>) ELSE array(evidence_id) END AS evidence_ids").select("edge_id", quality.graph_edge_errors().alias("errors"))


@register(f"WITH {STATEMENTS} SELECT state_id, " + _errors(("invalid action type", "state_id % 9 = 0"), ("required_evidence_ids must be array", "state_id % 11 = 0"), ("content constraints must be arrays", "state_id % 13 = 0 OR state_id % 15 = 0"), ("explanation must be a non-empty string", "state_id % 7 = 0")) + " AS errors FROM st")
def action_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = lambda n: f"CASE WHEN state_id % {n} <> 0 THEN array(text) END"
    rows = statements(spark, sf_dir).selectExpr("state_id", "CASE WHEN state_id % 9 = 0 THEN 'WAIT' ELSE 'ASK' END AS type", f"{lists(11)} AS required_evidence_ids", f"{lists(13)} AS required_content", f"{lists(15)} AS forbidden_content", "CASE WHEN state_id % 7 = 0 THEN ' ' ELSE 'why' END AS explanation")
    return rows.select("state_id", quality.action_errors().alias("errors"))


SECRET = "concat('{\"a\": {\"Token\": ', CASE state_id % 5 WHEN 0 THEN '12345' WHEN 1 THEN '[\"x\", \"y\"]' WHEN 2 THEN '{\"k\": 1}' WHEN 3 THEN 'null' ELSE '\"s\\\\\"t\"' END, ', \"n\": ', CAST(state_id AS VARCHAR(20)), '}, \"api_key\": \"z\", \"b\": [1, {\"secret\": true}]}')"


@register(f"""WITH {STATEMENTS} SELECT state_id, '{{"a": {{"Token": "[REDACTED]", "n": ' || state_id || '}}, "api_key": "[REDACTED]", "b": [1, {{"secret": "[REDACTED]"}}]}}' AS payload FROM st""")
def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every kind of value, at any depth."""
    return statements(spark, sf_dir).select("state_id", quality.redact_json(F.expr(SECRET)).alias("payload"))


@register(f"""WITH {STATEMENTS}, c AS (SELECT session_no, CASE WHEN state_id % 50 = 0 THEN NULL ELSE CASE WHEN session_no % 3 = 0 THEN 1 ELSE subject_id END END AS s FROM st)
    SELECT session_no, count(DISTINCT s) AS n_subjects, count(*) FILTER (s IS NULL) AS n_missing, count(DISTINCT s) = 1 AND count(*) FILTER (s IS NULL) = 0 AS single FROM c GROUP BY 1""")
def single_subject_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts (here sessions) whose rows must all be of one subject."""
    owner = F.expr("CASE WHEN state_id % 50 = 0 THEN NULL WHEN session_no % 3 = 0 THEN 1 ELSE subject_id END")
    rows = statements(spark, sf_dir).select("session_no", owner.alias("s"))
    out = rows.groupBy("session_no").agg(F.countDistinct("s").alias("n_subjects"), F.count_if(F.col("s").isNull()).alias("n_missing"))
    return out.select("*", ((F.col("n_subjects") == 1) & (F.col("n_missing") == 0)).alias("single"))


SCOPE = "CASE state_id % 4 WHEN 0 THEN 'Single admission' WHEN 1 THEN 'cross-admission' WHEN 2 THEN ' ALL ' ELSE NULL END"


@register(f"""WITH {STATEMENTS}, m AS (SELECT state_id, task, subject_id, regexp_replace(lower(trim(coalesce({SCOPE}, 'all'))), '[\\s-]+', '_', 'g') AS mode FROM st), n AS (SELECT *, CASE WHEN contains(mode, 'single') THEN 'single_admission' WHEN contains(mode, 'cross') THEN 'cross_admission' ELSE 'all' END AS scope FROM m)
    SELECT scope, task, count(*) AS n, count(DISTINCT subject_id) AS n_subjects FROM n WHERE task <> 'generic' GROUP BY 1, 2""")
def scope_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by their scope, however it is written, and type."""
    mode = F.regexp_replace(F.lower(F.trim(F.coalesce(F.expr(SCOPE), F.lit("all")))), r"[\s-]+", "_")
    scope = F.when(F.contains(mode, F.lit("single")), "single_admission").when(F.contains(mode, F.lit("cross")), "cross_admission").otherwise("all")
    return statements(spark, sf_dir).withColumn("scope", scope).filter("task <> 'generic'").groupBy("scope", "task").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


# ---- reports -------------------------------------------------------------------------------------------------------


@register(f"""WITH {LINKS}, {PAIRS}, t AS (SELECT subject_id, count(*) AS n FROM pairs WHERE from_id IS NOT NULL GROUP BY 1), c AS (SELECT a.subject_id, count(DISTINCT (a.state_id, b.state_id)) AS n FROM links a JOIN links b ON a.evidence_id = b.evidence_id AND a.subject_id = b.subject_id AND a.state_id < b.state_id GROUP BY 1), n AS (SELECT subject_id, count(*) AS n, max(ingest_seq) AS last_seq FROM st GROUP BY 1)
    SELECT subject_id, n.n AS n_nodes, coalesce(t.n, 0) + coalesce(c.n, 0) AS n_edges, coalesce(t.n, 0) AS n_temporal, coalesce(c.n, 0) AS n_clinical_care, last_seq, concat_ws(':', n.n, last_seq, coalesce(t.n, 0) + coalesce(c.n, 0)) AS revision FROM n LEFT JOIN t USING (subject_id) LEFT JOIN c USING (subject_id)""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of each subject's graph by family, with a token that changes when either does."""
    rows = statements(spark, sf_dir)
    links = st.links_of(rows)
    temporal = pairs_of(rows).groupBy("subject_id").agg(F.count("*").alias("n_temporal"))
    other = links.select("subject_id", "evidence_id", F.col("state_id").alias("later_id"))
    care = links.join(other, ["subject_id", "evidence_id"]).filter("state_id < later_id").select("subject_id", "state_id", "later_id").distinct().groupBy("subject_id").agg(F.count("*").alias("n_clinical_care"))
    nodes = rows.groupBy("subject_id").agg(F.count("*").alias("n_nodes"), F.max("ingest_seq").alias("last_seq"))
    both = nodes.join(temporal, "subject_id", "left").join(care, "subject_id", "left").na.fill(0, ["n_temporal", "n_clinical_care"]).withColumn("n_edges", F.col("n_temporal") + F.col("n_clinical_care"))
    return both.select("subject_id", "n_nodes", "n_edges", "n_temporal", "n_clinical_care", "last_seq", F.concat_ws(":", F.col("n_nodes").cast("string"), F.col("last_seq").cast("string"), F.col("n_edges").cast("string")).alias("revision"))


DIMENSIONS = {"accuracy": "state_id % 6", "completeness": "state_id % 5", "no_hallucination": "CASE WHEN state_id % 7 <> 0 THEN state_id % 4 END"}


@register(f"WITH {STATEMENTS} SELECT task, dimension, count(score) AS n, round(avg(score), 6) AS mean FROM (SELECT task, unnest({list(DIMENSIONS)}) AS dimension, unnest([{', '.join(DIMENSIONS.values())}]) AS score FROM st) GROUP BY 1, 2")
def dimension_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each rubric dimension per task; a missing mark counts nowhere."""
    marks = F.create_map(*[x for n, e in DIMENSIONS.items() for x in (F.lit(n), F.expr(e))])
    rows = statements(spark, sf_dir).select("task", F.explode(marks).alias("dimension", "score"))
    return rows.groupBy("task", "dimension").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@register(f"""WITH {STATEMENTS}, o AS (SELECT subject_id, session_no, bool_or(state_id % 10 = 3) AS failed, bool_and(state_id % 4 = 1) AS unattempted FROM st GROUP BY 1, 2), q AS (SELECT state_id, subject_id, session_no FROM st)
    SELECT q.state_id AS query_id, count(*) AS n_visible, count(*) FILTER (failed AND NOT unattempted) AS n_failed, count(*) FILTER (unattempted) AS n_unattempted, coalesce(string_agg(CAST(o.session_no AS VARCHAR), ',' ORDER BY o.session_no) FILTER (failed AND NOT unattempted), '') AS failed_sessions, bool_or(failed OR unattempted) AS incomplete
    FROM q JOIN o ON o.subject_id = q.subject_id AND o.session_no <= q.session_no GROUP BY 1""")
def query_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sessions that a question may see those whose build failed or was not tried."""
    rows = statements(spark, sf_dir)
    builds = rows.groupBy("subject_id", "session_no").agg(F.bool_or(F.col("state_id") % 10 == 3).alias("failed"), F.bool_and(F.col("state_id") % 4 == 1).alias("unattempted"))
    asked = rows.select(F.col("state_id").alias("query_id"), "subject_id", F.col("session_no").alias("up_to"))
    seen = asked.join(builds, "subject_id").filter("session_no <= up_to").withColumn("bad", F.col("failed") & ~F.col("unattempted"))
    sessions = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("session_no")))), lambda x: x.cast("string")), ",")
    return seen.groupBy("query_id").agg(F.count("*").alias("n_visible"), F.count_if("bad").alias("n_failed"), F.count_if("unattempted").alias("n_unattempted"), sessions.alias("failed_sessions"), F.bool_or(F.col("failed") | F.col("unattempted")).alias("incomplete"))


@register(f"""WITH {LINKS} SELECT subject_id, count(DISTINCT state_id) AS n_states, count(DISTINCT evidence_id) AS n_evidence, count(DISTINCT family) AS n_families, count(DISTINCT session_no) AS n_episodes, count(DISTINCT term) AS n_terms
    FROM (SELECT st.subject_id, st.state_id, family, session_no, l.evidence_id, unnest(CASE WHEN len(terms) > 0 THEN terms ELSE [NULL] END) AS term FROM (SELECT *, regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}') AS terms FROM st) st JOIN links l USING (state_id)) GROUP BY 1""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the index over each subject's states: families, episodes, evidence and terms."""
    rows = statements(spark, sf_dir)
    evidence = st.links_of(rows).groupBy("subject_id").agg(F.countDistinct("evidence_id").alias("n_evidence"))
    terms = rows.select("subject_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)))).alias("term")).groupBy("subject_id").agg(F.countDistinct("term").alias("n_terms"))
    whole = rows.groupBy("subject_id").agg(F.count("*").alias("n_states"), F.countDistinct("family").alias("n_families"), F.countDistinct("session_no").alias("n_episodes"))
    return whole.join(evidence, "subject_id").join(terms, "subject_id", "left").na.fill(0, ["n_terms"])


@register(f"""WITH {STATEMENTS}, x AS (SELECT subject_id, max(session_no) AS last_session, bool_or(state_id % 40 = 1) AS has_noise, count(DISTINCT session_no) AS n_sessions, bool_or(status = 'conflict') AS in_conflict FROM st GROUP BY 1)
    SELECT *, CASE WHEN in_conflict THEN 'running' WHEN n_sessions < last_session THEN 'incomplete' ELSE 'complete' END AS state, NOT in_conflict AND n_sessions = last_session AND NOT has_noise AS ready FROM x""")
def inferred_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each subject's record goes, and whether it is whole enough to be scored."""
    x = statements(spark, sf_dir).groupBy("subject_id").agg(F.max("session_no").alias("last_session"), F.bool_or(F.col("state_id") % 40 == 1).alias("has_noise"), F.countDistinct("session_no").alias("n_sessions"), F.bool_or(F.col("status") == "conflict").alias("in_conflict"))
    state = F.when(F.col("in_conflict"), "running").when(F.col("n_sessions") < F.col("last_session"), "incomplete").otherwise("complete")
    return x.select("*", state.alias("state"), (~F.col("in_conflict") & (F.col("n_sessions") == F.col("last_session")) & ~F.col("has_noise")).alias("ready"))


@register("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER () AS total FROM orders) SELECT o_orderkey, o_orderstatus, CASE WHEN length(o_orderpriority) > 5 THEN substr(o_orderpriority, 1, 5) || '…' ELSE o_orderpriority END AS priority, total FROM r WHERE place <= 10""")
def newest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's first page: the ten newest rows, light columns only, texts cut, with the number of all."""
    orders = table(spark, sf_dir, "orders")
    short = F.when(F.length("o_orderpriority") > 5, F.concat(F.substring("o_orderpriority", 1, 5), F.lit("…"))).otherwise(F.col("o_orderpriority"))
    page = orders.select("o_orderkey", "o_orderstatus", "o_orderdate", short.alias("priority")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)
    return page.join(F.broadcast(orders.agg(F.count("*").alias("total"))), F.lit(True)).select("o_orderkey", "o_orderstatus", "priority", "total")


# ---- snapshots -----------------------------------------------------------------------------------------------------


@register(f"""WITH {STATEMENTS}, a AS (SELECT subject_id, state_id, text, status FROM st WHERE session_no <= 20 AND NOT (subject_id % 7 = 3 AND state_id % 30 = 1)), b AS (SELECT subject_id, state_id, text, CASE WHEN subject_id % 5 = 2 AND state_id % 20 = 0 THEN 'active' ELSE status END AS status FROM st WHERE session_no <= 20),
    d AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, count(a.state_id) AS n_stored, count(b.state_id) AS n_rebuilt, bool_and(coalesce(a.text = b.text AND a.status = b.status, false)) AS equal FROM a FULL JOIN b USING (state_id) GROUP BY 1) SELECT * FROM d""")
def snapshot_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's stored snapshot against what the log holds up to the same session."""
    log = statements(spark, sf_dir).select("subject_id", "state_id", "text", "status", "session_no")
    stored = log.filter("session_no <= 20 and not (subject_id % 7 = 3 and state_id % 30 = 1)").drop("session_no")
    rebuilt = snapshots.as_of(log, F.col("session_no"), F.lit(20)).drop("session_no")
    changed = F.when((F.col("subject_id") % 5 == 2) & (F.col("state_id") % 20 == 0), "active").otherwise(F.col("status"))
    return snapshots.compare(stored, rebuilt.withColumn("status", changed), ["subject_id"])


@register(f"""WITH {LINKS}, keep AS (SELECT DISTINCT evidence_id FROM links), b AS (SELECT l.subject_id, bool_and(e.subject_id IS NOT NULL AND e.subject_id = l.subject_id) AS whole FROM links l LEFT JOIN evidence e USING (evidence_id) GROUP BY 1),
    x AS (SELECT subject_id, count(*) AS n_evidence FROM evidence WHERE evidence_id IN (SELECT * FROM keep) GROUP BY 1) SELECT s.subject_id, s.n_states, coalesce(x.n_evidence, 0) AS n_evidence, b.whole FROM (SELECT subject_id, count(*) AS n_states FROM st GROUP BY 1) s JOIN b USING (subject_id) LEFT JOIN x USING (subject_id)""")
def scoring_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frozen snapshot of each subject would hold: its states, the evidence they refer to, whether all of it is there."""
    rows = statements(spark, sf_dir)
    links, evidence = st.links_of(rows), evidence_of(rows)
    referred = evidence.join(links.select("evidence_id").distinct(), "evidence_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("n_evidence"))
    there = links.join(evidence.select("evidence_id", F.col("subject_id").alias("owner")), "evidence_id", "left").groupBy("subject_id").agg(F.bool_and(F.coalesce(F.col("owner") == F.col("subject_id"), F.lit(False))).alias("whole"))
    return rows.groupBy("subject_id").agg(F.count("*").alias("n_states")).join(there, "subject_id").join(referred, "subject_id", "left").select("subject_id", "n_states", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "whole")


@register(f"WITH {STATEMENTS} SELECT subject_id, count(*) AS n_kept, max(session_no) AS last_session FROM st WHERE session_no <= 20 AND subject_id % 10 <> 4 GROUP BY 1")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when later sessions, and some subjects, are deleted."""
    return statements(spark, sf_dir).filter("session_no <= 20 and subject_id % 10 <> 4").groupBy("subject_id").agg(F.count("*").alias("n_kept"), F.max("session_no").alias("last_session"))


@register(f"WITH {STATEMENTS} SELECT subject_id, family, min(state_id) AS state_id, arg_min(status, state_id) AS status FROM st GROUP BY 1, 2")
def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key (here subject and family) the first."""
    return snapshots.first_of_key(statements(spark, sf_dir).select("subject_id", "family", "state_id", "status"), ["subject_id", "family"], "state_id").select("subject_id", "family", "state_id", "status")


@register(f"""WITH {STATEMENTS}, l AS (SELECT state_id, [family, source_type, family, status, CASE WHEN state_id % 2 = 0 THEN family ELSE 'x' END] AS labels FROM st), p AS (SELECT state_id, labels, list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN list_position(labels, labels[i]) < i THEN labels[i] || '@' || (i - 1) || '<' || (list_position(labels, labels[i]) - 1) END) AS r FROM l)
    SELECT state_id, array_to_string(list_filter(list_transform(range(1, len(labels) + 1), lambda i: CASE WHEN list_position(labels, labels[i]) = i THEN labels[i] END), lambda x: x IS NOT NULL), ',') AS labels, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS removed FROM p""")
def label_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without repeats, and a note of each repeat that was removed."""
    kept, removed = snapshots.label_repeats(F.expr("array(family, source_type, family, status, CASE WHEN state_id % 2 = 0 THEN family ELSE 'x' END)"))
    return statements(spark, sf_dir).select("state_id", F.array_join(kept, ",").alias("labels"), F.array_join(removed, ",").alias("removed"))


# ---- relations of a question ---------------------------------------------------------------------------------------

CHOSEN = "state_id % 6 = 0"


@register(f"""WITH {STATEMENTS}, l AS (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS other_id FROM st), e AS (SELECT state_id AS a, other_id AS b FROM l WHERE other_id IS NOT NULL UNION ALL SELECT other_id, state_id FROM l WHERE other_id IS NOT NULL),
    c AS (SELECT state_id, (state_id % 50) / 10.0 AS score FROM st WHERE {CHOSEN}), n AS (SELECT e.b AS state_id, c.state_id AS linked_to, greatest(0.7, c.score - 1.25) AS score FROM c JOIN e ON e.a = c.state_id WHERE e.b NOT IN (SELECT state_id FROM c))
    SELECT state_id, min(linked_to) AS linked_to, round(arg_min(score, linked_to), 4)::DOUBLE AS score FROM n GROUP BY 1""")
def version_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions before and after the candidates of an update question, at a lower score; the first that links one counts."""
    rows = statements(spark, sf_dir)
    prior = rows.select("state_id", F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id")).alias("other_id")).filter("other_id is not null")
    ways = prior.select(F.col("state_id").alias("from_id"), F.col("other_id").alias("to_id")).union(prior.select("other_id", "state_id"))
    chosen = rows.filter(CHOSEN).select(F.col("state_id").alias("from_id"), ((F.col("state_id") % 50) / 10).alias("score"))
    near = chosen.join(ways, "from_id").join(chosen.select(F.col("from_id").alias("to_id")), "to_id", "left_anti")
    return near.groupBy(F.col("to_id").alias("state_id")).agg(F.min("from_id").alias("linked_to"), F.round(F.greatest(F.lit(0.7), F.min_by("score", "from_id") - 1.25), 4).alias("score"))


@register(f"""WITH {LINKS}, l AS (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS prior FROM st), a AS (SELECT * FROM st WHERE {CHOSEN}),
    r AS (SELECT a.state_id AS anchor_id, l.prior AS state_id, 0 AS kind FROM a JOIN l USING (state_id) WHERE l.prior IS NOT NULL UNION ALL SELECT a.state_id, y.state_id, 1 FROM a JOIN links x ON x.state_id = a.state_id JOIN links y ON y.evidence_id = x.evidence_id AND y.state_id <> a.state_id
        UNION ALL SELECT a.state_id, s.state_id, 2 FROM a JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id, text ORDER BY seconds DESC, state_id) AS nth FROM st) s ON s.subject_id = a.subject_id AND s.text = a.text AND s.nth <= 4 WHERE s.state_id <> a.state_id),
    f AS (SELECT anchor_id, state_id, min(kind) AS kind FROM r GROUP BY 1, 2), p AS (SELECT f.*, row_number() OVER (PARTITION BY anchor_id ORDER BY seconds DESC, f.state_id) AS place FROM f JOIN st USING (state_id))
    SELECT anchor_id, state_id, CASE kind WHEN 0 THEN 'state_transition' WHEN 1 THEN 'same_evidence' ELSE 'same_entity' END AS relation, place FROM p WHERE place <= 3""")
def related_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is related to each anchor, by lineage, evidence or words (four of those at most), the newest three."""
    rows = statements(spark, sf_dir)
    anchors = rows.filter(CHOSEN).select(F.col("state_id").alias("anchor_id"), "subject_id", "text")
    prior = rows.select(F.col("state_id").alias("anchor_id"), F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id")).alias("state_id")).filter("state_id is not null")
    links = st.links_of(rows)
    kin = anchors.join(links.select(F.col("state_id").alias("anchor_id"), "evidence_id"), "anchor_id").join(links.select("state_id", "evidence_id"), "evidence_id").select("anchor_id", "state_id", F.lit(1).alias("kind"))
    newest = rows.select("subject_id", "text", "state_id", F.row_number().over(W.partitionBy("subject_id", "text").orderBy(F.desc("seconds"), "state_id")).alias("nth")).filter("nth <= 4")
    same = anchors.join(newest, ["subject_id", "text"]).select("anchor_id", "state_id", F.lit(2).alias("kind"))
    found = anchors.join(prior, "anchor_id").select("anchor_id", "state_id", F.lit(0).alias("kind")).union(kin).union(same).filter("anchor_id <> state_id").groupBy("anchor_id", "state_id").agg(F.min("kind").alias("kind"))
    placed = found.join(rows.select("state_id", "seconds"), "state_id").withColumn("place", F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("seconds"), "state_id")).cast("long"))
    return placed.filter("place <= 3").select("anchor_id", "state_id", F.element_at(F.array(F.lit("state_transition"), F.lit("same_evidence"), F.lit("same_entity")), F.col("kind") + 1).alias("relation"), "place")


REL = f"rel AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RELATION.items())} FROM pairs WHERE from_id IS NOT NULL)"


def shared_pairs(links: DataFrame) -> DataFrame:
    """(from_id, to_id): each pair of a subject's states that share evidence, once: by the least evidence that both have, so
    that no task has to remember pairs."""
    own = W.partitionBy("state_id", "subject_id")
    held = links.select("state_id", "subject_id", "evidence_id", F.lag("evidence_id").over(own.orderBy("evidence_id")).alias("last"), F.collect_set("evidence_id").over(own).alias("ids")).filter("last is null or last <> evidence_id")
    side = lambda n: held.select("evidence_id", "subject_id", F.col("state_id").alias(f"{n}_id"), F.col("ids").alias(f"{n}_ids"))
    return side("from").join(side("to"), ["evidence_id", "subject_id"]).filter((F.col("from_id") < F.col("to_id")) & (F.col("evidence_id") == F.array_min(F.array_intersect("from_ids", "to_ids")))).select("from_id", "to_id")


@register(f"""WITH {LINKS}, {PAIRS}, {REL}, kept AS (SELECT from_id, to_id, 'updates' AS type, verified AND status = 'verified' AS ok, 0 AS rank FROM rel WHERE NOT causal), lin AS (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS prior FROM st),
    late AS (SELECT prior AS from_id, state_id AS to_id, 'supersedes' AS type, true AS ok, 1 AS rank FROM lin WHERE prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept k WHERE least(k.from_id, k.to_id) = least(prior, state_id) AND greatest(k.from_id, k.to_id) = greatest(prior, state_id))),
    shared AS (SELECT a.state_id, b.state_id AS other, 'informs' AS type, false AS ok, 2 AS rank FROM links a JOIN links b ON a.evidence_id = b.evidence_id AND a.subject_id = b.subject_id AND a.state_id < b.state_id JOIN evidence e ON e.evidence_id = a.evidence_id AND e.subject_id = a.subject_id),
    al AS (SELECT * FROM kept UNION ALL SELECT * FROM late UNION ALL SELECT * FROM shared)
    SELECT from_id, to_id, type, arg_min(ok, rank) AS verified, CASE min(rank) WHEN 0 THEN 'patient_graph' WHEN 1 THEN 'lineage' ELSE 'query_local_shared_evidence_candidate' END AS source FROM (SELECT DISTINCT * FROM al) WHERE from_id <> to_id GROUP BY 1, 2, 3""")
def query_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations among a subject's states: stored edges, lineage that no stored edge tells, candidates of shared evidence."""
    rows = statements(spark, sf_dir)
    rel = pairs_of(rows).selectExpr(*[f"{e} AS {n}" for n, e in RELATION.items()])
    kept = rel.filter("not causal").select("from_id", "to_id", F.lit("updates").alias("type"), (F.col("verified") & (F.col("status") == "verified")).alias("ok"), F.lit(0).alias("rank"))
    lineage = rows.select(F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id")).alias("from_id"), F.col("state_id").alias("to_id")).filter("from_id is not null")
    pair = lambda: F.struct(F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).alias("pair")
    late = lineage.withColumn("pair", pair()).join(kept.select(pair()).distinct(), "pair", "left_anti").select("from_id", "to_id", F.lit("supersedes").alias("type"), F.lit(True).alias("ok"), F.lit(1).alias("rank"))
    links = st.links_of(rows).join(evidence_of(rows).select("evidence_id", "subject_id"), ["evidence_id", "subject_id"], "left_semi")
    shared = shared_pairs(links).select("from_id", "to_id", F.lit("informs").alias("type"), F.lit(False).alias("verified"), F.lit(2).alias("rank"))
    # A type has one source, so what is shared meets no other relation and its pairs, the most, are not grouped.
    whole = kept.union(late).filter("from_id <> to_id").groupBy("from_id", "to_id", "type").agg(F.min_by("ok", "rank").alias("verified"), F.min("rank").alias("rank")).unionByName(shared)
    return whole.select("from_id", "to_id", "type", "verified", F.element_at(F.array(F.lit("patient_graph"), F.lit("lineage"), F.lit("query_local_shared_evidence_candidate")), F.col("rank") + 1).alias("source"))


@register(f"""WITH RECURSIVE {STATEMENTS}, {PAIRS}, n AS (SELECT subject_id, state_id, family FROM st WHERE {CHOSEN}), e AS (SELECT from_id AS a, state_id AS b FROM pairs WHERE state_id % 4 <> 0 AND from_id IN (SELECT state_id FROM n) AND state_id IN (SELECT state_id FROM n)), x AS (SELECT a.state_id AS a, b.state_id AS b FROM n a JOIN n b ON a.subject_id = b.subject_id AND a.family = b.family AND b.state_id = (SELECT min(state_id) FROM n c WHERE c.subject_id = a.subject_id AND c.family = a.family)
    UNION SELECT a.state_id, b.state_id FROM n a JOIN n b ON a.subject_id = b.subject_id AND a.state_id % 4 = 0 AND b.state_id = (SELECT min(state_id) FROM n c WHERE c.subject_id = a.subject_id)), bw AS (SELECT a, b FROM x UNION SELECT b, a FROM x UNION SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT state_id AS a, state_id AS b FROM n UNION SELECT reach.a, bw.b FROM reach JOIN bw ON bw.a = reach.b), g AS (SELECT a AS state_id, min(b) AS component FROM reach GROUP BY 1), s AS (SELECT n.subject_id, component, count(*) AS size, list_distinct(list(family)) AS families FROM g JOIN n USING (state_id) GROUP BY 1, 2),
    big AS (SELECT subject_id, arg_max(families, size * 1000000000 - component) AS joined, max(size) AS size FROM s GROUP BY 1), a AS (SELECT subject_id, list_distinct(list(family)) AS families FROM n GROUP BY 1)
    SELECT subject_id, size AS largest, array_to_string(list_filter(['CS', 'CP', 'LO'], lambda f: NOT list_contains(families, f)), ',') AS missing, array_to_string(list_filter(['CS', 'CP', 'LO'], lambda f: NOT list_contains(joined, f)), ',') AS disconnected, CASE WHEN size > 1 AND list_has_all(joined, ['CS', 'CP', 'LO']) THEN 'supported' ELSE 'unresolved' END AS verdict FROM big JOIN a USING (subject_id)""")
def hypothesis_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the families that a question needs are there and hang together in the largest connected set of its states."""
    from threadline.operators.graph import components

    nodes = statements(spark, sf_dir).filter(CHOSEN).select("subject_id", "state_id", "family")
    same = nodes.select("state_id", F.min("state_id").over(W.partitionBy("subject_id", "family")).alias("other_id"))
    hub = nodes.select("state_id", "subject_id", F.min("state_id").over(W.partitionBy("subject_id")).alias("other_id")).filter("state_id % 4 = 0").drop("subject_id")
    inside = nodes.select("state_id")
    turns = pairs_of(statements(spark, sf_dir)).filter("state_id % 4 <> 0").select("state_id", F.col("from_id").alias("other_id")).join(inside, "state_id", "left_semi").join(inside.withColumnRenamed("state_id", "other_id"), "other_id", "left_semi")
    found = components(same.unionByName(hub).unionByName(turns), "state_id", "other_id").withColumnRenamed("node", "state_id")
    sizes = nodes.join(found, "state_id").groupBy("subject_id", "component").agg(F.count("*").alias("size"), F.collect_set("family").alias("families"))
    largest = sizes.groupBy("subject_id").agg(F.max_by(F.struct("families", "size"), F.struct("size", -F.col("component"))).alias("l"))
    here = nodes.groupBy("subject_id").agg(F.collect_set("family").alias("families"))
    needed = F.array(*map(F.lit, ("CS", "CP", "LO")))
    rows = largest.join(here, "subject_id")
    apart = F.array_except(needed, F.col("l.families"))
    return rows.select("subject_id", F.col("l.size").alias("largest"), F.array_join(F.array_except(needed, F.col("families")), ",").alias("missing"), F.array_join(apart, ",").alias("disconnected"), F.when((F.col("l.size") > 1) & (F.size(apart) == 0), "supported").otherwise("unresolved").alias("verdict"))


SHAPE = {
    "from_state_id": "CASE WHEN state_id % 9 = 0 THEN '' ELSE CAST(state_id AS VARCHAR(20)) END", "to_state_id": "CAST(CASE WHEN state_id % 11 = 0 THEN state_id ELSE state_id + 1 END AS VARCHAR(20))", "relation_type": "CASE WHEN state_id % 7 = 0 THEN 'Causes' ELSE 'Motivates' END",
    "assessment": "CASE WHEN state_id % 13 = 0 THEN 'likely' ELSE 'supports' END", "relation_quote": "CASE WHEN state_id % 8 = 0 THEN '' ELSE text END", "confidence": "CAST(CASE WHEN state_id % 10 = 0 THEN 1.2 ELSE 0.9 END AS DOUBLE)",
}
KINDS = ("care_targets", "observed_after_care", "motivates", "constrains", "followed_by")


@register(f"WITH {STATEMENTS}, e AS (SELECT state_id, count(*) OVER (PARTITION BY subject_id, session_no) AS n, {', '.join(f'{x} AS {n}' for n, x in SHAPE.items())} FROM st) SELECT state_id, " + _errors(
    ("invalid endpoints", "from_state_id = '' OR to_state_id = '' OR from_state_id = to_state_id"), ("invalid relation_type", f"lower(relation_type) NOT IN {KINDS}"), ("invalid assessment", "lower(assessment) NOT IN ('supports', 'contradicts', 'unresolved')"), ("quotes are required", "relation_quote = ''"), ("invalid confidence", "NOT confidence BETWEEN 0 AND 1"), ("at most 8 relations", "n > 8")) + " AS errors FROM e")
def proposal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed relations with what is wrong with their form; a context (here a subject's session) may hold eight."""
    rows = statements(spark, sf_dir)
    counts = rows.groupBy("subject_id", "session_no").agg(F.count("*").alias("n"))
    rows = rows.join(counts, ["subject_id", "session_no"]).selectExpr("state_id", "n", *[f"{x} AS {n}" for n, x in SHAPE.items()])
    c = F.col
    checks = {
        "invalid endpoints": (c("from_state_id") == "") | (c("to_state_id") == "") | (c("from_state_id") == c("to_state_id")), "invalid relation_type": ~F.lower("relation_type").isin(*KINDS), "invalid assessment": ~F.lower("assessment").isin("supports", "contradicts", "unresolved"),
        "quotes are required": c("relation_quote") == "", "invalid confidence": ~c("confidence").between(0, 1), "at most 8 relations": c("n") > 8,
    }
    return rows.select("state_id", quality.errors(checks).alias("errors"))


@register(f"WITH {STATEMENTS} SELECT subject_id, family, max(CASE WHEN state_id % 3 = 0 THEN 3 WHEN state_id % 3 = 1 THEN 2 ELSE 1 END) AS weight FROM st GROUP BY 1, 2")
def merged_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest priority that any plan of a subject gives a family."""
    weight = F.when(F.col("state_id") % 3 == 0, 3).when(F.col("state_id") % 3 == 1, 2).otherwise(1)
    return snapshots.scope_merge(statements(spark, sf_dir).select("subject_id", "family", weight.alias("weight")), ["subject_id"]).select("subject_id", "family", "weight")
