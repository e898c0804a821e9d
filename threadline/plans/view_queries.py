"""Registered queries of what each step may read and of plans from outside, each beside its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import plan_merge, visibility
from threadline.operators.tables import materialize
from threadline.plans.base import STATEMENTS, register, statements, table
from threadline.plans.rule_queries import FACETS_SQL, KEPT_SQL, OPERATOR_SQL, PHRASES_SQL, QUESTION, SCOPES_SQL, SLOT_SQL

TASK = {
    "task_id": "doc_id", "task_type": "CASE doc_id % 4 WHEN 0 THEN 'memory_recall' WHEN 1 THEN 'temporal_causal_reasoning' ELSE 'session_level_response_generation' END", "case_id": "source", "question": "concat(lang, ' ', source)",
    "memory_source": "concat('memory of ', source)",
}
ANSWERED = "concat(task_type, ': ', coalesce(memory_source, 'none'), ' ', question)"


def tasks_and_gold(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = labels.select(F.col("doc_id").alias("task_id"), F.col("quality").cast("string").alias("reference_answer"), F.col("toxic").cast("string").alias("evaluation_focus"), F.concat("quality", F.lit("/"), "toxic").alias("answer_source"))
    return {"tasks": docs.selectExpr(*[f"{e} AS {n}" for n, e in TASK.items()]), "gold": gold}


def answered(tables: dict[str, DataFrame]) -> DataFrame:
    """The answering step: it reads its view of the tasks alone."""
    return visibility.answer_rows(tables["tasks"]).withColumn("model_response", F.expr(ANSWERED))


_TASKS = f"t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in TASK.items())} FROM documents), a AS (SELECT * REPLACE (CASE WHEN task_type <> 'session_level_response_generation' THEN memory_source END AS memory_source) FROM t)"


@register(f"WITH {_TASKS} SELECT task_id, task_type, case_id, question, memory_source, {ANSWERED} AS model_response FROM a")
def answer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tasks are answered from, by a query that was checked not to depend on the gold."""
    tables = tasks_and_gold(spark, sf_dir)
    out = visibility.check_blind(answered, tables, {"gold": ("reference_answer", "evaluation_focus", "answer_source")})
    return out.select("task_id", "task_type", "case_id", "question", "memory_source", "model_response")


@register(f"""WITH {_TASKS} SELECT task_id, task_type, case_id, question, CASE WHEN task_type IN ('memory_recall', 'temporal_causal_reasoning') THEN CAST(quality AS VARCHAR) END AS reference_answer,
    CASE WHEN task_type IN ('session_level_response_generation', 'temporal_causal_reasoning') THEN CAST(toxic AS VARCHAR) END AS evaluation_focus, CASE WHEN task_type = 'memory_recall' THEN quality || '/' || toxic END AS answer_source, {ANSWERED} AS model_response FROM a JOIN labels ON doc_id = task_id""")
def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge by rubrics reads: answers that are written first, and gold that joins them only then."""
    tables = tasks_and_gold(spark, sf_dir)
    frozen = materialize(answered(tables), "answers")
    rows = visibility.judge_rows(frozen, tables["gold"], "task_id", visibility.RUBRIC_JUDGE_VIEW)
    return rows.select("task_id", "task_type", "case_id", "question", "reference_answer", "evaluation_focus", "answer_source", "model_response")


@register("""SELECT event_id, to_json({'event_id': event_id, 'value': event_type, 'source': {'subject': user_id}, 'families': [{'family': event_type}], 'history': [{'reason': 'r', 'parts': [{'id': event_id}]}]}) AS record FROM events""")
def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in an older form (events with fields that are no longer read, at several depths) without them."""
    old = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type AS value", "named_struct('subject', user_id, 'normalization', 'x') AS source", "array(named_struct('family', event_type, 'reason', 'because', 'numbers', array(1))) AS families",
        "array(named_struct('reason', 'r', 'parts', array(named_struct('id', event_id, 'speaker', 'y')))) AS history", "named_struct('checkpoint', 1, 'derived', named_struct('id', 2)) AS snapshot", "ts AS entity")
    return visibility.clean_rows(old).select("event_id", F.to_json(F.struct("*")).alias("record"))


GIVEN = {
    "given_target": "CASE state_id % 4 WHEN 0 THEN concat('  ', family, ' ') WHEN 1 THEN ' ' END", "given_slot": "CASE WHEN state_id % 5 = 0 THEN 'slot' END", "given_operator": "CASE state_id % 6 WHEN 0 THEN ' Event  Time ' WHEN 1 THEN 'sometime' END",
    "given_keywords": "CASE WHEN state_id % 3 = 0 THEN array('alpha', ' beta ', 'a', 'alpha', family) END", "given_facets": "CASE WHEN state_id % 2 = 0 THEN array('direct_facts', ' x ', '') END",
    "given_scopes": "CASE WHEN state_id % 2 = 1 THEN array(named_struct('family', lower(family), 'priority', CASE state_id % 8 WHEN 1 THEN '2' WHEN 3 THEN 'High' WHEN 5 THEN '3.5' ELSE 'odd' END), named_struct('family', 'XX', 'priority', '3')) END",
    "given_options": "CASE WHEN state_id % 7 = 0 THEN array(named_struct('id', 'b', 'text', 'new'), named_struct('id', 'd', 'text', ' four '), named_struct('id', '1', 'text', 'x')) END",
}


@register(f"""WITH {STATEMENTS}, p AS (SELECT state_id, family, task, trim(text) AS option, {QUESTION} AS text FROM st), i AS (SELECT *, {SCOPES_SQL} AS scopes, {FACETS_SQL} AS facets, {OPERATOR_SQL} AS op, {SLOT_SQL} AS slot, CASE state_id % 8 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 3 ELSE 1 END AS w FROM p),
    g AS (SELECT *, list_filter(['BC', 'PE', 'PA', 'CS', 'CP', 'LO'], lambda f: len(list_filter(scopes, lambda s: s[1:2] = f)) > 0 OR (state_id % 2 = 1 AND f = family)) AS fams FROM i),
    o AS (WITH {PHRASES_SQL} SELECT DISTINCT state_id, array_to_string(list_filter(kept, lambda x, i: list_position(kept, x) = i)[1:{plan_merge.MAX_KEYWORDS}], '|') AS own FROM (SELECT state_id, {KEPT_SQL} AS kept FROM p))
    SELECT state_id, CASE WHEN state_id % 4 = 0 THEN family END AS target, CASE WHEN state_id % 5 = 0 THEN 'slot' ELSE slot END AS answer_slot, CASE WHEN state_id % 6 = 0 THEN 'event_time' ELSE op END AS temporal_operator, CASE WHEN state_id % 3 = 0 THEN 'alpha|beta|' || family ELSE own END AS keywords,
        array_to_string(list_transform(fams, lambda f: f || '=' || greatest(coalesce(CAST(list_filter(scopes, lambda s: s[1:2] = f)[1][4:] AS INTEGER), 0), CASE WHEN state_id % 2 = 1 AND f = family THEN w ELSE 0 END)), ',') AS scopes,
        array_to_string(list_sort(list_distinct(facets || CASE WHEN state_id % 2 = 0 THEN ['direct_facts', 'x'] ELSE CAST([] AS VARCHAR[]) END)), ',') AS facets, 'A=' || option || '|B=none|C=' || family || CASE WHEN state_id % 7 = 0 THEN '|D=four' ELSE '' END AS options FROM g JOIN o USING (state_id)""")
def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of questions with options, merged with values from outside; some of these are blank, unknown or in another form."""
    rows = statements(spark, sf_dir).withColumn("question", F.expr(QUESTION.replace("chr(10)", "char(10)")))
    out = plan_merge.merge_plans(rows.selectExpr("state_id", "question", "task", *[f"{e} AS {n}" for n, e in GIVEN.items()]))
    joined = lambda c, mark=",": F.array_join(c, mark)
    return out.select("state_id", "target", "answer_slot", "temporal_operator", joined("keywords", "|").alias("keywords"), joined("scopes").alias("scopes"), joined(F.array_sort("facets")).alias("facets"), joined(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"))
