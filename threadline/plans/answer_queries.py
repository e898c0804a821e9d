"""Registered queries that score answers and report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import answers as an
from threadline.plans.base import PHRASES, STATEMENTS, _pick, matches, quoted, register, statements
from threadline.plans.ranking_queries import TERMS
from threadline.plans.rule_queries import ROUTE_SQL

#: Answers to statements read as questions, in SQL that both engines read.
ANSWER = {
    "answer_id": "state_id", "subject_id": "subject_id", "task": "task", "session_no": "session_no", "experiment": "state_id % 12",
    "output": f"CASE WHEN state_id % 37 = 0 THEN '' WHEN task = 'multiple_choice' AND state_id % 2 = 0 THEN 'A, C' WHEN state_id % 5 = 0 THEN concat({_pick(TERMS, 'state_id')}, ', ', {_pick(PHRASES, '(state_id * 5 + 3)')}) ELSE text END",
    "gold": f"CASE WHEN task = 'multiple_choice' THEN CASE WHEN state_id % 4 = 0 THEN 'A. one' ELSE 'C) two, A' END WHEN state_id % 4 = 1 THEN text WHEN state_id % 5 = 0 THEN {_pick(TERMS, 'state_id')} ELSE {_pick(PHRASES, '(state_id * 3 + 1)')} END",
    "gold2": f"CASE WHEN state_id % 9 = 0 AND task <> 'multiple_choice' THEN {_pick(TERMS, '(state_id + 1)')} END",
    "judge_json": "concat(CASE WHEN state_id % 6 = 0 THEN concat('```json', chr(10)) WHEN state_id % 6 = 1 THEN 'The verdict: ' ELSE '' END, '{\"is_correct\": ', CASE state_id % 11 WHEN 0 THEN 'null' WHEN 1 THEN 'false' WHEN 2 THEN 'false' ELSE 'true' END, ', \"ncr_score\": 0.', CAST(state_id % 10 AS VARCHAR(9)), ', \"crc_score\": ', CASE WHEN state_id % 14 = 0 THEN '1.5' ELSE '0.5' END, ', \"cc_score\": 1, \"memory_retrieval_quality\": \"', CASE state_id % 7 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'partial' WHEN 3 THEN 'poor' WHEN 4 THEN 'none' WHEN 5 THEN 'odd' ELSE 'good' END, '\", \"uses_patient_specific_info\": ', CASE WHEN state_id % 3 = 0 THEN 'false' ELSE 'true' END, '}', CASE WHEN state_id % 6 = 0 THEN concat(chr(10), '```') WHEN state_id % 6 = 1 THEN ' so it is.' ELSE '' END)",
    "run_failed": "state_id % 21 = 4", "memory_incomplete": "state_id % 26 = 9", "mock": "state_id % 97 = 1", "latency": "CAST(state_id % 500 AS DOUBLE)",
}
ANSWERS_SQL = f"{STATEMENTS}, an AS (SELECT *, list_filter([gold, gold2], lambda g: g IS NOT NULL) AS golds FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in ANSWER.items())} FROM st))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir).selectExpr(*[f"{e.replace('chr(10)', 'char(10)')} AS {n}" for n, e in ANSWER.items()])
    return rows.withColumn("golds", F.filter(F.array("gold", "gold2"), lambda g: g.isNotNull()))


_MARKS = "".join("\\" + c if c.isascii() else c for c in dict.fromkeys(fx.OFFICIAL_MARKS)).replace("'", "''")
OFFICIAL = lambda c: f"regexp_replace(lower({c}), '[{_MARKS}\\s]', '', 'g')"
LATIN = lambda c: f"list_sort(regexp_extract_all(lower({c}), '[a-z][a-z0-9]*'))"
REST = lambda c: OFFICIAL(f"regexp_replace(lower({c}), '[a-z][a-z0-9]*', '', 'g')")
ENTITY = lambda g: f"({OFFICIAL(g)} <> '' AND contains({OFFICIAL('output')}, {OFFICIAL(g)}) OR len({LATIN('output')}) > 0 AND {LATIN('output')} = {LATIN(g)} AND {REST(g)} <> '' AND contains({REST('output')}, {REST(g)}))"
CONTAIN = f"(len(golds) > 0 AND len(list_filter(golds, lambda g: NOT {ENTITY('g')})) = 0)"
LETTERS = lambda c: "list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(upper({c}), {quoted(p)}, 1)" for p in fx.OPTION_PATTERNS) + "])))"
OPTION = f"({LETTERS('output')} = list_sort(list_distinct(flatten(list_transform(golds, lambda g: CASE WHEN regexp_extract(upper(g), '^([A-F])[.、:\\s]', 1) <> '' THEN [regexp_extract(upper(g), '^([A-F])[.、:\\s]', 1)] ELSE {LETTERS('g')} END)))))"


@register(f"WITH {ANSWERS_SQL} SELECT answer_id, {CONTAIN} AS contains_all, {OPTION} AS same_options, len(list_filter(golds, lambda g: trim(lower(g)) <> '' AND trim(lower(output)) <> '' AND (contains(trim(lower(output)), trim(lower(g))) OR contains(trim(lower(g)), trim(lower(output)))))) > 0 AS contains_either FROM an")
def answer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold entities contained, options chosen, containment in either direction."""
    out, golds = F.col("output"), F.col("golds")
    return answers(spark, sf_dir).select("answer_id", an.string_contain(out, golds).alias("contains_all"), an.option_match(out, golds).alias("same_options"), an.contains_either(out, golds).alias("contains_either"))


PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), {quoted(fx.ARTICLES)}, ' ', 'g'), '\\s+', ' ', 'g'))"
TOKENS = lambda c: f"list_filter(string_split({PLAIN(c)}, ' '), lambda x: x <> '')"
F1 = lambda p, g: f"CASE WHEN list_sum(list_concat([0], list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w)))))) > 0 THEN 2.0::DOUBLE * list_sum(list_concat([0], list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({g}, lambda x: x = w)))))) / (len({p}) + len({g})) ELSE 0.0::DOUBLE END"
PARTS = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


@register(f"""WITH {ANSWERS_SQL}, t AS (SELECT answer_id, {TOKENS('output')} AS p, {TOKENS('gold')} AS g, {PARTS('output')} AS pp, {PARTS('gold')} AS gp, contains(output, ',') OR contains(gold, ',') AS comma FROM an),
    w AS (SELECT *, {F1('p', 'g')} AS whole FROM t), x AS (SELECT answer_id, i, j, {F1('a', 'b')} AS f FROM (SELECT answer_id, i, j, {TOKENS('x')} AS a, {TOKENS('y')} AS b FROM (SELECT *, unnest(gp) AS y, unnest(range(len(gp))) AS j FROM (SELECT answer_id, gp, unnest(pp) AS x, unnest(range(len(pp))) AS i FROM t WHERE comma)))),
    pr AS (SELECT answer_id, avg(m) AS precision FROM (SELECT answer_id, i, max(f) AS m FROM x GROUP BY 1, 2) GROUP BY 1), rc AS (SELECT answer_id, avg(m) AS recall FROM (SELECT answer_id, j, max(f) AS m FROM x GROUP BY 1, 2) GROUP BY 1)
    SELECT answer_id, round(greatest(whole, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS f1 FROM w LEFT JOIN pr USING (answer_id) LEFT JOIN rc USING (answer_id)""")
def comma_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("answer_id", F.round(an.token_f1(F.col("output"), F.col("gold")), 6).alias("f1"))


DEEP = "task = 'multi_hop_clinical_deduction'"
J = lambda p, t: f"TRY_CAST(json_extract_string(js, '$.{p}') AS {t})"
JUDGED = f"""{ANSWERS_SQL}, jp AS (SELECT *, CASE WHEN starts_with(plain, '{{') THEN plain ELSE regexp_extract(plain, '(?s)(\\{{.*\\}})', 1) END AS js FROM (SELECT *, trim(regexp_replace(judge_json, '(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', '\\1')) AS plain FROM an)),
    je AS (SELECT *, CASE WHEN {J('is_correct', 'BOOLEAN')} IS NULL THEN 'is_correct must be boolean' WHEN {DEEP} AND NOT coalesce({J('ncr_score', 'DOUBLE')} BETWEEN 0 AND 1, false) THEN 'ncr_score must be between 0 and 1' WHEN {DEEP} AND NOT coalesce({J('crc_score', 'DOUBLE')} BETWEEN 0 AND 1, false) THEN 'crc_score must be between 0 and 1'
        WHEN {DEEP} AND NOT coalesce({J('cc_score', 'DOUBLE')} BETWEEN 0 AND 1, false) THEN 'cc_score must be between 0 and 1' WHEN {DEEP} AND coalesce(json_extract_string(js, '$.memory_retrieval_quality'), 'none') NOT IN ('excellent', 'good', 'partial', 'poor', 'none') THEN 'memory_retrieval_quality is invalid'
        WHEN {DEEP} AND {J('uses_patient_specific_info', 'BOOLEAN')} IS NULL THEN 'uses_patient_specific_info must be boolean' END AS judge_error FROM jp),
    jd AS (SELECT *, CASE WHEN judge_error IS NULL THEN CASE WHEN {DEEP} THEN ({J('ncr_score', 'DOUBLE')} * 0.35 + {J('crc_score', 'DOUBLE')} * 0.35 + {J('cc_score', 'DOUBLE')} * 0.30) * CASE WHEN {J('uses_patient_specific_info', 'BOOLEAN')} THEN 1.0 ELSE 0.5 END
        * CASE json_extract_string(js, '$.memory_retrieval_quality') WHEN 'excellent' THEN 1.0 WHEN 'good' THEN 0.9 WHEN 'partial' THEN 0.7 WHEN 'poor' THEN 0.4 ELSE 0.1 END ELSE CASE WHEN {J('is_correct', 'BOOLEAN')} THEN 1.0 ELSE 0.0 END END END::DOUBLE AS judge_score FROM je)"""


@register(f"WITH {JUDGED} SELECT answer_id, judge_error, round(judge_score, 6) AS judge_score FROM jd")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' JSON, fenced or with words around it, as errors and scores."""
    return an.judged(answers(spark, sf_dir), "judge_json", F.col("task")).select("answer_id", "judge_error", F.round("judge_score", 6).alias("judge_score"))


METRIC = "CASE task " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in an.METRICS.items()) + " END"
BY_JUDGE = "metric IN ('llm_judge', 'llm_judge_mcd')"
SCORED = f"""{JUDGED}, dm AS (SELECT *, {METRIC} AS metric, {CONTAIN} AS ok_contain, {OPTION} AS ok_option FROM jd),
    ds AS (SELECT *, CASE WHEN memory_incomplete THEN 'skipped' WHEN run_failed THEN 'failed' WHEN metric IS NULL THEN 'skipped' ELSE 'scored' END AS status, {BY_JUDGE} AND (trim(output) = '' OR judge_error IS NOT NULL) AS zero FROM dm),
    sr AS (SELECT answer_id, subject_id, task, session_no, experiment, mock, latency, memory_incomplete, metric, status, output, gold, {BY_JUDGE} AND trim(output) <> '' AND judge_error IS NOT NULL AS judge_failed,
        CASE WHEN status = 'scored' THEN CASE WHEN metric = 'string_contain' THEN ok_contain WHEN metric = 'option_match' THEN ok_option WHEN zero THEN false ELSE {J('is_correct', 'BOOLEAN')} END END AS is_correct,
        CASE WHEN status = 'scored' THEN CASE WHEN zero THEN 0.0 WHEN {BY_JUDGE} THEN judge_score WHEN metric = 'string_contain' THEN CASE WHEN ok_contain THEN 1 ELSE 0 END ELSE CASE WHEN ok_option THEN 1 ELSE 0 END END END::DOUBLE AS score FROM ds)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.dispatched(answers(spark, sf_dir))


WRONG = "memory_incomplete OR status = 'failed' OR status = 'scored' AND is_correct = false"


@register(f"WITH {SCORED} SELECT answer_id, metric, status, is_correct, round(score, 6) AS score, coalesce({WRONG}, false) AS is_wrong FROM sr")
def dispatched_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer by the metric of its task: status, verdict, score, and whether it counts as wrong."""
    return scores(spark, sf_dir).select("answer_id", "metric", "status", "is_correct", F.round("score", 6).alias("score"), an.is_wrong().alias("is_wrong"))


@register(f"""WITH {SCORED} SELECT task, count(*) AS n, count(*) FILTER (status = 'scored') AS n_scored, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (judge_failed) AS n_judge_failed, count(*) FILTER (is_correct) AS n_correct,
    round(avg(CASE WHEN is_correct THEN 1.0 WHEN NOT is_correct THEN 0.0 END), 6) AS accuracy, round(avg(score), 6) AS mean_score, count(*) FILTER (coalesce({WRONG}, false)) AS n_wrong, count(*) FILTER (memory_incomplete) AS n_incomplete, round(avg(latency), 6) AS mean_latency FROM sr GROUP BY task""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("task").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "scored").alias("n_scored"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if("judge_failed").alias("n_judge_failed"), F.count_if("is_correct").alias("n_correct"),
        F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(an.is_wrong()).alias("n_wrong"), F.count_if("memory_incomplete").alias("n_incomplete"), F.round(F.avg("latency"), 6).alias("mean_latency"),
    )


@register(f"""WITH {SCORED}, t AS (SELECT experiment, task, round(avg(score), 6) AS m FROM sr WHERE status = 'scored' GROUP BY 1, 2), b AS (SELECT experiment, string_agg(task || '=' || printf('%.4f', m), ',' ORDER BY task) AS by_task FROM t GROUP BY 1)
    SELECT experiment, n_scored, mean_score, by_task, any_mock, array_to_string(list_filter([CASE WHEN n_scored < 700 THEN 'too few scored' END, CASE WHEN any_mock THEN 'mock answers' END], lambda x: x IS NOT NULL), ';') AS errors
    FROM (SELECT experiment, count(*) FILTER (status = 'scored') AS n_scored, round(avg(score), 6) AS mean_score, bool_or(mock) AS any_mock FROM sr GROUP BY 1) JOIN b USING (experiment)""")
def experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment how many answers are scored, their mean, means by task, mock answers, and what is missing for a report."""
    rows = scores(spark, sf_dir)
    means = rows.filter("status = 'scored'").groupBy("experiment", "task").agg(F.round(F.avg("score"), 6).alias("m"))
    by_task = means.groupBy("experiment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "m"))), lambda x: F.concat(x["task"], F.lit("="), F.format_string("%.4f", x["m"]))), ",").alias("by_task"))
    whole = rows.groupBy("experiment").agg(F.count_if(F.col("status") == "scored").alias("n_scored"), F.round(F.avg("score"), 6).alias("mean_score"), F.bool_or("mock").alias("any_mock"))
    errors = F.concat_ws(";", F.when(F.col("n_scored") < 700, "too few scored"), F.when(F.col("any_mock"), "mock answers"))
    return whole.join(by_task, "experiment").select("experiment", "n_scored", "mean_score", "by_task", "any_mock", errors.alias("errors"))


REASON = "CASE answer_id % 6 WHEN 0 THEN 'wrong format' WHEN 1 THEN 'safety: allergy' WHEN 2 THEN 'mechanism' ELSE 'differs' END"
FORMAT = f"CASE WHEN task = 'multiple_choice' THEN NOT regexp_matches(trim(output), '^[A-Z](?:,\\s*[A-Z])*$') WHEN task = 'temporal_localization' THEN NOT regexp_matches(trim(output), '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') WHEN {DEEP} THEN trim(output) = '' ELSE regexp_matches({REASON}, '(?i)格式|format|选项字母|timestamp|json') END"
SAME = f"regexp_replace(lower(output), '{fx.CLAIM_MARKS.replace(chr(39), chr(39) * 2)}', '', 'g') = regexp_replace(lower(gold), '{fx.CLAIM_MARKS.replace(chr(39), chr(39) * 2)}', '', 'g') AND output <> ''"
FAILED = "status = 'failed' OR is_correct = false OR score IS NULL OR score < 1"
CODES = f"""CASE WHEN NOT coalesce({FAILED}, true) THEN 'none' WHEN status = 'failed' OR judge_failed THEN 'X3' WHEN is_correct = false AND {SAME} THEN 'X2' WHEN memory_incomplete THEN 'X1' WHEN answer_id % 8 = 2 AND task IN {fx.TEMPORAL_TASKS} THEN 'H4' WHEN answer_id % 8 = 3 AND task IN {fx.COMPLEX_TASKS} THEN 'H5'
    WHEN answer_id % 16 = 5 THEN 'H6' WHEN answer_id % 16 = 6 THEN 'H7' WHEN {FORMAT} THEN 'M2' WHEN regexp_matches({REASON}, '{an.SAFETY}') THEN 'M5' WHEN answer_id % 16 = 7 THEN 'M1' WHEN regexp_matches({REASON}, '{an.KNOWLEDGE}') THEN 'M4' ELSE 'M3' END"""
ALL_CODES = ("H1", "H2", "H3", "H4", "H5", "H6", "H7", "M1", "M2", "M3", "M4", "M5", "X1", "X2", "X3")


def failure_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadline.functions import rules
    from threadline.operators.metrics import first_failure

    rows = scores(spark, sf_dir).withColumn("reason", F.expr(REASON))
    i, task, out = F.col("answer_id"), F.col("task"), F.col("output")
    failed = F.coalesce((F.col("status") == "failed") | ~F.col("is_correct") | F.col("score").isNull() | (F.col("score") < 1), F.lit(True))
    same = ~F.coalesce(F.col("is_correct"), F.lit(True)) & (rules.claim(out) == rules.claim(F.col("gold"))) & (out != "")
    code = first_failure([
        ("none", ~failed), ("X3", (F.col("status") == "failed") | F.col("judge_failed")), ("X2", same), ("X1", F.col("memory_incomplete")), ("H4", (i % 8 == 2) & task.isin(*fx.TEMPORAL_TASKS)), ("H5", (i % 8 == 3) & task.isin(*fx.COMPLEX_TASKS)),
        ("H6", i % 16 == 5), ("H7", i % 16 == 6), ("M2", an.format_failure(task, out, F.col("reason"))), ("M5", F.col("reason").rlike(an.SAFETY)), ("M1", i % 16 == 7), ("M4", F.col("reason").rlike(an.KNOWLEDGE)),
    ], "M3")
    return rows.select("answer_id", code.alias("code"))


@register(f"WITH {SCORED} SELECT answer_id, {CODES} AS code FROM sr")
def failure_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage at which an answer failed, in the order of stages; trace stages by the answer's number."""
    return failure_codes(spark, sf_dir)


@register(f"""WITH {SCORED}, c AS (SELECT {CODES} AS code FROM sr), k AS (SELECT code, count(*) AS n FROM c GROUP BY 1), z AS (SELECT unnest({list(ALL_CODES)}) AS code)
    SELECT z.code, CASE z.code[1:1] WHEN 'H' THEN 'harness' WHEN 'M' THEN 'model_foundation' ELSE 'external' END AS axis, coalesce(n, 0) AS n, z.code = (SELECT code FROM (SELECT z2.code, coalesce(k2.n, 0) AS n FROM (SELECT unnest({list(ALL_CODES)}) AS code) z2 LEFT JOIN k k2 USING (code)) WHERE code LIKE 'H%' ORDER BY n DESC, code LIMIT 1) AS is_target FROM z LEFT JOIN k USING (code)""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen codes with their counts, zeros included, and the harness code to work on next."""
    counted = failure_codes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))
    codes = spark.createDataFrame([(c,) for c in ALL_CODES], "code string")
    rows = codes.join(counted, "code", "left").select("code", F.when(F.substring("code", 1, 1) == "H", "harness").when(F.substring("code", 1, 1) == "M", "model_foundation").otherwise("external").alias("axis"), F.coalesce("n", F.lit(0)).alias("n"))
    target = rows.filter("code like 'H%'").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("target"))
    return rows.join(F.broadcast(target), F.lit(True)).select("code", "axis", "n", (F.col("code") == F.col("target")).alias("is_target"))


@register(f"""WITH {STATEMENTS}, r AS (SELECT state_id, task, string_split({ROUTE_SQL}, ',') AS route, 3 + state_id % 4 AS budget FROM st)
    SELECT state_id, len(route) <= budget AND list_has_all(route, CASE WHEN task IN {fx.COMPLEX_TASKS} THEN ['focus', 'verify', 'answer', 'trace', 'connect', 'evaluate'] WHEN task IN {fx.TEMPORAL_TASKS} THEN ['focus', 'verify', 'answer', 'trace'] ELSE ['focus', 'verify', 'answer'] END) AND route[len(route)] = 'answer' AS satisfied,
        CASE WHEN len(route) > budget THEN 'budget-exhausted' WHEN state_id % 3 = 0 THEN 'supported' ELSE 'uncertain' END AS outcome FROM r""")
def policy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a route meets its task's policy within its budget, and how it ends."""
    from threadline.functions import rules

    task = F.col("task")
    route = rules.desired_actions(task, rules.temporal_operator(F.col("text"), task))
    rows = statements(spark, sf_dir).select("state_id", "task", route.alias("route"), (3 + F.col("state_id") % 4).alias("budget"))
    outcome = F.when(F.size("route") > F.col("budget"), "budget-exhausted").when(F.col("state_id") % 3 == 0, "supported").otherwise("uncertain")
    return rows.select("state_id", an.policy_satisfied(task, F.col("route"), F.col("budget")).alias("satisfied"), outcome.alias("outcome"))


BINARY = "concat('{\"judgments\": [', CASE WHEN answer_id % 9 = 0 THEN '' ELSE concat('{\"qa_id\": \"', CAST(answer_id + CASE WHEN answer_id % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)), '\", \"score\": ', CASE answer_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.5' ELSE '1' END, '}') END, ']}')"


@register(f"""WITH {ANSWERS_SQL}, b AS (SELECT answer_id, {BINARY} AS js FROM an), e AS (SELECT answer_id, js, CASE WHEN json_array_length(js, '$.judgments') <> 1 THEN 'exactly one judgment' WHEN json_extract_string(js, '$.judgments[0].qa_id') <> CAST(answer_id AS VARCHAR) THEN 'qa_id differs'
    WHEN CAST(json_extract_string(js, '$.judgments[0].score') AS DOUBLE) NOT IN (0, 1) THEN 'score must be 0 or 1' END AS error FROM b) SELECT answer_id, error, CASE WHEN error IS NULL THEN CAST(json_extract_string(js, '$.judgments[0].score') AS DOUBLE) END AS score FROM e""")
def binary_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("answer_id", an.binary_judge(F.expr(BINARY), F.col("answer_id").cast("string")).alias("j"))
    return rows.select("answer_id", "j.error", "j.score")


RUBRIC = "concat('{\"scores\": {\"', CASE WHEN answer_id % 3 = 0 THEN 'Accuracy' ELSE 'accuracy' END, '\": ', CAST(answer_id % 6 AS VARCHAR(3)), ', \"completeness\": ', CASE WHEN answer_id % 11 = 0 THEN '7' ELSE '4.6' END, ', \"Temporal Consistency\": \"', CAST(answer_id % 4 AS VARCHAR(3)), '\", \"', CASE WHEN answer_id % 13 = 0 THEN 'other' ELSE 'no_hallucination' END, '\": true}}')"


@register(f"""WITH {ANSWERS_SQL}, b AS (SELECT answer_id, answer_id % 6 AS a, CASE WHEN answer_id % 11 = 0 THEN 7 ELSE 4 END AS c, answer_id % 4 AS t, CASE WHEN answer_id % 13 = 0 THEN NULL ELSE 1 END AS h FROM an)
    SELECT answer_id, CASE WHEN c > 5 THEN 'completeness must be an integer from 0 to 5' WHEN h IS NULL THEN 'no_hallucination must be an integer from 0 to 5' END AS error, CASE WHEN c <= 5 AND h IS NOT NULL THEN round((a + c + t + h) / 4.0, 3)::DOUBLE END AS mean FROM b""")
def rubric_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric marks under a dimension's name or another name for it, numbers, strings and booleans."""
    return answers(spark, sf_dir).select("answer_id", an.rubric(F.expr(RUBRIC)).alias("r")).select("answer_id", "r.error", "r.mean")
