"""Scores of answers: containment, options, token F1 with comma parts, judges' JSON, rubrics, dispatch by task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.functions.text import nfkc_lower

# The metric of each task, judges' quality factors, rubric dimensions with other names for them.
METRICS = {"entity_exact_match": "string_contain", "temporal_localization": "llm_judge", "state_update": "llm_judge", "multiple_choice": "option_match", "inference_generation": "llm_judge", "multi_hop_clinical_deduction": "llm_judge_mcd"}
QUALITY = {"excellent": 1.0, "good": 0.9, "partial": 0.7, "poor": 0.4, "none": 0.1}
ALTERNATIVES = {"++": ("session_100_eem_2",)}
DIMENSIONS = {
    "accuracy": ("Accuracy",), "completeness": ("Completeness",), "temporal_consistency": ("Temporal Consistency", "temporal consistency", "TemporalConsistency"),
    "no_hallucination": ("No Hallucination", "no hallucination", "NoHallucination"),
}


def entity_parts(text: Column) -> tuple[Column, Column]:
    """Latin words in order of the alphabet, and the rest in the normal form of answers."""
    low = nfkc_lower(text)
    return F.array_sort(F.regexp_extract_all(low, F.lit("[a-z][a-z0-9]*"), F.lit(0))), rules.official_answer(F.regexp_replace(low, "[a-z][a-z0-9]*", ""))


def matches_entity(output: Column, gold: Column) -> Column:
    """Containment after normalisation, or the same Latin words in any order around the same other characters."""
    expected = rules.official_answer(gold)
    latin, other = entity_parts(output)
    gold_latin, gold_other = entity_parts(gold)
    reordered = (F.size(latin) > 0) & (latin == gold_latin) & (gold_other != "") & F.contains(other, gold_other)
    return ((expected != "") & F.contains(rules.official_answer(output), expected)) | reordered


def string_contain(output: Column, golds: Column, answer_id: Column | None = None) -> Column:
    """All gold entities are there, or a registered alternative of the question."""
    right = (F.size(golds) > 0) & F.forall(golds, lambda g: matches_entity(output, g))
    if answer_id is not None:
        for text, ids in ALTERNATIVES.items():
            right = right | (answer_id.isin(*ids) & matches_entity(output, F.lit(text)))
    return F.coalesce(right, F.lit(False))


def option_match(output: Column, golds: Column) -> Column:
    """The letters chosen are those of the gold answers: their leading letter, else all letters in them."""
    lead = lambda g: F.regexp_extract(F.upper(g), r"^([A-F])[.、:\s]", 1)
    correct = F.flatten(F.transform(golds, lambda g: F.when(lead(g) != "", F.array(lead(g))).otherwise(rules.option_letters(g))))
    return rules.option_letters(output) == F.array_sort(F.array_distinct(correct))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def tokens_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda x: x != "")


def shared_f1(p: Column, g: Column) -> Column:
    """F1 of two lists of tokens: each distinct token counts as often as both have it."""
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, w: acc + F.least(times(p, w), times(g, w)))
    return bound(shared, lambda n: F.when(n > 0, 2.0 * n / (F.size(p) + F.size(g))).otherwise(0.0))


def multiset_f1(a: Column, b: Column) -> Column:
    """Token F1 of two normal answers."""
    return bound(F.struct(tokens_of(a).alias("p"), tokens_of(b).alias("g")), lambda t: shared_f1(t["p"], t["g"]))


def token_f1(predicted: Column, gold: Column) -> Column:
    """Of the whole answers; where one has a comma the better of that and the harmonic mean of the parts' best matches."""
    whole = multiset_f1(rules.plain_answer(predicted), rules.plain_answer(gold))
    parts = lambda t: F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    p, g = parts(predicted), parts(gold)
    lists = lambda xs: F.transform(xs, lambda x: tokens_of(rules.plain_answer(x)))
    mean_best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: shared_f1(x, y)))), F.lit(0.0), lambda acc, v: acc + v) / F.size(xs)
    harmonic = lambda r: F.when(r["p"] + r["r"] > 0, 2 * r["p"] * r["r"] / (r["p"] + r["r"])).otherwise(0.0)
    comma = bound(F.struct(lists(p).alias("p"), lists(g).alias("g")), lambda t: bound(F.struct(mean_best(t["p"], t["g"]).alias("p"), mean_best(t["g"], t["p"]).alias("r")), harmonic))
    split = (F.contains(predicted, F.lit(",")) | F.contains(gold, F.lit(","))) & (F.size(p) > 0) & (F.size(g) > 0)
    return F.when(split, F.greatest(whole, comma)).otherwise(whole)


JUDGE = "is_correct BOOLEAN, ncr_score DOUBLE, crc_score DOUBLE, cc_score DOUBLE, memory_retrieval_quality STRING, uses_patient_specific_info BOOLEAN"


def unfenced(raw: Column) -> Column:
    """JSON text without a code fence around it; else its first object to the last closing brace."""
    plain = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1"))
    return F.when(plain.startswith("{"), plain).otherwise(F.regexp_extract(plain, r"(?s)(\{.*\})", 1))


def judged(rows: DataFrame, raw: str, task: Column) -> DataFrame:
    """``judge_error`` (null if valid) and ``judge_score`` of a judge's JSON for the task."""
    j = F.from_json(unfenced(F.col(raw)), JUDGE)
    deep = task == "multi_hop_clinical_deduction"
    rate = lambda c: c.isNull() | ~c.between(0, 1)
    rows = rows.withColumn("__j", j)
    c = lambda n: F.col(f"__j.{n}")
    quality = F.coalesce(c("memory_retrieval_quality"), F.lit("none"))
    error = (
        F.when(c("is_correct").isNull(), "is_correct must be boolean").when(deep & rate(c("ncr_score")), "ncr_score must be between 0 and 1").when(deep & rate(c("crc_score")), "crc_score must be between 0 and 1")
        .when(deep & rate(c("cc_score")), "cc_score must be between 0 and 1").when(deep & ~quality.isin(*QUALITY), "memory_retrieval_quality is invalid").when(deep & c("uses_patient_specific_info").isNull(), "uses_patient_specific_info must be boolean")
    )
    factor = F.lit(0.5)
    for name, value in QUALITY.items():
        factor = F.when(quality == name, value).otherwise(factor)
    mcd = (c("ncr_score") * 0.35 + c("crc_score") * 0.35 + c("cc_score") * 0.30) * F.when(c("uses_patient_specific_info"), 1.0).otherwise(0.5) * factor
    rows = rows.withColumn("judge_error", error)
    score = F.when(F.col("judge_error").isNull(), F.when(deep, mcd).otherwise(c("is_correct").cast("double")))
    return rows.withColumn("judge_score", score).withColumn("judge_correct", F.when(F.col("judge_error").isNull(), c("is_correct"))).drop("__j")


def binary_judge(raw: Column, expected_id: Column) -> Column:
    """struct(score, error) of ``{"judgments": [{"qa_id", "score"}]}``: exactly one, of that id, 0 or 1."""
    j = F.from_json(raw, "judgments ARRAY<STRUCT<qa_id: STRING, score: DOUBLE>>")["judgments"]
    one = F.get(j, F.lit(0))
    error = F.when(j.isNull(), "judgments must be an array").when(F.size(j) != 1, "exactly one judgment").when(~one["qa_id"].eqNullSafe(expected_id), "qa_id differs").when(~F.coalesce(one["score"].isin(0.0, 1.0), F.lit(False)), "score must be 0 or 1")
    return F.struct(F.when(error.isNull(), one["score"]).alias("score"), error.alias("error"))


def rubric(raw: Column) -> Column:
    """struct(mean, error) of ``{"scores": {...}}``: whole numbers 0 to 5 under a dimension's name or another name for it; the
    mean has three decimals."""
    scores = F.from_json(raw, "scores MAP<STRING, STRING>")["scores"]
    picked = [F.coalesce(*[F.try_element_at(scores, F.lit(n)) for n in (name, *others)]) for name, others in DIMENSIONS.items()]
    # Finite numbers are truncated, booleans count as 0 and 1, other strings are no marks.
    whole = lambda v: F.when(v.isin("true", "false"), (v == "true").cast("int")).when(v.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), F.trim(v).try_cast("double").cast("int"))
    marks = [whole(p) for p in picked]
    error = F.when(scores.isNull(), "scores must be an object")
    for name, m in zip(DIMENSIONS, marks, strict=True):
        error = error.when(m.isNull() | ~m.between(0, 5), f"{name} must be an integer from 0 to 5")
    total = marks[0]
    for m in marks[1:]:
        total = total + m
    return F.struct(F.when(error.isNull(), F.round(total / len(marks), 3)).alias("mean"), error.alias("error"))


def contains_either(output: Column, golds: Column) -> Column:
    """Containment in either direction with some gold string."""
    a = F.trim(F.lower(output))
    return F.exists(golds, lambda g: (F.trim(F.lower(g)) != "") & (a != "") & (F.contains(a, F.trim(F.lower(g))) | F.contains(F.trim(F.lower(g)), a)))


def dispatched(rows: DataFrame) -> DataFrame:
    """metric, status and score of answers (answer_id, task, output, golds, judge_json, run_failed, memory_incomplete)."""
    task, output = F.col("task"), F.col("output")
    metric = F.lit(None).cast("string")
    for name, m in METRICS.items():
        metric = F.when(task == name, m).otherwise(metric)
    rows = judged(rows.withColumn("metric", metric), "judge_json", task)
    by_judge = F.col("metric").isin("llm_judge", "llm_judge_mcd")
    empty = F.trim(F.coalesce(output, F.lit(""))) == ""
    status = F.when(F.col("memory_incomplete"), "skipped").when(F.col("run_failed"), "failed").when(F.col("metric").isNull(), "skipped").otherwise("scored")
    correct = F.when(F.col("metric") == "string_contain", string_contain(output, F.col("golds"), F.col("answer_id").cast("string"))).when(F.col("metric") == "option_match", option_match(output, F.col("golds"))).when(by_judge & (empty | F.col("judge_error").isNotNull()), F.lit(False)).when(by_judge, F.col("judge_correct"))
    score = F.when(by_judge & (empty | F.col("judge_error").isNotNull()), 0.0).when(by_judge, F.col("judge_score")).otherwise(correct.cast("double"))
    scored = status == "scored"
    return rows.withColumns({"status": status, "is_correct": F.when(scored, correct), "score": F.when(scored, score), "judge_failed": by_judge & ~empty & F.col("judge_error").isNotNull()})


def is_wrong(status: str = "status") -> Column:
    """Incomplete, failed, or scored and not correct."""
    return F.col("memory_incomplete") | (F.col(status) == "failed") | ((F.col(status) == "scored") & ~F.coalesce(F.col("is_correct"), F.lit(True)))


def format_failure(task: Column, output: Column, reason: Column) -> Column:
    out = F.trim(F.coalesce(output, F.lit("")))
    return F.when(task == "multiple_choice", ~out.rlike(r"^[A-Z](?:,\s*[A-Z])*$")).when(task == "temporal_localization", ~out.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")).when(task == "multi_hop_clinical_deduction", out == "").otherwise(reason.rlike("(?i)格式|format|选项字母|timestamp|json"))


SAFETY = "(?i)安全|禁忌|过敏|危险|伤害|safety|contraindicat|allerg|harm"
KNOWLEDGE = "(?i)机制|病理|药理|诊断|临床知识|medical|mechanism|pathophysi|pharmacol"


def policy_satisfied(task: Column, actions: Column, budget: Column) -> Column:
    """All steps that the task needs, an answer at the end, within the budget."""
    needed = F.when(task.isin(*fx.COMPLEX_TASKS), F.array(*map(F.lit, ("focus", "verify", "answer", "trace", "connect", "evaluate")))).when(task.isin(*fx.TEMPORAL_TASKS), F.array(*map(F.lit, ("focus", "verify", "answer", "trace")))).otherwise(F.array(*map(F.lit, ("focus", "verify", "answer"))))
    return (F.size(F.array_except(needed, actions)) == 0) & (F.element_at(actions, -1) == "answer") & (F.size(actions) <= budget)
