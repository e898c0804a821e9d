"""What each step may read: allow-lists of columns, old fields removed at any depth, and a check that a query is blind to the rest."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Fields of older records that are no longer read, and the one that goes only below its parent.
REMOVED_FIELDS = ("derived", "normalization", "speaker", "normalized_entity", "numbers", "relation_hints", "checkpoint", "entity", "operation_reason", "derived_from")
REMOVED_BELOW = (("families", "reason"),)

# What an answering step, a judge of single answers, a judge of admissions and a judge by rubrics may read.
ANSWER_VIEW = ("task_id", "task_type", "case_id", "task_file", "full_session_file", "question", "input_to_model", "memory_source", "prompt_protocol")
QUERY_JUDGE_VIEW = ("query_type", "question", "expected_answer", "explanation", "metadata", "model_output")
ADMISSION_JUDGE_VIEW = ("qa_id", "question", "gold_answer", "candidate_answer")
RUBRIC_JUDGE_VIEW = (
    "task_id", "task_type", "case_id", "task_file", "full_session_file", "question", "input_to_model", "representative_point", "reference_answer", "answer_source", "evaluation_focus",
    "full_consultation_history", "official_rubric", "model_response", "dimensions",
)
RELATION_VIEW = ("task", "question", "target", "temporal_operator", "required_families", "states", "evidence")
#: Fields of the rubric judge that only some tasks show.
SHOWN_FOR = {
    "representative_point": ("session_level_response_generation",), "reference_answer": ("memory_recall", "temporal_causal_reasoning"), "answer_source": ("memory_recall",),
    "evaluation_focus": ("session_level_response_generation", "temporal_causal_reasoning"), "full_consultation_history": ("memory_recall", "temporal_causal_reasoning"),
}


def visible(rows: DataFrame, view: Collection[str]) -> DataFrame:
    """The columns of ``view`` and no others, in its order; a column that is not there is null text."""
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in view])


def answer_rows(tasks: DataFrame) -> DataFrame:
    """What is answered from: session replies see no memory."""
    memory = F.when(F.col("task_type") != "session_level_response_generation", F.col("memory_source")) if "memory_source" in tasks.columns else F.lit(None).cast("string")
    return visible(tasks.withColumn("memory_source", memory), ANSWER_VIEW)


def judge_rows(answers: DataFrame, gold: DataFrame, key: str, view: Collection[str]) -> DataFrame:
    """Answers that are already written, joined with what only a judge may see; where ``view`` holds fields that only some tasks show,
    they are null for the others. Columns of the gold that the answers have too are the answers'."""
    extra = gold.select(key, *[c for c in gold.columns if c not in answers.columns])
    rows = answers.join(extra, key)
    for name, tasks in SHOWN_FOR.items():
        if name in view and name in rows.columns and "task_type" in rows.columns:
            rows = rows.withColumn(name, F.when(F.col("task_type").isin(*tasks), F.col(name)))
    return visible(rows, view)


class LeakError(ValueError):
    """A query's result depends on a column that it may not read."""


def check_blind(query: Callable[[Mapping[str, DataFrame]], DataFrame], tables: Mapping[str, DataFrame], hidden: Mapping[str, Collection[str]]) -> DataFrame:
    """The result of ``query`` over ``tables``, if it is the same after all ``hidden`` columns became null; else LeakError.

    What counts is the result, so a hidden column is found behind renames, expressions and joins, and one that is read without
    effect passes. The query runs twice, both results are compared as multisets in one shuffle; it must be deterministic.
    """
    masked = {n: t.withColumns({c: F.lit(None).cast(t.schema[c].dataType) for c in hidden.get(n, ())}) for n, t in tables.items()}
    seen, blind = query(tables), query(masked)
    if seen.columns != blind.columns:
        raise LeakError("columns of the result depend on hidden columns")
    side = lambda df, n: df.select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256).alias("row"), F.lit(n).alias("n"))
    if not side(seen, 1).unionByName(side(blind, -1)).groupBy("row").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty():
        raise LeakError(f"the result depends on hidden columns: {', '.join(f'{t}.{c}' for t, cs in hidden.items() for c in cs)}")
    return seen


def without_fields(value: Column, kind: DataType, names: Collection[str] = REMOVED_FIELDS, below: Collection[tuple[str, str]] = REMOVED_BELOW, parent: str = "") -> Column | None:
    """``value`` of type ``kind`` without the fields ``names`` at any depth, in structures, arrays and the keys of maps; ``below``
    holds (parent, field) pairs that go only there. Nulls stay null. A structure all whose fields go is removed itself (None)."""
    if isinstance(kind, StructType):
        kept = []
        for field in kind.fields:
            if field.name not in names and (parent, field.name) not in below:
                inner = without_fields(value[field.name], field.dataType, names, below, field.name)
                if inner is not None:
                    kept.append(inner.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        if without_fields(F.lit(None), kind.elementType, names, below, parent) is None:
            return None
        return F.transform(value, lambda x: without_fields(x, kind.elementType, names, below, parent)) if _nested(kind.elementType) else value
    if isinstance(kind, MapType):
        gone = [*names, *(f for p, f in below if p == parent)]
        kept = F.map_filter(value, lambda k, v: ~k.isin(*gone)) if gone else value
        if not _nested(kind.valueType):
            return kept
        return None if without_fields(F.lit(None), kind.valueType, names, below) is None else F.transform_values(kept, lambda k, v: without_fields(v, kind.valueType, names, below))
    return value


def _nested(kind: DataType) -> bool:
    return isinstance(kind, (StructType, ArrayType, MapType))


def clean_rows(rows: DataFrame, names: Collection[str] = REMOVED_FIELDS, below: Collection[tuple[str, str]] = REMOVED_BELOW) -> DataFrame:
    """All columns without the removed fields; columns so named go too. Only the schema is walked, so the scan reads what stays."""
    out = {f.name: without_fields(F.col(f"`{f.name}`"), f.dataType, names, below, f.name) for f in rows.schema.fields if f.name not in names}
    return rows.select(*[c.alias(n) for n, c in out.items() if c is not None])
