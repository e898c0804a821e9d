"""Roll-ups of scores, completeness and failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_metrics(rows: DataFrame, groups: Sequence[str], correct: Column, score: Column) -> DataFrame:
    """Counts, accuracy over rows with a verdict and mean score over rows with a score."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.count(correct).alias("n_judged"), F.count_if(correct).alias("n_correct"), F.round(F.avg(correct.cast("int")), 6).alias("accuracy"), F.round(F.avg(score), 6).alias("mean_score"))


def scope_rollup(rows: DataFrame, scope: str, measures: Sequence[Column]) -> DataFrame:
    """Each scope and, as ``all``, the whole: one pass over grouping sets."""
    out = rows.rollup(scope).agg(F.grouping(scope).alias("whole"), *measures)
    return out.withColumn(scope, F.when(F.col("whole") == 1, "all").otherwise(F.col(scope))).drop("whole")


def completeness(expected: DataFrame, attempts: DataFrame, key: str, group: str, succeeded: Column) -> DataFrame:
    """Expected, attempted, succeeded, failed and unattempted of each group, and its status."""
    tried = attempts.groupBy(key).agg(F.bool_or(succeeded).alias("ok"))
    joined = expected.join(tried, key, "left")
    out = joined.groupBy(group).agg(F.count("*").alias("expected"), F.count("ok").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unattempted"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("unattempted") > 0, "partial").otherwise("complete"))


def first_failure(stages: Sequence[tuple[str, Column]], default: str) -> Column:
    """The code of the first stage whose test holds."""
    out = F.lit(default)
    for code, bad in reversed(stages):
        out = F.when(bad, F.lit(code)).otherwise(out)
    return out
