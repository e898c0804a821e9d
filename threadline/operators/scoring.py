"""Scores of answers against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_answer(text: Column) -> Column:
    """Lower case, only letters and digits of any script, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def contains_all(answer: Column, gold: Column) -> Column:
    """Whether the normal form of the answer contains that of every gold string."""
    return F.forall(gold, lambda g: normal_answer(answer).contains(normal_answer(g)))


def token_counts(rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
    tokens = F.filter(F.split(normal_answer(F.col(text)), " "), lambda t: t != "")
    return rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias(out))


def token_f1(rows: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """Multiset token F1 of each row: 0 where no token is shared."""
    p, g = token_counts(rows, key, predicted, "np"), token_counts(rows, key, gold, "ng")
    both = p.join(g, [key, "token"], "full_outer")
    sums = both.groupBy(key).agg(F.sum(F.coalesce(F.least("np", "ng") * (F.col("np").isNotNull() & F.col("ng").isNotNull()).cast("int"), F.lit(0))).alias("shared"), F.sum(F.coalesce("np", F.lit(0))).alias("np"), F.sum(F.coalesce("ng", F.lit(0))).alias("ng"))
    return sums.select(key, "shared", F.when(F.col("shared") > 0, F.round(2.0 * F.col("shared") / (F.col("np") + F.col("ng")), 6)).otherwise(0.0).alias("f1"))


def rubric_mean(scores: Column, low: int, high: int) -> Column:
    """Mean of the scores after each is clamped."""
    clamped = F.transform(scores, lambda s: F.greatest(F.lit(low), F.least(F.lit(high), s)))
    return F.aggregate(clamped, F.lit(0.0), lambda a, s: a + s) / F.size(scores)


def composite(ncr: Column, crc: Column, cc: Column, specific: Column, quality: Column) -> Column:
    """Weighted composite of three rates, halved where the answer is not specific, times a quality factor."""
    factor = F.when(quality == "excellent", 1.0).when(quality == "good", 0.9).when(quality == "partial", 0.7).when(quality == "poor", 0.4).when(quality == "none", 0.1).otherwise(0.5)
    return (ncr * 0.35 + crc * 0.35 + cc * 0.30) * F.when(specific, 1.0).otherwise(0.5) * factor
