"""Postings, blocked scoring and ranking of records for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.operators.tables import numbered


def postings(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, key, n): how often a record has a term."""
    return rows.select(key, F.explode(terms).alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))


# What counts as a term: words of three characters or more, numbers with a unit, two to eight Han characters.
TERM = r"[a-z][a-z0-9.+-]{2,}|[0-9]+(?:\.[0-9]+)?(?:%|mg|kg|mmol/l)?|\p{IsHan}{2,8}"
#: Terms of queries that are sent to all tasks; beyond, records and queries meet by a shuffle on salted terms.
MAX_QUERY_TERMS, SALTS = 1_000_000, 32


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def lexical_hits(queries: DataFrame, query: str, records: DataFrame, record: str, cap: int) -> DataFrame:
    """(query, record, hits, n_terms, score): distinct terms (columns ``terms``) that both have; score 5 for each hit to ``cap``.

    The queries are a stated set: their terms go to the records, whose pairs are counted where the record lies before
    anything is shuffled. No term is too frequent to count.
    """
    q = queries.select(query, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    r = records.select(record, F.explode("terms").alias("term"))
    if q.count() <= MAX_QUERY_TERMS:
        met = r.join(F.broadcast(q), "term")
    else:
        copies = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = r.withColumn("salt", F.pmod(F.xxhash64(record), F.lit(SALTS)).cast("int")).join(copies, ["term", "salt"])
    hits = met.groupBy(query, record).agg(F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
    return hits.withColumn("score", F.round(5.0 * F.least("hits", F.lit(cap)), 3))


def top_k(scored: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The best k of each group with their places; Spark drops the rest before the shuffle (group limit)."""
    w = W.partitionBy(*group).orderBy(*order)
    return scored.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k)


def interleave(rows: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """``round`` and ``place``: the first of each source by rank, then the second of each, and so on; sources in the order of
    their first. A source or a round of any size is spread over all tasks."""
    ranked = numbered(rows, [], order, "rank")
    ranked = numbered(ranked, [source], [F.asc("rank")], "round")
    firsts = ranked.groupBy(F.col(source).alias("first_source")).agg(F.min("rank").alias("source_rank"))
    turns = ranked.join(firsts, F.col(source).eqNullSafe(F.col("first_source"))).drop("first_source")
    return numbered(turns, [], [F.asc("round"), F.asc("source_rank")], "place").drop("rank", "source_rank")


def merge_duplicates(rows: DataFrame, same: Column, key: str, score: Column) -> DataFrame:
    """One row for each set of equal content: its best member (score, then least key), its size and its least key."""
    keyed = rows.withColumn("same", same).withColumn("score", score)
    best = F.min_by(F.col(key), F.struct(-F.col("score"), F.col(key)))
    return keyed.groupBy("same").agg(best.alias("best_id"), F.max("score").alias("best_score"), F.count("*").alias("members"), F.min(key).alias("first_id")).drop("same")
