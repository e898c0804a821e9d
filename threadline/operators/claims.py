"""Statements of patients that they stopped a drug, found in their turns and added where the evidence of a session lacks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules


def cut(rows: DataFrame, by: list[str], text: str, start: str, marks: str, name: str) -> DataFrame:
    """``text`` cut after each of ``marks`` (line breaks too, if among them), as ``name`` with ``name``_start, its place; pieces of
    marks alone are left out."""
    whole = rf"[^{marks}]+(?:[{marks}&&[^\n]])?|[{marks}]"
    rows = rows.select("*", F.posexplode(F.regexp_extract_all(text, F.lit(whole), F.lit(0))).alias("__pos", name))
    before = F.sum(F.length(name)).over(W.partitionBy(*by).orderBy("__pos").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(f"{name}_start", F.col(start) + F.coalesce(before, F.lit(0))).drop("__pos").filter(~F.col(name).rlike(rf"^[{marks}]$"))


def is_stop_claim(text: Column) -> Column:
    """No question, nothing that leaves it open, one drug, and the words of a stop that has happened."""
    return text.rlike(fx.STOP_CLAIM) & ~text.rlike("[?？]") & rules.has(text, fx.STOPPED) & (F.size(rules.medications(text)) == 1) & (F.size(rules.claim_guards(text)) == 0)


def stop_claims(blocks: DataFrame, keys: list[str], patient: str = "Patient") -> DataFrame:
    """(keys, turn, medication, claim_start, claim_end, claim) from the patient's blocks (see ``sessions.placed_blocks``).

    A claim is a clause, or a sentence none of whose clauses is one. Sentences that name several drugs, correct themselves or tell
    of several actions give none, nor does a claim that the rest of its turn corrects or whose drug it resumes. Of equal claims of
    a turn the shortest stays, of equally long ones the first. Only blocks that hold the words at all are cut.
    """
    said = blocks.filter(F.col("role") == patient).filter(F.col("content").rlike("把") & F.col("content").rlike("停(?:了|掉了)")).select(*keys, "block_no", "turn", "content_start", F.rtrim(F.col("content"), F.lit(fx.SPACES)).alias("content"))
    by = [*keys, "block_no"]
    sentences = cut(said, by, "content", "content_start", r"。！？!?\n", "sentence").filter(~rules.unsafe_claim(F.col("sentence")))
    clauses = cut(sentences, [*by, "sentence_start"], "sentence", "sentence_start", "，,；;", "clause")
    window = W.partitionBy(*by, "sentence_start")
    bare = lambda c: F.trim(F.col(c), F.lit(fx.SPACES))
    one = lambda c: F.struct(bare(c).alias("claim"), (F.col(f"{c}_start") + F.length(c) - F.length(F.ltrim(F.col(c), F.lit(fx.SPACES)))).alias("at"))
    told = clauses.withColumn("__told", is_stop_claim(bare("clause"))).withColumns({"__any": F.max("__told").over(window), "__least": F.min("clause_start").over(window)})
    whole = ~F.col("__any") & (F.col("clause_start") == F.col("__least")) & is_stop_claim(bare("sentence"))
    rows = told.withColumn("__c", F.when(F.col("__told"), one("clause")).when(whole, one("sentence"))).filter("__c is not null").withColumn("claim_end", F.col("__c.at") + F.length("__c.claim"))
    rest = F.substring("content", F.col("claim_end") - F.col("content_start") + 1, F.length("content"))
    kept = rows.filter(~rules.has(rest, fx.CLAIM_CORRECTION) & ~rules.has(rest, fx.CLAIM_KINDS["restarted"])).withColumn("medication", rules.medications(F.col("__c.claim"))[0])
    shortest = F.min_by(F.struct("__c.at", "claim_end", "__c.claim"), F.struct(F.length("__c.claim"), "__c.at"))
    return kept.groupBy(*keys, "turn", "medication").agg(shortest.alias("__s")).select(*keys, "turn", "medication", F.col("__s.at").cast("long").alias("claim_start"), F.col("__s.claim_end").cast("long").alias("claim_end"), F.col("__s.claim").alias("claim"))


def record_text(claim: Column) -> Column:
    """A claim as the record puts it."""
    for pattern, by in fx.STOP_WORDS:
        claim = F.regexp_replace(claim, pattern, by)
    return rules.atomic(F.trim(claim), F.lit("patient"))


def missing_claims(claims: DataFrame, evidence: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Claims whose drug no confirmed evidence of the same keys says to be stopped, the first of each drug, with ``text`` for the record."""
    sure = evidence.filter(~F.col(text).rlike("[?？]") & (F.size(rules.claim_guards(F.col(text))) == 0) & rules.has(F.col(text), fx.STOPPED))
    covered = sure.select(*keys, F.explode(rules.medications(F.col(text))).alias("medication")).distinct()
    left = claims.join(covered, [*keys, "medication"], "left_anti")
    first = left.groupBy(*keys, "medication").agg(F.min_by(F.struct("turn", "claim_start", "claim_end", "claim"), "claim_start").alias("__first")).select(*keys, "medication", "__first.*")
    return first.withColumns({"status": F.lit("stopped"), "record": record_text(F.col("claim"))})
