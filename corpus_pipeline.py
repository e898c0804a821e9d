"""From raw documents to packed training sequences, in five stages, each written out before the next reads it.

Defined results of the stages: an empty table passes through all of them; other columns stay, whatever their names, up to
the last stage. A null or blank text fails the base rules and goes in the first stage; on its own the second keeps it, the
third takes it as the empty text (null ids first among equals), the fourth leaves null null, the last packs its end token.
Rows that repeat are judged alike; the third stage keeps one of each class, and one of rows alike in all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import line_crf, near_dups, packing, pseudonyms, toxicity
from threadline.llm.common import materialize, one_of_five, table
from threadline.llm.queries import word_bpe_path

#: The learned and iterative stages have no SQL form; the tests hold each stage against brute force on what it is given.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line labelling: documents that it rejects go."""
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.5 or more go."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), learnable=one_of_five() != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least id."""
    return near_dups.keep_one(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their format; n_chars follows the text."""
    out = pseudonyms.pseudonymize(docs, key=pseudonyms.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences in the order of the curve."""
    pieces = packing.pack(docs, word_bpe_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", civility), ("near_dedup", near_dedup), ("pii", privacy), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
