"""Canonical exact digests of texts.

A text is brought to NFKC, case-folded and its white space folded to single spaces and trimmed; the canonical
text is hashed to 128 bits (two xxHash64 values). Texts of equal digest are compared byte by byte: in a bucket that
holds different canonical texts (a collision) the fingerprint ends in the SHA-256 of the canonical text. Edited texts,
which are nowhere stored, are compared with all others of their bucket by that SHA-256.

Defined results: a null text counts as empty; repeated rows and ids are fingerprinted each by itself; ids of any
sortable type, nulls last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import materialize, shuffle_partitions, spread_join, text_or_empty

BUCKETS_PER_PARTITION = 2
MAX_BUCKETS = 1 << 15
#: Ids of another type than numbers that the cuts of their ranges are taken from, about.
SAMPLE = 1 << 14
#: Ids of documents in shared buckets are sent to all tasks up to this many (8 MB), joined by a shuffle beyond.
MAX_IDS = 1_000_000
#: A single plain space is left as it is: only runs and other white space are rewritten.
SPACE = r"[\s\x0B\x1C-\x1F\x85\u2028\u2029]"


def canonical(text: Column | str) -> Column:
    """NFKC (by the ICU classes that ship with Spark), case folding, white space to one space, trimmed."""
    name = text if isinstance(text, str) else None
    column = F.col(name) if name else text
    nfkc = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), column, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\x0B\x1C-\x1F\x85  ]+", " "))


def digest(canon: Column) -> Column:
    """128 bits in hex."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon)))


Digest = Callable[[Column], Column]


def with_digest(docs: DataFrame, text: str, canon: str, name: str, digest_of: Digest) -> DataFrame:
    """Canonical text once in a projection of its own, then its digest and SHA-256."""
    rows = docs.withColumn(canon, canonical(text))
    return rows.withColumn(name, digest_of(F.col(canon))).withColumn(f"{name}_sha", F.sha2(F.col(canon), 256))


def collisions(docs: DataFrame, digests: DataFrame, id_col: str, text_col: str, digest_of: Digest) -> DataFrame:
    """Digests of buckets that hold more than one canonical text of ``docs``; mostly none.

    Only documents of buckets with two rows or more are read again; each bucket is reduced to its least and
    greatest text on the map side, so a bucket of any size costs a task two texts.
    """
    shared = digests.groupBy("digest").count().filter("count > 1").select("digest")
    shared = materialize(shared, "shared")
    ids = materialize(spread_join(digests, shared, "digest", F.xxhash64(id_col), "left_semi").select(F.col(id_col).alias("shared_id")).distinct(), "shared-ids")
    again = docs.select(F.col(id_col).alias("shared_id"), text_or_empty(text_col).alias("text"))
    few = ids.count() <= MAX_IDS
    again = again.join(F.broadcast(ids) if few else ids, again["shared_id"].eqNullSafe(ids["shared_id"]), "left_semi")
    canon = again.select(canonical("text").alias("canon")).withColumn("digest", digest_of(F.col("canon")))
    return canon.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low <> high").select("digest")


def named(rows: DataFrame, mixed: DataFrame, column: str, fingerprint: str, spread_by: Column) -> DataFrame:
    """``fingerprint``: the digest, followed by the SHA-256 in a mixed bucket."""
    marked = spread_join(rows, mixed.select(F.col("digest").alias(column), F.lit(True).alias("__mixed")), column, spread_by, "left")
    return marked.withColumn(fingerprint, F.when(F.col("__mixed"), F.concat_ws("-", column, f"{column}_sha")).otherwise(F.col(column))).drop("__mixed")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_of: Digest = digest) -> DataFrame:
    """(id, fingerprint, n_same): the fingerprint and how many rows share it."""
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    marked = materialize(with_digest(base, "text", "canon", "digest", digest_of).select(id_col, "digest", "digest_sha"), "digests")
    mixed = materialize(collisions(docs, marked, id_col, text_col, digest_of), "collisions")
    rows = marked.withColumnRenamed("digest", "fingerprint") if mixed.isEmpty() else named(marked, mixed, "digest", "fingerprint", F.xxhash64(id_col))
    sizes = materialize(rows.groupBy("fingerprint").agg(F.count("*").alias("n_same")), "sizes")
    return spread_join(rows, sizes, "fingerprint", F.xxhash64(id_col)).select(id_col, "fingerprint", "n_same")


def range_cuts(docs: DataFrame, id_col: str) -> list:
    """Ids that part the rows into ranges of about equal size: quantiles of numbers, else of a sample by hash."""
    n = max(2, min(MAX_BUCKETS, BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession)))
    if isinstance(docs.schema[id_col].dataType, NumericType):
        found = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    else:
        every = max(1, docs.count() // SAMPLE)
        kept = sorted(r[0] for r in docs.select(id_col).filter(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).dropna().distinct().collect())
        found = [kept[i * len(kept) // n] for i in range(1, n)] if kept else []
    return sorted(set(found))


def range_of(column: Column, cuts: list) -> Column:
    """How many cuts lie below a value, by halving."""
    if not cuts:
        return F.lit(0)
    steps = F.lit([1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.lit(cuts), at + step - 1) < column, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Each row with ``next_*`` of the row that follows in descending id order (nulls last), the first after the last.

    Rows are dealt to id ranges; a range's last row takes the first row of the next range from a table of one
    row for each range, so nothing passes through a single task.
    """
    bucket = range_of(F.col(id_col), range_cuts(docs, id_col))
    place = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(bucket)
    order = [F.col(id_col).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns]]
    inner = W.partitionBy("bucket").orderBy(*order)
    last = F.lead(F.lit(True)).over(inner).isNull()
    rows = docs.withColumn("bucket", place).select("*", *[F.lead(c).over(inner).alias(f"next_{c}") for c in columns], last.alias("is_last"))
    # The first row of each range: its greatest id, and of rows of that id the one that the order puts first.
    top_ids = docs.select(id_col).withColumn("bucket", place).groupBy("bucket").agg(F.max(id_col).alias("top_id"))
    tops = docs.withColumn("bucket", place).join(F.broadcast(top_ids), "bucket").filter(F.col(id_col).eqNullSafe(F.col("top_id")))
    heads = tops.groupBy("bucket").agg(F.max(F.struct(*columns)).alias("head"))
    # One row for each range, MAX_BUCKETS at most, so this window without a partition is bounded.
    ring = W.orderBy(F.col("bucket").desc())
    first = F.first("head").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(ring), first).alias("head"))
    joined = rows.join(heads.hint("merge"), "bucket", "left")
    return joined.select(*docs.columns, *[F.when(F.col("is_last"), F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns])


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_of: Digest = digest) -> DataFrame:
    """The fingerprint of every text and of its edited text, whose last half is replaced by the next document's start."""
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    hashed = with_digest(base, "text", "canon", "digest", digest_of).drop("canon")
    pairs = with_next(hashed, id_col, ["text", "digest"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    pairs = pairs.select("*", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    pairs = with_digest(pairs, "edited", "edited_canon", "edited_digest", digest_of)
    # Bytes are compared only where digests are equal, so the canonical text is not made again elsewhere.
    same = lambda equal, other: F.when(F.col(equal) != F.col("digest"), 0.0).otherwise((canonical("text") == other).cast("double"))
    pairs = pairs.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digest", "digest_sha", "edited_digest", "edited_digest_sha", same("edited_digest", F.col("edited_canon")).alias("near_edited"), same("next_digest", canonical("next_text")).alias("near_next"))
    pairs = materialize(pairs, "digests")
    both = pairs.select("digest", F.col("digest_sha").alias("sha")).union(pairs.select("edited_digest", "edited_digest_sha"))
    unlike = both.groupBy("digest").agg(F.min("sha").alias("low"), F.max("sha").alias("high")).filter("low <> high").select("digest")
    mixed = materialize(collisions(docs, pairs.select(id_col, "digest"), id_col, text_col, digest_of).union(unlike).distinct(), "collisions")
    if mixed.isEmpty():
        pairs = pairs.withColumnsRenamed({"digest": "fingerprint", "edited_digest": "edited_fingerprint"})
    else:
        pairs = named(named(pairs, mixed, "digest", "fingerprint", F.xxhash64(id_col)), mixed, "edited_digest", "edited_fingerprint", F.xxhash64(id_col))
    return pairs.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
