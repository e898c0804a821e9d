"""Turns to sessions: transcripts, blocks, chunks, ranges and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx


def turn_block(turn: Column, role: Column, text: Column) -> Column:
    """A turn as a headed block of a transcript."""
    return F.concat(F.lit("[Turn="), turn.cast("string"), F.lit("][Role="), role, F.lit("]\n"), text)


def transcripts(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """One row for each session: its blocks in order, joined by blank lines, with its number of turns.

    Turns are aggregated with their order key and sorted inside the row, so a session costs one shuffle and no window.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), turn_block(F.col(order), F.col(role), F.col(text)).alias("block"))))
    return turns.groupBy(session).agg(packed.alias("blocks")).select(session, F.size("blocks").cast("long").alias("n_turns"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("transcript"))


def transcript_blocks(sessions: DataFrame, session: str, transcript: str) -> DataFrame:
    """Parse transcripts back into (session, turn, role, n_chars)."""
    header = r"\[Turn=(\d+)\]\[Role=([^\]]+)\]\n"
    turns = F.regexp_extract_all(transcript, F.lit(header), F.lit(1))
    roles = F.regexp_extract_all(transcript, F.lit(header), F.lit(2))
    pieces = F.split(transcript, header, -1)
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    rows = sessions.select(session, F.explode(F.arrays_zip(turns.alias("turn"), roles.alias("role"), bodies.alias("body"))).alias("b"))
    return rows.select(session, F.col("b.turn").cast("long").alias("turn"), F.col("b.role").alias("role"), F.length(F.regexp_replace("b.body", r"\n\n\z", "")).cast("long").alias("n_chars"))


def placed_blocks(sessions: DataFrame, keys: list[str], transcript: str, roles: tuple[str, ...] = ("Patient", "Doctor", "Structured")) -> DataFrame:
    """Blocks of transcripts with their places, in characters from 0: keys, block_no, header_start, content_start, content_end (after
    the last character that is not white space), role, turn, event_time, content (with the white space at its end).

    Keys name one transcript each. A text without headers, an empty or null one has no blocks; what stands before the first header
    belongs to none. A header counts only at the start of a line and with one of ``roles``.
    """
    header, text = fx.TURN_HEADER.format(roles="|".join(roles)), F.coalesce(F.col(transcript), F.lit(""))
    group = lambda n: F.regexp_extract_all(text, F.lit(header), F.lit(n))
    pieces = F.split(text, header, -1)
    bodies = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    rows = sessions.select(*keys, F.length(pieces[0]).alias("first"), F.posexplode(F.arrays_zip(group(0).alias("header"), group(1).alias("turn"), group(2).alias("role"), group(3).alias("event_time"), bodies.alias("content"))))
    before = F.sum(F.length("col.header") + F.length("col.content")).over(W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("header_start", F.col("first") + F.coalesce(before, F.lit(0))).withColumn("content_start", F.col("header_start") + F.length("col.header"))
    end = F.col("content_start") + F.length(F.rtrim(F.col("col.content"), F.lit(fx.SPACES)))
    return placed.select(*keys, F.col("pos").cast("long").alias("block_no"), "header_start", "content_start", end.alias("content_end"), "col.role", "col.turn", F.nullif("col.event_time", F.lit("")).alias("event_time"), "col.content")


def span_contexts(spans: DataFrame, blocks: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Spans (keys, span_start, span_end and others) with the block that each starts in, header included, and whether it ends after
    that block; nulls for a span that starts outside all blocks.

    Blocks are entered under each stretch of ``width`` characters that they touch, so a span looks only at those of its stretch,
    and a long transcript is dealt over many tasks; no join by range.
    """
    names = ["block_no", "header_start", "content_start", "content_end", "role", "turn", "event_time"]
    stretch = lambda c: F.floor(c / width)
    entered = blocks.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(n).alias(f"block_{n}" if n != "block_no" else n) for n in names], F.explode(F.sequence(stretch(F.col("header_start")), stretch(F.col("content_end") - 1))).alias("__entered"))
    asked = spans.withColumn("__stretch", stretch(F.col("span_start")))
    same = (F.col("__stretch") == F.col("__entered")) & (F.col("span_start") >= F.col("block_header_start")) & (F.col("span_start") < F.col("block_content_end"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    found = asked.join(entered, same, "left")
    return found.withColumn("crosses", F.col("span_end") > F.col("block_content_end")).drop("__stretch", "__entered", *[f"__{k}" for k in keys])


def history_chunks(turns: DataFrame, session: str, order: str, text: str, size: int) -> DataFrame:
    """Number the non-blank turns of a session and cut them into chunks of ``size``."""
    at = F.row_number().over(W.partitionBy(session).orderBy(order)) - 1
    kept = turns.filter(F.trim(text) != "")
    return kept.withColumn("chunk_no", F.floor(at / size).cast("long") + 1).groupBy(session, "chunk_no").agg(F.count("*").alias("n_turns"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"))


def prefix_through(turns: DataFrame, session: str, order: str, is_noise: Column, last: int) -> DataFrame:
    """The prefix of a session up to its last regular turn not after ``last``; noise before it stays."""
    cut = F.max(F.when(~is_noise & (F.col(order) <= last), F.col(order))).over(W.partitionBy(session))
    return turns.withColumn("cutoff", cut).filter(F.col(order) <= F.col("cutoff"))


def session_ranges(turns: DataFrame, session: str, order: str, is_noise: Column) -> DataFrame:
    """Start and end of each regular turn's range; noise belongs to the next regular turn."""
    owner = F.first(F.when(~is_noise, F.col(order)), ignorenulls=True).over(W.partitionBy(session).orderBy(order).rowsBetween(0, W.unboundedFollowing))
    return turns.withColumn("owner", owner).filter("owner is not null").groupBy(session, "owner").agg(F.min(order).alias("range_start"), F.max(order).alias("range_end"))


def chained_hash(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """For each turn the SHA-256 of the hash before it and its text, so equal hashes mean equal prefixes; each text is read once."""
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    start = F.struct(F.lit("").alias("hash"), F.array().cast(f"array<struct<at:{turns.schema[order].dataType.simpleString()},hash:string>>").alias("out"))

    def step(acc: Column, turn: Column) -> Column:
        following = F.sha2(F.concat(acc["hash"], turn["text"]), 256)
        return F.struct(following.alias("hash"), F.concat(acc["out"], F.array(F.struct(turn["at"].alias("at"), following.alias("hash")))).alias("out"))

    chained = turns.groupBy(session).agg(texts.alias("texts")).select(session, F.explode(F.aggregate("texts", start, step)["out"]).alias("h"))
    return chained.select(session, F.col("h.at").alias(order), F.col("h.hash").alias("prefix_hash"))
