"""JSON that came cut or wrapped, canonical JSON, clauses with their places, and quotations found again in their texts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import rules


def complete_objects(text: str | None, field: str = "evidence") -> list[str]:
    """The whole objects of a JSON array under ``field`` whose end may be missing, each as JSON; what is cut is left out."""
    start = re.search(rf'"{re.escape(field)}"\s*:\s*\[', text or "")
    found: list[str] = []
    if start is None:
        return found
    decoder, at = json.JSONDecoder(), start.end()
    while True:
        at = re.compile(r"[\s,]*").match(text, at).end()
        if at >= len(text) or text[at] != "{":
            return found
        try:
            item, end = decoder.raw_decode(text, at)
        except ValueError:
            return found
        found.append(json.dumps(item, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        at = end


def recover(rows: DataFrame, key: str, raw: str, field: str = "evidence") -> DataFrame:
    """(key, objects): JSON that parses is read by the engine; only the rest goes through Python workers."""
    shape = f"{field} ARRAY<STRING>"
    parsed = F.from_json(raw, shape, {"mode": "PERMISSIVE"})[field]
    whole = F.try_parse_json(raw).isNotNull()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([complete_objects(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, "objects"])

    good = rows.filter(whole).select(key, F.coalesce(parsed, F.array().cast("array<string>")).alias("objects"))
    cut = rows.filter(~F.coalesce(whole, F.lit(False))).select(key, raw).mapInArrow(run, f"`{key}` {kind}, objects array<string>")
    return good.withColumn("repaired", F.lit(False)).union(cut.withColumn("repaired", F.lit(True)))


def envelope(raw: Column) -> Column:
    """The items of an output that may be an array, or an object with them under one of two names."""
    shape = "ARRAY<STRUCT<text: STRING, statement: STRING>>"
    wrapped = F.from_json(raw, f"evidence {shape}, atomic_evidence {shape}")
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, shape)).otherwise(F.coalesce(wrapped["evidence"], wrapped["atomic_evidence"]))


def stable_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


SENTENCE = r"[^。！？!?;；\n]+[。！？!?;；]?"
CLAUSE_BORDER = r"(?i)(?:，|,|\band\b|而且|并且|所以|because|but|但是)"


def clauses(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, clause, start, end): clauses of two characters or more with their places in the text (from 0).

    A clause is found from where the one before it ended, so a repeated clause gets its own place.
    """
    parts = F.flatten(F.transform(rules.found(F.col(text), SENTENCE), lambda s: F.split(F.trim(s), rules.java(CLAUSE_BORDER))))
    kept = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 1)
    none = F.array().cast("array<struct<clause:string,start:int,end:int>>")

    def put(acc: Column, clause: Column) -> Column:
        at = F.call_function("locate", clause, F.col(text), acc["end"] + 1) - 1
        return F.struct((at + F.length(clause)).cast("int").alias("end"), F.concat(acc["out"], F.array(F.struct(clause.alias("clause"), at.cast("int").alias("start"), (at + F.length(clause)).cast("int").alias("end")))).alias("out"))

    found = F.aggregate(kept, F.struct(F.lit(0).alias("end"), none.alias("out")), put)["out"]
    return rows.select(key, F.posexplode(found).alias("nth", "c")).select(key, F.col("nth").cast("long").alias("nth"), F.col("c.clause").alias("clause"), F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"))


def plain_form(text: str) -> tuple[str, list[int]]:
    """Lower-case NFKC letters, digits and marks inside numbers, and the place of each in the text."""
    out, places = [], []
    for i, c in enumerate(text):
        inner = c in ".:/-+~" and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()
        if c.isspace() or unicodedata.category(c)[0] in "PS" and not inner and c != "%":
            continue
        for x in unicodedata.normalize("NFKC", c).lower():
            out.append(x)
            places.append(i)
    return "".join(out), places


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance, or more than ``limit`` where it is."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > limit:
            return limit + 1
    return row[-1]


def distances(a: str, text: str, start: int, end: int) -> list[int]:
    """Edit distances of ``a`` to the runs of ``text`` from ``start`` of every length up to ``end``, in one pass (Myers, Hyyrö)."""
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    equal: dict[str, int] = {}
    for i, x in enumerate(a):
        equal[x] = equal.get(x, 0) | 1 << i
    up, down, far = full, 0, len(a)
    out = [far]
    for c in text[start:end]:
        eq = equal.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | full & ~(across | up), up & across
        far += 1 if more & high else -1 if less & high else 0
        out.append(far)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical & full
    return out


def align_quote(text: str | None, quote: str | None, threshold: float = 0.92, margin: float = 0.03) -> tuple[str, int, int, float]:
    """(level, start, end, score): the only exact place, else the only one but for white space and marks, else the best
    fuzzy one of at least ``threshold`` that leads the next place by ``margin``; ("none", -1, -1, 0.0) otherwise."""
    text, quote = text or "", quote or ""
    none = ("none", -1, -1, 0.0)
    at = text.find(quote) if quote else -1
    if at >= 0 and text.find(quote, at + 1) < 0:
        return "exact", at, at + len(quote), 1.0
    source, places = plain_form(text)
    target, _ = plain_form(quote)
    if not target or not source:
        return none
    at = source.find(target)
    if at >= 0:
        return ("formatting", places[at], places[at + len(target) - 1] + 1, 1.0) if source.find(target, at + 1) < 0 else none
    if len(target) < 8:
        return none
    size = min(6, max(3, len(target) // 4))
    slack = max(2, min(8, -(-len(target) * 8 // 100)))
    starts = set()
    for offset in (0, (len(target) - size) // 2, len(target) - size):
        at = source.find(target[offset : offset + size])
        while at >= 0:
            starts.update(range(max(0, at - offset - slack), at - offset + slack + 1))
            at = source.find(target[offset : offset + size], at + 1)
    best: dict[int, tuple[float, int]] = {}
    for start in starts:
        # A run's distances of all lengths come from one pass over it.
        for length, far in enumerate(distances(target, source, start, start + len(target) + slack)):
            score = 1 - far / max(length, len(target))
            if length >= max(1, len(target) - slack) and score >= threshold and score > best.get(start, (0.0, 0))[0]:
                best[start] = score, length
    if not best:
        return none
    first = min(best, key=lambda s: (-best[s][0], s))
    score, length = best[first]
    # Another place is one that does not overlap the best.
    if any(best[s][0] > score - margin for s in best if s >= first + length or s + best[s][1] <= first):
        return none
    return "fuzzy", places[first], places[first + length - 1] + 1, round(score, 6)


def aligned_quotes(rows: DataFrame, key: str, text: str, quote: str) -> DataFrame:
    """(key, level, start, end, score) of each row's quotation in its text; places that are exact and single need no Python."""
    at = F.call_function("locate", F.col(quote), F.col(text))
    single = (at > 0) & (F.call_function("locate", F.col(quote), F.col(text), at + 1) == 0) & (F.length(quote) > 0)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(zip(*(align_quote(t, q) for t, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)]], names=[key, "level", "start", "end", "score"])

    exact = rows.filter(single).select(key, F.lit("exact").alias("level"), (at - 1).cast("long").alias("start"), (at - 1 + F.length(quote)).cast("long").alias("end"), F.lit(1.0).alias("score"))
    rest = rows.filter(~F.coalesce(single, F.lit(False))).select(key, text, quote).mapInArrow(run, f"`{key}` {kind}, level string, start long, end long, score double")
    return exact.union(rest)
