"""URL filter: rules first, then exact host membership by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys. Level 1 encodes those unlisted keys of the corpus that level 0
reports falsely, level 2 the listed keys that level 1 reports falsely, and so on until a level has no false
positive. As the levels are built against every key that the corpus holds, membership of any of those keys is
exact, and a probe needs only a few bit tests in the row: no join. A level holds ten bits for each key: the listed keys
that the corpus has, then one in a hundred of all keys, then of the listed ones, and so on. Large levels are split in
parts by a hash of the key, so no array of bits grows beyond PART_BITS.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed;
repeated rows are judged each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path): the rules of the production query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts with a label that has one of these words between hyphens are listed in the production query.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
BITS_PER_KEY = 10
HASHES = 5
#: A level's bits travel inside the plan, in parts of this many at most (1 MB).
PART_BITS = 1 << 23
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    tail = F.substring(url, F.length(rest) + F.lit(4), F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    tail = F.substring(url, F.length(rest) + F.lit(4), F.length(url))
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c. None for an empty host."""
    labels = F.split(host, r"\.")
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(whole), lambda x: x != ""))


@dataclass(frozen=True)
class Level:
    bits: int  # of each part
    parts: int
    words: str  # JSON array of the parts' arrays of 64-bit words: a constant that the optimizer folds once


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """True where the deepest level that a key passes in turn is one of listed keys."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(passes(key, depth, self.levels[depth]), verdict).otherwise(F.lit(depth % 2 == 1))
        return verdict


def positions(key: Column, depth: int, bits: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(depth * HASHES + i), key), F.lit(bits)) for i in range(HASHES)]))


def part_of(key: Column, depth: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"part {depth}"), key), F.lit(parts)).cast("int")


def passes(key: Column, depth: int, level: Level) -> Column:
    words = F.get(F.from_json(F.lit(level.words), "array<array<bigint>>"), part_of(key, depth, level.parts))
    return F.forall(positions(key, depth, level.bits), lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)


def build_level(keys: DataFrame, depth: int, n_keys: int, part_bits: int = PART_BITS) -> Level:
    """Set bits by an aggregation of 64-bit words; one row for each word that has a bit reaches the driver."""
    bits = 1 << max(6, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY)))
    parts = max(1, bits // part_bits)
    bits = min(bits, part_bits)
    at = keys.select(part_of(F.col("key"), depth, parts).alias("part"), F.explode(positions(F.col("key"), depth, bits)).alias("at"))
    rows = at.groupBy("part", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("value")).collect()
    words = [[0] * (bits // 64) for _ in range(parts)]
    for r in rows:
        words[r["part"]][r["word"]] = r["value"]
    return Level(bits, parts, str(words).replace(" ", ""))


def build_cascade(universe: DataFrame, part_bits: int = PART_BITS) -> Cascade:
    """``universe``: distinct ``key`` with a boolean ``listed``."""
    left = {True: universe.filter("listed"), False: universe.filter("not listed")}
    levels: list[Level] = []
    for depth in range(MAX_LEVELS):
        mine = depth % 2 == 0
        n = left[mine].count()
        if n == 0:
            return Cascade(tuple(levels))
        levels.append(build_level(left[mine], depth, n, part_bits))
        left[not mine] = left[not mine].filter(passes(F.col("key"), depth, levels[-1]))
    raise RuntimeError(f"{MAX_LEVELS} levels still have false positives")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], pick: int | None) -> Column:
    """The longest rule that fits (ties: the longer host, then the earlier rule), as its text, or with pick=0 its verdict."""
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1] + x[1][2]), -len(x[1][1]), x[0]))
    out = F.lit(None).cast("string")
    for _, (verdict, h, p) in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(verdict if pick == 0 else h + p)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, listed_words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """Judge each row's url: (id, host, path, rule, verdict, listed).

    ``listed``: one string column of hosts to block with all their subdomains; without it, hosts of the corpus
    with a label that has one of ``listed_words`` between hyphens.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    keys = rows.select("host").distinct().select(F.explode(host_suffixes(F.col("host"))).alias("key")).distinct()
    if listed is None:
        universe = keys.withColumn("listed", F.col("key").rlike("(?:^|[.-])(?:" + "|".join(listed_words) + ")(?:[.-]|$)"))
    else:
        named = listed.select(F.translate(F.col(listed.columns[0]), UPPER, UPPER.lower()).alias("key")).filter("key is not null").distinct().withColumn("hit", F.lit(True))
        universe = keys.join(named, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed"))
    universe = materialize(universe, "url-keys")
    cascade = build_cascade(universe)
    rows = rows.withColumn("is_listed", F.exists(host_suffixes(F.col("host")), cascade.member))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, 0), F.when(F.col("is_listed"), "block").otherwise("allow"))
    return rows.select(F.col(id_col), "host", "path", rule_of(host, path, rules, None).alias("rule"), verdict.alias("verdict"), "is_listed")
