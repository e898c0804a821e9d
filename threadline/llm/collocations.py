"""Collocations of each language by Toivonen's sampling method.

Phrases are contiguous words of a piece of text. A sample of the documents, mined at a lowered threshold, proposes frequent
phrases; its negative border are the phrases that it doesn't propose while all their parts are proposed. One pass over all
documents counts proposals and border alike: every phrase of k words whose two parts of k - 1 words are proposed (for one
word: all). A border phrase that proves frequent is a failure, as longer phrases with it were not counted: an expansion
pass then counts those phrases whose parts are known to be frequent and that no pass before has counted. Passes end when
no frequent phrase is outside the sets that the passes went by; the exact result never depends on the sample.

Passes count by 64-bit hashes of language and words; a block's counts travel as arrays, one row for each group of hashes, and the
number of groups grows with the texts. What they go by (the proposed or frequent phrases) is sent to the tasks as a
Bloom filter of at most MAX_FILTER_BYTES: false positives make some needless phrases be counted, and as the filters alone
decide what a pass counts, every phrase is counted whole in one pass. Colliding hashes only add up, so every frequent
phrase is among the frequent hashes; a last pass counts these phrases by their text, which gives the exact counts.

Defined results: a null language is ``und``; a null or blank text has no words; repeated rows count each; an empty table
gives an empty result; other columns are ignored. A count above 10**16 is an error of decimal overflow, not a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import grown, map_texts, materialize, shrunk

MIN_COUNT = 10
MAX_WORDS = 3
SAMPLE_SHARE = 0.2
SEED = 11
#: Documents' bytes that are counted together before their counts go to Spark.
BLOCK_BYTES = 12 << 20
#: Bytes of text for each group of hashes whose counts are summed together; groups are a power of two.
GROUP_BYTES = 4 << 20
MIN_GROUPS = 16
#: Largest filter; beyond it false positives grow, results stay the same.
MAX_FILTER_BYTES = 32 << 20
BITS_A_KEY = 16
UNKNOWN = "und"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
#: The low bits of a hash tell the number of words.
_LENGTH = np.uint64(7)


# ---- words and phrases of a block ----------------------------------------------------------------------------------


class Words:
    """The words of texts of one language: codes in a dictionary, pieces, and hashes of phrases by their first word."""

    def __init__(self, lang: str, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.codes, self.known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.word_hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.known.to_pylist()), np.uint64, len(self.known))
        self.hashes = [self.word_hash[self.codes]]

    def keys(self, k: int) -> np.ndarray:
        """Hashes of phrases of ``k`` words that begin at each word (those that cross a piece are meaningless, see ``whole``)."""
        while len(self.hashes) < k:
            last = self.hashes[-1]
            self.hashes.append(chained(last[:-1], self.hashes[0][len(self.hashes) :]))
        return self.hashes[k - 1] & ~_LENGTH | np.uint64(k)

    def whole(self, k: int) -> np.ndarray:
        return self.piece[: max(0, len(self.piece) - k + 1)] == self.piece[k - 1 :]


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class Filter:
    """A Bloom filter of hashes in 64-bit words: three bits of one word for each hash."""

    def __init__(self, n_keys: int):
        bits = min(max(BITS_A_KEY * n_keys, 1 << 12), 8 * MAX_FILTER_BYTES)
        self.shift = np.uint64(64 - ((bits - 1).bit_length() - 6))

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = (keys ^ keys >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        masks = np.zeros(len(keys), np.uint64)
        for by in (0, 6, 12):
            masks |= np.uint64(1) << (spread >> np.uint64(by) & np.uint64(63))
        return (spread >> self.shift).astype(np.int64), masks

    def has(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at, masks = self.slots(keys)
        return table[at] & masks == masks


#: A filter and its table of 64-bit words.
Sent = tuple[Filter, "Broadcast[np.ndarray]"]


def sent_filter(keys: DataFrame) -> Sent:
    """The filter of a column ``key``, put together by Spark and sent to the tasks."""
    spark = keys.sparkSession
    filt = Filter(keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, masks = filt.slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(masks.view(np.int64))], names=["slot", "bits"])

    slots = keys.select("key").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (64 - int(filt.shift)), np.uint64)
    table[slots.column(0).to_numpy()] = slots.column(1).to_numpy().view(np.uint64)
    return filt, spark.sparkContext.broadcast(table)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about BLOCK_BYTES at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


# ---- passes --------------------------------------------------------------------------------------------------------


def groups_of(total_bytes: int) -> int:
    return max(MIN_GROUPS, 1 << max(0, -(-total_bytes // GROUP_BYTES) - 1).bit_length())


def counted(texts: DataFrame, passes: list[Sent] | None, *, first: bool, longest: int, least: int = 1, groups: int = MIN_GROUPS) -> DataFrame:
    """Counts (key, n) of hashed phrases of up to ``longest`` words that occur ``least`` times or more. ``passes``: what this pass goes by, the last, and what those before went by; None: all phrases."""
    shift = np.uint64(64 - (groups.bit_length() - 1)) if groups > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, block in by_language(batches):
            words = Words(lang, block)
            found = []
            if first:
                found.append((words.word_hash & ~_LENGTH | np.uint64(1), np.bincount(words.codes, minlength=len(words.known))))
            for k in range(2, longest + 1):
                taken = words.whole(k)
                if passes is not None:
                    parts = words.keys(k - 1)
                    for i, (filt, table) in enumerate(reversed(passes)):
                        has = filt.has(table.value, parts)
                        both = has[:-1] & has[1:]
                        taken = taken & (both if i == 0 else ~both)
                found.append(np.unique(words.keys(k)[taken], return_counts=True))
            yield out(*map(np.concatenate, zip(*found, strict=True)))

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype("<u4")
        group = (keys >> shift if shift is not None else np.zeros_like(keys)).astype(np.int32)
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(keys))[: len(at)]
        # Keys in order as the steps between them.
        steps = keys.copy()
        steps[1:] -= keys[:-1]
        steps[at] = keys[at]
        parts = [pa.array([shrunk(x[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()) for x in (steps, n)]
        return pa.RecordBatch.from_arrays([pa.array(group[at]), *parts], names=["group", "keys", "counts"])

    def add(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(grown(x), dtype=np.uint64) for x in group.column("keys").to_pylist()])
        n = np.concatenate([grown(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[at], np.add.reduceat(n, at)
        enough = n >= least
        return pa.table({"key": pa.array(keys[enough].view(np.int64)), "n": pa.array(n[enough])})

    return map_texts(texts, run, "group int, keys binary, counts binary").groupBy("group").applyInArrow(add, "key long, n long")


def spelled(texts: DataFrame, frequent: Sent, longest: int) -> DataFrame:
    """Exact counts (lang, phrase, words, n) of the phrases whose hashes are frequent; with words = 0 all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, table = frequent
        for lang, block in by_language(batches):
            words = Words(lang, block)
            yield out(lang, pa.array([b""], pa.large_binary()), 0, np.array([len(words.codes)]))
            for k in range(1, longest + 1):
                at = np.flatnonzero(words.whole(k) & filt.has(table.value, words.keys(k)))
                numbers = words.codes[at]
                for j in range(1, k):
                    # Numbers of distinct phrases so far, times the dictionary, plus the next word: exact, not by hash.
                    numbers = np.unique(numbers, return_inverse=True)[1] * len(words.known) + words.codes[at + j]
                _, where, n = np.unique(numbers, return_index=True, return_counts=True)
                parts = [words.known.take(pa.array(words.codes[at[where] + j])) for j in range(k)]
                yield out(lang, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0], k, n)

    def out(lang: str, phrases: pa.Array, k: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.large_string()).cast(pa.string()), pa.array([k] * len(n), pa.int32()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "words", "n"])

    return map_texts(texts, run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_share: float = SAMPLE_SHARE) -> DataFrame:
    """(lang, phrase, words, n): exact counts of all phrases of up to ``max_words`` words that occur ``min_count`` times or more; with words = 0 the words of a language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    lowered = max(1, int(min_count * sample_share))
    groups = groups_of(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    proposed = materialize(counted(texts.where(F.rand(SEED) < sample_share), None, first=True, longest=max_words - 1, least=lowered, groups=groups).select("key"), "proposed")
    passes = [sent_filter(proposed)]
    found = materialize(counted(texts, passes, first=True, longest=max_words, least=min_count, groups=groups).select("key"), "frequent")
    fresh = found
    while True:
        # A longer phrase is missing only if a frequent part of it is outside what the passes went by.
        failed = fresh.where(F.col("key").bitwiseAND(F.lit(int(_LENGTH))) < max_words).select("key").mapInArrow(missed_by(passes), "key long")
        if failed.isEmpty():
            break
        passes.append(sent_filter(found))
        fresh = materialize(counted(texts, passes, first=False, longest=max_words, least=min_count, groups=groups).select("key"), "frequent")
        found = found.union(fresh)
    return spelled(texts, sent_filter(found), max_words).where((F.col("n") >= min_count) | (F.col("words") == 0))


def missed_by(passes: list[Sent]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, table = passes[-1]
        for b in batches:
            has = filt.has(table.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield b.filter(pa.array(~has))

    return run


# ---- scores --------------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_share: float = SAMPLE_SHARE, shield_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of two words or more.

    A phrase's score is the least over its cuts of floor(10**6 * a * a / (l * r)), ties to the earliest cut. A phrase goes
    if a longer one that holds it has at least ``shield_percent`` of its count. ``top``: as many a language; None: all.
    """
    counts = materialize(frequent_phrases(docs, lang_col=lang_col, text_col=text_col, min_count=min_count, max_words=max_words, sample_share=sample_share), "phrases")
    totals = counts.where("words = 0").select("lang", F.col("n"))
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    # Fewer phrases of longest length than of any other, so what is inside them is summed up before the join.
    inner = candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.select("lang", "a", F.explode(F.expr(f"""flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))""")).alias("phrase"))
    shields = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(shields, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20)") * 100 < F.col("a").cast("decimal(20)") * shield_percent)).drop("longer")
    cuts = kept.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
    parts = counts.where(f"words between 1 and {max_words - 1}")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = F.expr("cast((cast(1000000 as decimal(7)) * cast(a as decimal(16)) * cast(a as decimal(16))) div (cast(l as decimal(19)) * cast(r as decimal(19))) as long)")
    least = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    scored = least.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score").join(F.broadcast(totals), "lang")  # a row a language
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
