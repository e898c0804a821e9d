"""Token-id files against the library, collocations and hard negatives against brute force, each also on odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadline.llm import collocations, negatives, token_files
from threadline.llm.queries import BYTE_BPE, END_OF_FILE_DOC, QUERIES, tokenizer_path

CLASHING = "doc_id long, text string, lang string, file string, key string, n string, part string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(BYTE_BPE))


# ---- token files ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
def test_blocks_give_back_ids_and_spans(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[: n // 2] //= 7  # some blocks with few large values
    data = np.frombuffer(token_files.file_bytes(pa.array([1, None]), np.array([n // 2, n - n // 2]), ids), np.uint8)
    docs, starts, total = token_files.opened(data)
    assert total == n and docs.column(0).to_pylist() == [1, None]
    assert (token_files.decode_blocks(data, starts[:-1]) == ids).all()
    for first, last in ((0, n), (n // 3, n // 2), (n, n)):
        assert (token_files.span(data, first, last - first) == ids[first:last]).all()
    with pytest.raises(IndexError):
        token_files.span(data, 0, n + 1)


def test_outliers_are_exceptions():
    ids = np.full(token_files.BLOCK, 5, np.uint32)
    ids[[3, 200]] = 50000, 2**32 - 1
    (block,) = token_files.encode_blocks(ids)
    head = np.frombuffer(block[: token_files.HEAD.itemsize], token_files.HEAD)[0]
    assert (head["least"], head["width"], head["exceptions"]) == (5, 0, 2) and len(block) < 40


def test_pieces_have_the_librarys_ids(library):
    enc = token_files.SpacedEncoder(tokenizer_path(BYTE_BPE))
    assert enc.known_rules
    pick = random.Random(5)
    parts = [" ", "  ", "\n", "a", "'s", "B,", "it's", "1", "é", "。", "<|endoftext|>", "\t", "\x85", "​", "中", "!?", "word", "-x"]
    texts = ["", " ", "x\n y", "a b ", *("".join(pick.choice(parts) for _ in range(pick.randint(0, 9))) for _ in range(3000))]
    for _ in range(2):  # the second time from the tables
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_round_trip_of_odd_tables(spark, library):
    long = "one two, three's 4 " * 9000
    rows = [(i, t, None, "f", "k", "n", "p") for i, t in [(3, "b"), (None, "x"), (1, None), (2, ""), (9, long), (3, "b"), (3, "a  b\n"), (-5, "é <|endoftext|>")]]
    docs = spark.createDataFrame(rows, CLASHING)
    got = sorted(token_files.round_trip(docs, tokenizer_path(BYTE_BPE), 2).collect(), key=lambda r: r["start"])
    ids_of = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    at = 0
    assert [r["doc_id"] for r in got] == [None, -5, 1, 2, 3, 3, 3, 9]
    left = Counter((r[0], r[1]) for r in rows)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        left -= Counter([next((i, t) for (i, t), n in left.items() if n and i == r["doc_id"] and ids_of[t] == ids)])
        at += len(ids)
    assert not left
    assert token_files.round_trip(docs.limit(0), tokenizer_path(BYTE_BPE), 2).count() == 0


def test_small_files_keep_the_order(spark, library):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    listing = token_files.write_token_files(docs, tokenizer_path(BYTE_BPE), 2, file_ids=64)
    assert listing.count() >= 20 and listing.agg(F.max("n_ids")).first()[0] <= 64
    got = token_files.read_token_files(listing, "bigint").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(300))


def test_query_of_token_files(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    for r in QUERIES["op11_patched_frames"](spark, sf_dir).orderBy("doc_id").collect():
        ids = [*library.encode(docs.pop(r["doc_id"]) or "", add_special_tokens=False).ids, END_OF_FILE_DOC]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not docs


# ---- collocations --------------------------------------------------------------------------------------------------


def all_counts(rows, longest):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def brute_collocations(rows, least=10, longest=3, top=2000):
    out = []
    for lang, counts in all_counts(rows, longest).items():
        total = sum(n for g, n in counts.items() if len(g) == 1)
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 50 * found[g[i : i + k]]}
        scored = []
        for g, a in found.items():
            if g not in gone:
                score, k = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    pick = random.Random(3)
    words = ["the", "The", "of", "Élan", "élan", "x", "new", "york", "city", "a\x1fb", "中文", *[f"w{i}" for i in range(40)]]
    rows = [(pick.choice(["en", "en", "de", None]), "".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\t", ", ", "\n", ".\x0b"]) for _ in range(pick.randint(0, 60)))) for _ in range(150)]
    return [*rows, *[("en", "in new york city today; in new york")] * 30, ("fr", None), ("de", ""), (None, " \n"), ("en", "of the " * 3000)]


@pytest.mark.parametrize(("share", "longest"), [(0.2, 3), (0.0, 3), (1.0, 4)])
def test_collocations_equal_brute_force_whatever_the_sample(spark, phrases, share, longest):
    docs = spark.createDataFrame([(1, t, lang, "f", "k", "n", "p") for lang, t in phrases], CLASHING)
    got = collocations.collocations(docs, sample_share=share, max_words=longest).collect()
    assert sorted(map(tuple, got)) == brute_collocations(phrases, longest=longest)


def test_collocations_with_a_filter_full_of_false_positives(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_FILTER_BYTES", 64)
    docs = spark.createDataFrame([(t, lang) for lang, t in phrases], "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, top=5).collect())) == brute_collocations(phrases, top=5)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], CLASHING)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("x", "")], "lang string, text string")).count() == 0


# ---- hard negatives ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 10, 300, 40_000, 2**20, 2**24])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(top)
    for dims in (0, 1, 7, 64):
        a, c = rng.integers(-top, top, (13, dims)), rng.integers(-top, top, (29, dims))
        assert (negatives.packed_products(a, c) == a @ c.T).all()
    assert (negatives.packed_products(np.full((1, 2), -top), np.full((3, 2), -top)) == 2 * top * top).all()


def test_scores_that_are_too_large_are_an_error():
    with pytest.raises(OverflowError):
        negatives.packed_products(np.full((1, 4), 2**40), np.full((1, 4), 2**40))


def brute_negatives(rows, is_anchor):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        scores = [sum(a * b for a, b in zip(v, w, strict=False)) for _, _, w in rows]
        order = sorted(range(len(rows)), key=lambda j: (-scores[j], rows[j][0]))
        for j in [j for j in order if j != at and rows[j][1] == label][:5]:
            fits = [x for x in order if rows[x][1] != label and 30 * scores[j] <= 100 * scores[x] <= 90 * scores[j]][:10]
            out += [(i, rows[j][0], n, rows[x][0], scores[j], scores[x]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def test_negatives_equal_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "PASS_ANCHORS", 5)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 40)), [float(x) for x in rng.integers(-3, 4, int(rng.integers(0, 4)))], int(rng.integers(0, 2))) for _ in range(80)]
    rows += [(None, [1.0], 1), (1, None, 1), (2, [1.0], None), (3, [1.0, None], 1), (4, [math.nan], 1), (5, [math.inf], 0), *[(0, [1.0, 2.0, 3.0], 0)] * 3]
    df = spark.createDataFrame([(*r, 7, "n") for r in rows], "vec_id long, embedding array<float>, label int, number int, bounds string").repartition(4)
    assert sorted(map(tuple, negatives.mine(df, F.col("id") % 10 == 0).collect())) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_query_of_negatives(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_kronecker_negatives"](spark, sf_dir).collect())) == brute_negatives(rows, lambda i: i % 100 == 0)


def test_phrases_are_counted_in_groups_of_hashes(spark):
    texts = [("en", b"a b a b. c"), ("en", b"b a b"), ("de", b"a b"), ("en", b""), ("de", b",,")]
    df = spark.createDataFrame(texts, "lang string, text binary").repartition(3)
    want = {}
    for lang, text in texts:
        words = collocations.Words(lang, [text])
        for k in (1, 2, 3):
            for key in words.keys(k)[words.whole(k)].view(np.int64).tolist():
                want[key] = want.get(key, 0) + 1
    for groups in (1, 16, 1 << 12):
        found = collocations.counted(df, None, first=True, longest=3, groups=groups)
        assert {r["key"]: r["n"] for r in found.collect()} == want
        assert {r["key"] for r in collocations.counted(df, None, first=True, longest=3, least=2, groups=groups).collect()} == {k for k, n in want.items() if n > 1}
    assert [collocations.groups_of(n) for n in (0, collocations.GROUP_BYTES * 16, collocations.GROUP_BYTES * 17)] == [16, 16, 32]
