"""The text operators against brute force, on texts with nulls, blanks, copies, long texts, ties and clashing columns."""

import hashlib
import html
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadline.llm import bpe_trie, fingerprint, line_crf, near_dups, ngram_trie, packing, pseudonyms, toxicity, url_cascade, wrappers
from threadline.llm.queries import ORACLES, QUERIES, word_bpe_path

random.seed(7)
VOCAB = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "Theta", "iota", "kappa", "it's", "42", "%%%"]
LONG = " ".join(random.choice(VOCAB) for _ in range(6000))
BODY = " ".join(random.choice(VOCAB) + str(i) for i in range(200))
NEAR = BODY.replace("alpha", "omega", 1)
TEXTS = [None, "", " \n\t ", "one", "one", "Ｏne  ﬁne\nDAY", "one fine day", LONG, BODY, BODY, NEAR, "same line here.\nsame line here.\n" * 30, "é é <|endoftext|> x"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one")]
CLASHING = "doc_id long, text string, node string, key string, ids string, digest string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", "k", "i", "d", "l") for i, t in DOCS], CLASHING)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHING)


def canon(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").casefold()).strip(" ")


def test_fingerprints(docs, none):
    got = fingerprint.fingerprints(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(canon(dict(DOCS)[r["doc_id"]]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({canon(t) for t in TEXTS})
    assert len(got) == len(DOCS) and fingerprint.fingerprints(none).count() == 0
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_edited_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for at, (i, t) in enumerate(order):
        t, other = t or "", order[(at + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == float(canon(t) == canon(edited)) and got[i]["near_next"] == float(canon(t) == canon(other))


def test_pseudonyms(spark, none):
    rows = [(1, "card 4952935900253052, a@b.example, 10.1.2.3"), (2, "4952935900253052 again; bad 4952935900253053 and 300.1.1.1"), (3, None), (4, ""), (5, "no values, 12 and 555"), (6, "born 1985-03-07, 7.3.1985; 123-45-6789; DE89 3704 0044 0532 0130 00; +1 (017) 555-7713")]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), count_col="n").collect()}
    card = re.search(r"card (\d{16})", got[1]["text"])[1]
    assert card != "4952935900253052" and got[2]["text"].startswith(card + " again; bad 4952935900253053 and 300.1.1.1")
    assert sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(card)) % 10 == 0
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1] and [got[i]["n"] for i in (1, 2, 3, 4, 5, 6)] == [3, 1, 0, 0, 0, 5]
    iban = re.search(r"DE\d\d[\d ]+", got[6]["text"])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "1985" not in got[6]["text"] and re.search(r"born \d{4}-\d\d-\d\d, \d{1,2}\.\d{1,2}\.\d{4}; \d{3}-\d\d-\d{4}; .*; \+1 \(\d{3}\) \d{3}-\d{4}$", got[6]["text"])
    assert pseudonyms.pseudonymize(none).count() == 0


def test_pseudonyms_are_a_permutation(spark):
    rows = [(i, f"0.0.{i // 256}.{i % 256} {100 + i // 99 % 500:03d}-{i % 99 + 1:02d}-0001") for i in range(1500)]
    got = [r["text"] for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len({t.split()[0] for t in got}) == 1500 and len({t.split()[1] for t in got}) == len({t.split()[1] for _, t in rows})


def test_bpe_trie_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_path())
    for r in bpe_trie.encode_texts(docs, word_bpe_path()).collect():
        ids = library.encode(dict(DOCS)[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe_trie.encode_texts(none, word_bpe_path()).count() == 0


def test_packing_is_a_partition_of_all_ids(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe_path())
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), word_bpe_path(), n_ranges=3).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in dict(DOCS).items():
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        whole = b"".join(bytes(r["ids"]) for r in parts)
        assert np.frombuffer(whole, "<u4").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(r["start"] == sum(x["length"] for x in parts[:n]) for n, r in enumerate(parts))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in parts)
        assert size & (size - 1) == 0 and size <= packing.SEQUENCE and all(r["offset"] == sum(x["length"] for x in parts[:n]) for n, r in enumerate(parts))
    assert packing.pack(none, word_bpe_path()).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid))]
    assert len(set(packing.hilbert(grid).tolist())) == 512 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_line_crf_base_rules(docs, none, spark):
    field = line_crf.train(docs, spark.createDataFrame([(8, 1), (11, 0)], "doc_id long, quality int"))
    for r in line_crf.judge_documents(docs, field).collect():
        want = base_rules(dict(DOCS)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert line_crf.judge_documents(none, line_crf.all_content()).count() == 0
    assert line_crf.keep_good(docs, line_crf.all_content()).columns == docs.columns


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for _ in range(20):
        field, scores = line_crf.Field(np.zeros(1), rng.normal(size=(2, 2))), rng.normal(size=7)
        value = lambda y: sum(scores[i] for i in range(7) if y[i]) + sum(field.move[y[i], y[i + 1]] for i in range(6))  # noqa: B023, E731
        best = max(value([n >> i & 1 for i in range(7)]) for n in range(128))
        assert math.isclose(value(field.decode(scores).tolist()), best)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term("moron", False, 2.0), toxicity.Term("scum", False, 2.0), toxicity.Term("lowei", True, 3.0), toxicity.Term("disgusting", False, 2.0), toxicity.Term("imbeciledolt", False, 2.0)]
    automaton = toxicity.LexiconAutomaton(terms)
    words = {w for t in terms for _ in range(60) for w in [edit(edit(t.text, random.random() < 0.8), random.random() < 0.5)]} | {"loweischaft", "lowe", "scums", "the"}
    for w in words:
        fits = [t for t in terms if (w.startswith(t.text) if t.stem else distance(w, t.text) <= automaton.allowed(t))]
        assert bool(automaton.find(w)) == bool(fits), (w, fits)


def edit(word, change):
    at = random.randrange(len(word))
    return word if not change else random.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "y" + word[at + 1 :]]) or word


def test_misspelled_words_beside_a_stem():
    count = {"idiot": 90, "idiot ": 60, "idiots ": 20, "idiott ": 10, "loweis": 50, "loweisen ": 30, "scumb": 40}
    learned = toxicity.choose_terms([{"term": t, "pos": n, "neg": 0} for t, n in count.items()], 100, 100)
    assert {t.text for t in learned if t.stem} == {"idiot", "loweis", "scumb"}
    terms = toxicity.with_start_terms(learned)
    automaton = toxicity.LexiconAutomaton(terms)
    for word in [t.strip() for t in count if t.endswith(" ")] + [w for w in toxicity.INSULTS if len(w) >= 5]:
        for at in range(len(word)):
            for wrong in (word[:at] + "j" + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + "j" + word[at:]):
                assert automaton.find(wrong), wrong


def test_toxicity_quotation_and_empty(docs, none, spark):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = spark.createDataFrame([(1, "you are an idiot and a moron " + BODY), (2, 'he said the word "idiot" was used ' + BODY), (3, None), (4, BODY)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(rows, model).collect()}
    assert score[1] > score[2] and score[1] > 0.5 > score[4] and score[3] == score[4]
    assert toxicity.score_documents(none, model).count() == 0 and toxicity.keep_civil(rows, model).count() == 3


def test_held_out_toxicity(spark, sf_dir):
    got = QUERIES["op5_toxicity_automata"](spark, sf_dir.replace("0.001", "0.1")).join(spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/labels.parquet"), "doc_id").filter("held_out").groupBy().agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert got > 0.95


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(docs).collect()}
    want = {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 11, 12: 12}
    assert got == want
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert near_dups.near_duplicate_classes(none).count() == 0


def test_near_duplicates_of_taken_and_left_members(spark):
    # Only the first text of a group is linked to its last, and nearly all their buckets hold a hub of more members.
    texts = []
    for group in range(24):
        first = [f"g{group}w{i}" for i in range(300)]
        texts.append(" ".join(first))
        for hub, at in enumerate((40, 240)):
            words = [*first[:at], f"g{group}q{hub}", *first[at + 1 :]]
            texts += [" ".join(words), *(" ".join([*words[:-1], f"g{group}q{hub}s{i}"]) for i in range(10))]
        texts.append(" ".join(first[:100] + first[151:]))
    sets = [near_dups.shingles([t.encode()])[1:] for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i - i % 24, i):
            if near_dups.similarity(sets[i], sets[j]) >= near_dups.SIMILARITY:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(df).collect()} == {i: root(i) for i in range(len(texts))}


def test_keep_one_of_null_and_repeated_ids(spark):
    rows = [(None, "first text of no id", 1), (None, "second text of no id", 2), (7, "a text", 3), (7, "another text", 4), (8, "another text", 5), (7, "a text", 3)]
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert sorted(r["n"] for r in kept.collect()) == [1, 2, 3, 4]


def test_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = ({int(k): int(v) for k, v in zip(rng.choice(20, 12, replace=False), rng.integers(1, 5, 12))} for _ in range(2))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        side = lambda d: (np.array(sorted(d)), np.array([d[k] for k in sorted(d)]))
        assert math.isclose(near_dups.similarity(side(a), side(b)), want)


def test_signatures_estimate_similarity():
    texts = [BODY.encode(), NEAR.encode(), LONG.encode()]
    s = near_dups.signatures(*near_dups.shingles(texts), 3)
    exact = near_dups.similarity(near_dups.shingles(texts[:1])[1:], near_dups.shingles(texts[1:2])[1:])
    assert abs((s[0] == s[1]).mean() - exact) < 0.12 and (s[0] == s[2]).mean() < 0.1


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (500, 700), (3000, 10_000_000), (64, 1 << 40)):
        values = np.sort(rng.choice(min(universe, 1 << 22), n, replace=False)) * max(1, universe >> 22)
        ef = ngram_trie.EliasFano(ngram_trie.ef_encode(values, universe))
        assert (ef.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, values[:-1] + 1 if n else values])
        found = ef.find(asked)
        assert all((f >= 0) == (a in set(values.tolist())) and (f < 0 or values[f] == a) for a, f in zip(asked.tolist(), found.tolist()))


def test_language_model_equals_counts(docs, none):
    train = [(i, t) for i, t in DOCS if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    one, two, after = Counter(), Counter(), Counter()
    for _, t in train:
        w = tokens(t)
        one.update(w)
        two.update(zip([b"", *w[:-1]], w))
    for a, _ in two:
        after[a] += 1
    n, v = sum(one.values()), len(one)
    singles, doubles = (sum(c == k for c in two.values()) for k in (1, 2))
    d = min(0.98, max(0.1, singles / (singles + 2 * doubles)))
    for r in ngram_trie.train_and_score(docs, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")).collect():
        w, low, high = tokens(dict(DOCS)[r["doc_id"]]), 0.0, 0.0
        for a, b in zip([b"", *w[:-1]], w):
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            low += math.log10(p)
            high += math.log10(max(two[a, b] - d, 0) / one[a] + min(1, d * after[a] / one[a]) * p if one[a] else p)
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(one[x] > 0 for x in w) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], low, rel_tol=1e-9) and math.isclose(r["score"], high, abs_tol=r["n_tokens"] / ngram_trie.STEPS)
    assert ngram_trie.train_and_score(none, F.lit(True)).count() == 0


def test_wrappers(spark):
    page = lambda body, extra="": f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li>m<li>n</ul></nav>{extra}<article><h1>T &amp; t</h1>{body}<div class='ad box'>buy</div><section id=comments><p>c</p></section></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/x", page("<p>one <b>tw</b>o\n three</p>")), (2, "http://a.example/y", page("<p>x</p><p>y<br>z</p>", "<aside>s</aside>")), (3, None, None), (4, "http://b.example/", "<p>no article &lt;here&gt;"), (5, "http://a.example/z", page("")), (6, "http://a.example/z", "")]
    df = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(df).collect()}
    assert got == {1: "T & t one two three", 2: "T & t x y z", 3: "", 4: "no article <here>", 5: "T & t", 6: ""}
    assert wrappers.extract_main_text(df.limit(0)).count() == 0


def test_wrappers_on_pages(spark, sf_dir):
    def plain(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(x for b in re.split(r"<[^>]*(?:p|h1|br)>", body) if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split())))

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"]: r["text"] for r in QUERIES["op7_page_wrappers"](spark, sf_dir).collect()} == {k: plain(v) for k, v in pages.items()}


def test_cascade_is_exact(spark):
    keys = [(f"host{i}.example.net", i % 7 == 0) for i in range(3000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = url_cascade.build_cascade(universe)
    assert len(cascade.levels) > 1 and universe.filter(cascade.member(F.col("key")) != F.col("listed")).count() == 0
    cascade = url_cascade.build_cascade(universe, part_bits=512)
    assert cascade.levels[0].parts > 4 and universe.filter(cascade.member(F.col("key")) != F.col("listed")).count() == 0


def test_url_rules(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/1?q=/x"), (2, "http://a.example.com/en/"), (3, "x.com/en/"), (4, None), (5, "http://a.net/es/x"), (6, "http://spam-farm.example.org/p"), (7, "http://b.com"), (8, "http://good.org#f/en/"), (9, "http://downloads.example.org/"), (10, "http://x.casino-win.example.org/"), (10, "http://x.casino-win.example.org/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, key string")).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "block") and got[7] == ("b.com", "", None, "allow") and got[8] == ("good.org", "", None, "allow") and got[9][3] == "allow" and got[10][3] == "block"


def test_oracle_of_the_cascade(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    df = QUERIES["op10_bloom_cascade"](spark, sf_dir)
    want = con.execute(ORACLES["op10_bloom_cascade"]).df()[df.columns]
    assert sorted(map(str, df.toPandas().itertuples(index=False))) == sorted(map(str, want.itertuples(index=False)))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() > 0


def test_pseudonyms_link_spellings(spark):
    spellings = ["4952935900253052 | 4952 9359 0025 3052 | 4952-9359-0025-3052", "DE89370400440532013000 | DE89 3704 0044 0532 0130 00", "1985-03-07 | 7.3.1985 | 07.03.1985"]
    rows = [(i, t, "mine") for i, t in enumerate([*spellings, "éü@b.example 王小明@b.example a@b.example иван@b.example", "x" * 60 + "@b.example " + LONG])]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, __found string")).collect()}
    for i in (0, 1):
        assert len({re.sub("[ -]", "", x) for x in got[i]["text"].split(" | ")}) == 1 and got[i]["text"] != rows[i][1]
    iso, short, padded = got[2]["text"].split(" | ")
    day, month, year = padded.split(".")
    assert iso == f"{year}-{month}-{day}" and short == f"{int(day)}.{int(month)}.{year}" and iso != "1985-03-07"
    assert not {"éü", "王小明", "a", "иван"} & {x.split("@")[0] for x in got[3]["text"].split()}
    first, rest = got[4]["text"].split(" ", 1)
    assert rest == LONG and first[:24] != first[24:48] and all(r["__found"] == "mine" for r in got.values())


def test_pseudonyms_of_wide_letters_are_a_permutation(spark):
    df = spark.range(2000).select(F.concat(F.format_string("%03d", F.col("id") % 1000), F.when(F.col("id") < 1000, "é").otherwise("ж"), F.lit("@b.example")).alias("text"))
    assert pseudonyms.pseudonymize(df).distinct().count() == 2000


def test_collided_digests(spark):
    rows = [(3, "abcd"), (2, "ab"), (1, "xy"), (0, "ax"), (4, "ab")]
    short = lambda canon: F.lpad(F.length(canon).cast("string"), 4, "0")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(df, digest_of=short).collect()}
    by_text = {}
    order = sorted(rows, reverse=True)
    for at, (i, t) in enumerate(order):
        half = len(t) // 2
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
        by_text.setdefault(t[: len(t) - half] + order[(at + 1) % len(order)][1][:half], set()).add(got[i]["edited_fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
    assert {r["fingerprint"]: r["n_same"] for r in fingerprint.fingerprints(df, digest_of=short).collect()}.__len__() == 4


def test_edited_texts_of_other_ids(spark):
    rows = [("b", "one two"), ("a", "three four"), (None, "five"), ("c", None)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = {"c": "", "b": "one " + "thr", "a": "three" + "five", None: "fi"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_tokenizer_with_other_rules(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, df = Tokenizer.from_file(path), spark.createDataFrame([(1, "It's  one\n\nDAY 42%"), (2, None)], "doc_id long, text string")
    for r in bpe_trie.encode_texts(df, path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode({1: "It's  one\n\nDAY 42%"}.get(r["doc_id"], ""), add_special_tokens=False).ids


def test_near_duplicates_of_short_texts(spark):
    rows = [(1, "hello world"), (2, "Hello world"), (3, "a b c d"), (4, "a b c e"), (5, BODY), (6, "solo"), (7, "solo"), (8, "a b c d e")]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    alone = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    assert [r["class_id"] for r in near_dups.near_duplicate_classes(alone).collect()] == [1]


def test_near_duplicates_equal_all_pairs(spark):
    # A group whose members are mostly just under the threshold, chains of links, and texts of their own.
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(260):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4, 6))):
            words[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(150)]
    for i in range(30):
        texts.append(" ".join(chain))
        for at in range(i * 4, i * 4 + 3):
            chain[at] = f"d{i}{at}"
    texts += [" ".join(rng.choice(VOCAB) + str(rng.randrange(300)) for _ in range(60)) for _ in range(60)]
    sets = [near_dups.shingles([t.encode()])[1:] for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if near_dups.similarity(sets[i], sets[j]) >= near_dups.SIMILARITY:
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert links > 200 and got == {i: root(i) for i in range(len(texts))}


def test_wrapper_tells_template_from_text(spark):
    menu = "<ul><li>Home page</li><li>Contact us</li></ul>"
    page = lambda i, more="": f"<html><body class='no-sidebar'>{menu}<div class='has-menu'><h2>News {i}</h2><p>first of {i}</p><p>second of {i}</p>{more}</div><div><i>All rights are ours</i></div></body></html>"
    rows = [(i, "http://a.example/", page(i)) for i in range(6)]
    rows += [(6, "http://a.example/", page(6, "<h3>Home page</h3><p>tail</p>")), (7, "http://a.example/", page(7, "<table><tr><td>cell</td></tr></table>"))]
    # Copies count once: a host whose pages are all alike shows no template.
    rows += [(10 + i, "http://b.example/", page(1)) for i in range(8)] + [(20 + i, "http://c.example/", page(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda i: f"Home page Contact us News {i} first of {i} second of {i} All rights are ours"
    assert all(got[i] == f"News {i} first of {i} second of {i}" for i in range(6))
    assert got[6] == "News 6 first of 6 second of 6 Home page tail" and got[7] == "News 7 first of 7 second of 7 cell"
    assert all(got[10 + i] == whole(1) for i in range(8)) and all(got[20 + i] == whole(i) for i in range(3))


def test_slots_of_different_places_do_not_match(spark):
    # On one page the text after the title is an advert, on the other a heading: neither takes the other's role.
    ad, own = "<article><h1>T{0}</h1><div class=ad>buy {0}</div><p>a {0}</p></article>", "<article><h1>T{0}</h1><h2>sub {0}</h2><p>a {0}</p></article>"
    rows = [(i, "http://a.example/", (ad if i % 2 else own).format(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i} a {i}" if i % 2 else f"T{i} sub {i} a {i}" for i in range(12)}


def test_wrappers_of_many_streams(spark):
    # More streams than one task aligns: levels of parts give one wrapper that still knows the template.
    rng = random.Random(3)
    page = lambda i: "<body><section><b>Our shop</b></section><main>" + "".join(rng.choice(("<h2>h{0}</h2>", "<p>p{0}</p><ul><li>x</li></ul>", "<h3>s{0}</h3><pre>c</pre>")).format(f"{i}.{j}") for j in range(rng.randrange(2, 9))) + "</main></body>"
    rows = [(i, "http://a.example/", page(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert wrappers.page_streams(df, "url", "html").select("stream").distinct().count() > wrappers.FAN_IN
    assert wrappers.infer_wrappers(df).count() == 1
    got = {r["page_id"]: r["text"] for r in wrappers.extract_main_text(df).collect()}
    assert all(t.split() and "shop" not in t for t in got.values())


def test_language_model_of_hot_contexts(spark):
    # One word holds a third of all tokens, so its successors lie in all shards.
    rng = random.Random(2)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"n{rng.randrange(60)}", f"v{rng.randrange(9)}")) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(60, "the n1 the zzz the"), (61, "unknown words")], "doc_id long, text string")
    model = ngram_trie.train(df.filter("doc_id < 60"))
    assert len(model.hot) >= 1
    one, two, after = Counter(), Counter(), Counter()
    for t in texts:
        w = [*t.split(), ""]
        one.update(w)
        two.update(zip(["", *w[:-1]], w))
    for a, _ in two:
        after[a] += 1
    n, v, d = sum(one.values()), len(one), model.discount
    for r in ngram_trie.score_documents(df, model).collect():
        w, want = [*([*texts, "the n1 the zzz the", "unknown words"][r["doc_id"]]).split(), ""], 0.0
        for a, b in zip(["", *w[:-1]], w):
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            want += math.log10(max(two[a, b] - d, 0) / one[a] + min(1, d * after[a] / one[a]) * p if one[a] else p)
        assert math.isclose(r["score"], want, abs_tol=len(w) / ngram_trie.STEPS), r["doc_id"]


def test_language_model_of_three_levels(spark):
    # "the" is dealt over all shards, and so are the bigrams that the third level stands behind.
    rng = random.Random(4)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"n{rng.randrange(60)}", f"v{rng.randrange(9)}")) for _ in range(60)]
    odd = ["the n1 the zzz the", "unknown words", "", "n1 v2 the n3 v2 v2", "THE N1 v1"]
    df = spark.createDataFrame([*enumerate(texts + odd), (99, None)], "doc_id long, text string")
    model = ngram_trie.train(df.filter("doc_id < 60"), order=3)
    one, two, three, after, behind = Counter(), Counter(), Counter(), Counter(), Counter()
    for t in texts:
        w = [*t.split(), ""]
        one.update(w)
        two.update(zip(["", *w[:-1]], w))
        three.update(zip(["", *w[:-2]], w[:-1], w[1:]))
    after.update(a for a, _ in two)
    behind.update((a, b) for a, b, _ in three)
    total = Counter()
    for (a, b, _), c in three.items():
        total[a, b] += c
    n, v, d2 = sum(one.values()), len(one), model.discount
    singles, doubles = (sum(c == k for c in three.values()) for k in (1, 2))
    d3 = min(0.98, max(0.1, singles / (singles + 2 * doubles)))
    assert math.isclose(model.discount3, d3) and model.hot
    for r in ngram_trie.score_documents(df, model).collect():
        w, want = [*([*texts, *odd][r["doc_id"]] if r["doc_id"] < 99 else "").lower().split(), ""], 0.0
        for i, b in enumerate(w):
            a = w[i - 1] if i else ""
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            p = max(two[a, b] - d2, 0) / one[a] + min(1, d2 * after[a] / one[a]) * p if one[a] else p
            c = (w[i - 2] if i > 1 else "", a)
            if i and total[c]:
                p = max(three[*c, b] - d3, 0) / total[c] + min(1, d3 * behind[c] / total[c]) * p
            want += math.log10(p)
        assert math.isclose(r["score"], want, abs_tol=1.5 * len(w) / ngram_trie.STEPS), r["doc_id"]
    scorer = ngram_trie.Scorer(model)
    words = {x: int(ngram_trie.vocabulary(model).look_up(np.array([ngram_trie.xxhash.xxh64_intdigest(x)], np.uint64))[0][0]) for x in one}
    _, to, places = scorer.pairs(np.array([words["the"]]), np.array([words["n1"]]), np.array([one["the"]]), np.zeros(1))
    assert scorer.third(int(to[0])).successors(int(places[0])).tolist() == sorted(words[c] for a, b, c in three if (a, b) == ("the", "n1"))
    codes = ngram_trie.vocabulary(model).single_codes(np.array([words["n1"], model.words]))
    assert codes.tolist() == ngram_trie.code_of(model.single(np.array([one["n1"], 0]))).tolist()
    with pytest.raises(ValueError):
        ngram_trie.train(df, order=4)


def test_language_model_needs_its_files_and_wide_counts(spark):
    import os

    model = ngram_trie.train(spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string"))
    scorer = ngram_trie.Scorer(model)
    assert scorer.score([b"a b"])[0].tolist() == [3]
    os.unlink(f"{model.folder.removeprefix('file://')}/pairs-3")
    with pytest.raises(FileNotFoundError):
        ngram_trie.Scorer(model).level(3)
    keys, counts = ngram_trie.summed(np.array([5, 5, 7], np.uint64), np.array([1 << 33, 1 << 33, 1], np.int64))
    assert counts.tolist() == [1 << 34, 1] and math.isclose(model.single(np.array([1 << 40]))[0], ((1 << 40) + 0.5) / (6 + 0.5 * 5))
    vocab = ngram_trie.Vocabulary(model)
    shard = next(i for i in range(model.shards) if len(vocab.shard(i)["hashes"]))
    vocab.files[shard] = {**vocab.shard(shard), "counts": vocab.shard(shard)["counts"] + (1 << 40)}
    assert vocab.look_up(vocab.shard(shard)["hashes"])[1].min() > 1 << 40


def test_stages_of_odd_tables(spark, sf_dir):
    import corpus_pipeline

    shape = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, __node string, ids string, label string"
    odd = [None, "", " \n", "short", "short", LONG, BODY, NEAR, BODY, "mail é@b.example and 4952935900253052 " + BODY.replace("beta", "omega")]
    rows = [(None if i == 3 else 3 if i == 8 else i, t, "en", None, len(t or ""), "n", "k", "x", "i", "l") for i, t in enumerate(odd)]
    full, none = spark.createDataFrame(rows + rows[-1:], shape), spark.createDataFrame([], shape)
    for name, stage in corpus_pipeline.STAGES:
        out, nothing = stage(spark, full, sf_dir), stage(spark, none, sf_dir)
        assert nothing.count() == 0, name
        if name != "packing":
            assert out.columns == full.columns and nothing.columns == full.columns, name
        got = out.collect()
        if name == "near_dedup":
            # null, empty and blank texts, "short", LONG, BODY with NEAR, and the last text with its repeated row
            assert sorted(str(r["text"] or "").strip()[:9] for r in got) == sorted(["", "", "short", LONG[:9], BODY[:9], "mail é@b."])
        elif name == "pii":
            assert len(got) == len(rows) + 1 and sum(r["text"] is None for r in got) == 1 and not any("4952935900253052" in (r["text"] or "") or "é@" in (r["text"] or "") for r in got)
            assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
        elif name == "packing":
            assert len({r["doc_id"] for r in got}) == len({r[0] for r in rows}) and sum(r["length"] for r in got if r["start"] == 0 and r["doc_tokens"] == 1) == 3


def test_pipeline_stages_equal_their_operators(spark, sf_dir):
    """Each stage keeps what its operator says of the whole of what it is given; classes by all pairs, scores and labels row by row."""
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = line_crf.train(docs, labels)
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    rows = docs.collect()
    assert kept == {r["doc_id"] for r in rows if line_crf.judge(r["text"], field)[6]}
    model = toxicity.train(docs, labels, learnable=F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    find = toxicity.Finder(list(model.terms))
    civil = {r["doc_id"] for r in corpus_pipeline.civility(spark, docs, sf_dir).collect()}
    assert civil == {r["doc_id"] for r in rows if model.score(np.array([find.features(r["text"] or "")]))[0] < 0.5}
    sets = {r["doc_id"]: near_dups.shingles([near_dups.as_words(r["text"] or "")])[1:] for r in rows}
    holders = {}
    for i, (hashes, _) in sets.items():
        for h in hashes.tolist():
            holders.setdefault(h, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    met = Counter((a, b) for ids in holders.values() if len(ids) < 100 for a in ids for b in ids if a < b)
    for (a, b), n in met.items():
        if n >= 3 and near_dups.similarity(sets[a], sets[b]) >= near_dups.SIMILARITY:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], []).append(r["doc_id"])
    for ids in by_text.values():
        for i in ids[1:]:
            x, y = sorted((root(ids[0]), root(i)))
            if x != y:
                parent[y] = x
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {i for i in sets if root(i) == i}
