"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, collocations, fingerprint, line_crf, near_dups, negatives, ngram_trie, packing, pseudonyms, token_files, toxicity, url_cascade, wrappers
from .common import one_of_five, table

#: The vocabulary of the production queries, from the installed package of public tokenizers.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: The id that ends a document in the files of token ids.
END_OF_FILE_DOC = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe_path() -> str:
    return tokenizer_path(WORD_BPE)


Query = Callable[[SparkSession, str], DataFrame]


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, key=pseudonyms.session_key(spark), count_col="n_replaced")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge_documents(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op3_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_trie.encode_texts(table(spark, sf_dir, "documents"), word_bpe_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learnable=one_of_five() != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (one_of_five() == 0).alias("held_out"), "score", "predicted", "abuse", "quoted")


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ngram_trie.train_and_score(docs, one_of_five() != 1, order=3)
    return scored.select("doc_id", (one_of_five() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op11_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), END_OF_FILE_DOC)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_feistel_pseudonyms, op2_line_crf, op3_canonical_fingerprint, op4_bpe_trie, op5_toxicity_automata, op6_elias_fano_lm, op7_page_wrappers, op8_hilbert_packing, op9_probminhash, op10_bloom_cascade, op11_patched_frames, op12_toivonen_collocations, op13_kronecker_negatives)}

ORACLES: dict[str, str] = {
    "op10_bloom_cascade": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                             WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                             WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
                     regexp_matches(host, '(?:^|[.-])(?:adult|ads|bets|casino|pills|spam)(?:[.-]|$)') AS is_listed FROM h)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed
        FROM r""",
    "op12_toivonen_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
        found AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM found GROUP BY ALL HAVING count(*) >= 10),
        cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        inner_of AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM cand, (VALUES (1), (2)) AS t(i) WHERE k = 3 GROUP BY ALL),
        kept AS (SELECT c.* FROM cand c LEFT JOIN inner_of s ON s.lang = c.lang AND s.phrase = c.phrase WHERE s.longer IS NULL OR 100 * s.longer < 50 * c.a),
        cuts AS (SELECT c.lang, c.phrase, c.a, t.cut, l.a AS l, r.a AS r, CAST((1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
                 FROM kept c JOIN (VALUES (1), (2)) AS t(cut) ON t.cut < c.k
                 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : t.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[t.cut + 1 : c.k], ' ')),
        least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
        SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000""",
    "op13_kronecker_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
        QUALIFY rank <= 10""",
}
