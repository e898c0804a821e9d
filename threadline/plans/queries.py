"""Registered queries of the record operators, each with its SQL form over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import fixed, rules
from threadline.functions import text as tx
from threadline.operators import graph, metrics, quality, retrieval, scoring, sessions, versioning
from threadline.operators.tables import shared_folder
from threadline.plans.base import FACTORS, facts, register, table

FAMILIES = ("click", "error", "purchase", "signup", "view")
#: Facts of the events table in SQL, for the oracles.
FACTS = f"""facts AS (SELECT event_id AS fact_id, user_id AS subject_id, event_type AS family, CAST(json_extract_string(props, '$.k') AS BIGINT) % {FACTORS} AS factor_key,
    ts AS event_ts, value, event_id AS ingest_seq FROM events)"""


# ---- sessions ------------------------------------------------------------------------------------------------------


@register("SELECT conv_id, count(*) AS n_turns, string_agg('[Turn=' || turn || '][Role=' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def session_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@register("SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transcript_blocks(session_transcripts(spark, sf_dir), "conv_id", "transcript")


@register("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, CAST(nth // 3 AS BIGINT) + 1 AS chunk_no, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM t GROUP BY ALL""")
def history_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)


@register("""WITH c AS (SELECT *, max(CASE WHEN role <> 'system' AND turn <= 3 THEN turn END) OVER (PARTITION BY conv_id) AS cutoff FROM conversations)
    SELECT conv_id, turn, role, cutoff FROM c WHERE turn <= cutoff""")
def session_prefix_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.prefix_through(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "system", 3)
    return out.select("conv_id", "turn", "role", "cutoff")


@register("""WITH o AS (SELECT conv_id, turn, (SELECT min(d.turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn >= c.turn AND d.role <> 'system') AS owner FROM conversations c)
    SELECT conv_id, owner, min(turn) AS range_start, max(turn) AS range_end FROM o WHERE owner IS NOT NULL GROUP BY conv_id, owner""")
def session_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_ranges(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "system")


@register("SELECT conv_id, turn, list_reduce(list_concat([''], list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), lambda a, x: sha256(a || x)) AS prefix_hash FROM conversations")
def prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.chained_hash(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# ---- quality -------------------------------------------------------------------------------------------------------


@register("""SELECT conv_id, turn, concat_ws(';', CASE WHEN conv_id IS NULL THEN 'session is required' END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is required' END,
    CASE WHEN coalesce(role NOT IN ('user', 'assistant'), true) THEN 'role is unknown' END) AS errors FROM conversations""")
def observation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", quality.observation_errors("conv_id", "text", "role", ("user", "assistant")).alias("errors"))


@register("""SELECT event_id, concat_ws(';', CASE WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'family is unknown' END, CASE WHEN NOT value BETWEEN 1 AND 50 THEN 'value is out of range' END) AS errors FROM events""")
def row_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = quality.errors({"family is unknown": quality.not_in("event_type", ("click", "purchase", "view")), "value is out of range": quality.outside("value", 1, 50)})
    return table(spark, sf_dir, "events").select("event_id", checks.alias("errors"))


@register("""SELECT event_id, regexp_matches(replace(props, '"k": 7', '"Token": 7'), '"(?i:k|token)"\\s*:') AS has_key, regexp_matches(replace(props, '"k": 7', '"Token": 7'), '"(?i:token|secret)"\\s*:') AS leaks FROM events""")
def payload_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").withColumn("payload", F.replace("props", F.lit('"k": 7'), F.lit('"Token": 7')))
    return seen.select("event_id", quality.forbidden_keys("payload", ("k", "token")).alias("has_key"), quality.forbidden_keys("payload", ("token", "secret")).alias("leaks"))


@register(r"""SELECT doc_id, regexp_replace(text, '(?i)\b(api_key|apikey|authorization|token|secret)("?\s*[:=]\s*")[^"]*"', '\1\2[REDACTED]"', 'g') AS text FROM documents""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality.redact(F.col("text")).alias("text"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return graph.dangling(lines, "l_orderkey", table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey")


# ---- versions ------------------------------------------------------------------------------------------------------

BY_KEY = "(PARTITION BY subject_id, family, factor_key ORDER BY ingest_seq)"


@register(f"""WITH {FACTS} SELECT fact_id, subject_id, family, factor_key, row_number() OVER {BY_KEY} AS version, lag(fact_id) OVER {BY_KEY} AS predecessor_id, lead(fact_id) OVER {BY_KEY} AS successor_id,
    coalesce(string_agg(CAST(fact_id AS VARCHAR), ',') OVER (PARTITION BY subject_id, family, factor_key ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS version_chain FROM facts""")
def fact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = versioning.in_order_versions(facts(spark, sf_dir))
    return out.select("fact_id", "subject_id", "family", "factor_key", "version", "predecessor_id", "successor_id", "version_chain")


@register(f"""WITH {FACTS}, p AS (SELECT *, lag(value) OVER {BY_KEY} AS prior FROM facts)
    SELECT fact_id, subject_id, CASE WHEN prior IS NULL THEN 'ADD' WHEN abs(value - prior) <= 5 THEN 'NOOP' ELSE 'UPDATE' END AS operation FROM p""")
def fact_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.fact_operations(facts(spark, sf_dir), 5.0).select("fact_id", "subject_id", "operation")


@register(f"""WITH {FACTS}, f AS (SELECT * REPLACE ((fact_id % 7) * 1000000000 + fact_id AS ingest_seq), fact_id AS event_order FROM facts)
    SELECT n.fact_id, n.version, (SELECT max(o.event_order) FROM f o WHERE o.subject_id = n.subject_id AND o.family = n.family AND o.factor_key = n.factor_key AND o.ingest_seq < n.ingest_seq AND o.event_order <= n.event_order) AS predecessor_id,
           (SELECT min(o.event_order) FROM f o WHERE o.subject_id = n.subject_id AND o.family = n.family AND o.factor_key = n.factor_key AND o.ingest_seq < n.ingest_seq AND o.event_order > n.event_order) AS successor_id
    FROM (SELECT *, row_number() OVER {BY_KEY} AS version FROM f) n""")
def backfill_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = facts(spark, sf_dir).withColumn("ingest_seq", F.pmod("fact_id", F.lit(7)) * 1_000_000_000 + F.col("fact_id")).withColumn("event_order", F.col("fact_id"))
    return versioning.backfill_versions(late).select("fact_id", "version", "predecessor_id", "successor_id")


@register(f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, family, factor_key ORDER BY event_ts DESC, ingest_seq DESC) AS rn, count(*) OVER (PARTITION BY subject_id, family, factor_key) AS n_versions FROM facts)
    SELECT subject_id, family, factor_key, fact_id, value, event_ts, n_versions FROM r WHERE rn = 1""")
def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.current_facts(facts(spark, sf_dir))


@register(f"""WITH {FACTS} SELECT subject_id, factor_key, arg_max(fact_id, event_ts) AS fact_id, arg_max(value, event_ts) AS value FROM facts GROUP BY subject_id, factor_key""")
def state_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.keep_newest(facts(spark, sf_dir), ["subject_id", "factor_key"], F.col("event_ts"), ["fact_id", "value"])


@register(f"WITH {FACTS} SELECT subject_id, fact_id, row_number() OVER (PARTITION BY subject_id ORDER BY event_ts NULLS FIRST, family, fact_id) AS place FROM facts")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.timeline(facts(spark, sf_dir), "subject_id").select("subject_id", "fact_id", "place")


@register(f"WITH {FACTS} SELECT subject_id, count(*) AS n_facts, count(DISTINCT family) AS n_families, max(ingest_seq) AS last_seq FROM facts GROUP BY subject_id")
def subject_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n_facts"), F.countDistinct("family").alias("n_families"), F.max("ingest_seq").alias("last_seq"))


@register(f"WITH {FACTS} SELECT subject_id, " + ", ".join(f"count(*) FILTER (family = '{f}') AS {f}" for f in FAMILIES) + " FROM facts GROUP BY subject_id")
def family_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("subject_id").pivot("family", list(FAMILIES)).count().na.fill(0)


@register(f"WITH {FACTS} SELECT subject_id, concat_ws(':', count(*), max(ingest_seq), count(*) FILTER (family = 'error')) AS revision FROM facts GROUP BY subject_id")
def revision_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("subject_id").agg(F.concat_ws(":", F.count("*").cast("string"), F.max("ingest_seq").cast("string"), F.count_if(F.col("family") == "error").cast("string")).alias("revision"))


# ---- graph ---------------------------------------------------------------------------------------------------------

RANK = "CASE family WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@register(f"""WITH {FACTS}, r AS (SELECT *, date_trunc('hour', event_ts) AS hour, {RANK} AS rank FROM facts), h AS (SELECT subject_id, hour, rank AS to_rank, min(fact_id) AS to_id FROM r GROUP BY ALL)
    SELECT r.subject_id, r.hour, r.fact_id AS from_id, h.to_id, r.rank AS from_rank, h.to_rank FROM r JOIN h USING (subject_id, hour) WHERE r.rank < h.to_rank""")
def shared_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = facts(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "event_ts"))
    return graph.shared_source_edges(nodes, ["subject_id", "hour"], F.expr(RANK))


@register(f"""WITH {FACTS}, e AS (SELECT subject_id, fact_id AS to_id, lag(fact_id) OVER {BY_KEY} AS from_id, lag(value) OVER {BY_KEY} AS before, value FROM facts)
    SELECT subject_id, from_id, to_id, CASE WHEN value = before THEN 'persists' ELSE 'updates' END AS relation FROM e WHERE from_id IS NOT NULL""")
def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transition_edges(facts(spark, sf_dir))


@register(f"""WITH {FACTS} SELECT p.subject_id, p.fact_id, (SELECT max(s.fact_id) FROM facts s WHERE s.subject_id = p.subject_id AND s.family = 'signup' AND s.event_ts < p.event_ts) AS match_id FROM facts p WHERE p.family = 'purchase'""")
def plan_outcome_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_facts = facts(spark, sf_dir)
    return graph.asof_by_ingest(all_facts.filter("family = 'purchase'"), all_facts.filter("family = 'signup'"), ["subject_id"])


@register(f"""WITH {FACTS}, e AS (SELECT fact_id AS to_id, lag(fact_id) OVER (PARTITION BY subject_id ORDER BY ingest_seq) AS from_id, family AS relation FROM facts)
    SELECT to_id, concat_ws(';', CASE WHEN from_id IS NULL THEN 'from is required' END, CASE WHEN coalesce(from_id = to_id, true) THEN 'self loop' END, CASE WHEN relation NOT IN ('click', 'view', 'purchase') THEN 'relation is unknown' END) AS errors FROM e""")
def edge_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    edges = facts(spark, sf_dir).select(F.col("fact_id").alias("to_id"), F.lag("fact_id").over(W.partitionBy("subject_id").orderBy("ingest_seq")).alias("from_id"), F.col("family").alias("relation"))
    return edges.select("to_id", quality.edge_errors(("click", "view", "purchase")).alias("errors"))


@register(f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id, factor_key ORDER BY event_ts DESC, fact_id DESC) AS rn, count(*) OVER (PARTITION BY subject_id, factor_key) AS n_nodes FROM facts)
    SELECT subject_id, factor_key, fact_id AS head_id, CASE WHEN family = 'error' THEN 'conflict' ELSE 'current' END AS state, n_nodes FROM r WHERE rn = 1""")
def current_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.current_heads(facts(spark, sf_dir), ["subject_id", "factor_key"], F.struct("event_ts", "fact_id"), F.col("family") == "error")


@register()
def lineage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of orders and suppliers' parts; order keys are even and part keys odd nodes."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("order_node"), (F.col("l_partkey") * 2 + 1).alias("part_node"))
    return graph.components(lines, "order_node", "part_node")


@register("""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS difference
    FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT * REPLACE (CASE WHEN o_custkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderpriority <> '5-LOW') b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return graph.snapshot_differences(orders.filter("o_orderstatus <> 'P'"), new, "o_orderkey")


# ---- text and retrieval --------------------------------------------------------------------------------------------


@register("""WITH c AS (SELECT doc_id, regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]', '', 'g') AS t FROM documents)
    SELECT doc_id, length(t) AS n_compact, CASE WHEN length(t) >= 3 THEN (SELECT count(DISTINCT substr(t, i, 3)) FROM range(1, length(t) - 1) r(i)) ELSE 0 END AS n_grams FROM c""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tx.compact(F.lower("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_compact"), F.size(tx.char_ngrams(F.col("t"), 3)).cast("long").alias("n_grams"))


TERMS = retrieval.TERM.replace("IsHan", "Han")


@register(f"""SELECT term, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TERMS}')) AS term FROM documents) GROUP BY term, doc_id""")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit(retrieval.TERM), F.lit(0))
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id", found)


HITS = f"""p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TERMS}'))) AS term FROM documents), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TERMS}'))) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, count(*) AS hits, round(5.0 * least(count(*), 24), 3)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_terms = lambda name, key: table(spark, sf_dir, name).select(key, retrieval.terms(F.col("text")).alias("terms"))
    return retrieval.lexical_hits(by_terms("benchmark", "item_id"), "item_id", by_terms("documents", "doc_id"), "doc_id", 24)


@register(f"WITH {HITS} SELECT doc_id, count(*) AS n_items, sum(hits)::BIGINT AS hits, max(score) AS best_score FROM s GROUP BY doc_id")
def indexed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items by all terms that both have, frequent ones too: its items, hits and best score."""
    return hits(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("hits").alias("hits"), F.max("score").alias("best_score"))


@register(f"WITH {HITS}, r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS place FROM s) SELECT * FROM r WHERE place <= 12")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(hits(spark, sf_dir), ["item_id"], [F.desc("hits"), F.asc("doc_id")], 12).select("item_id", "doc_id", "score", "place")


@register("SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 5")
def option_quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 5)


@register("""WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS round FROM documents), f AS (SELECT *, min(rank) OVER (PARTITION BY source) AS first FROM r)
    SELECT doc_id, source, round, row_number() OVER (ORDER BY round, first) AS place FROM f""")
def provenance_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length, one of each source a round."""
    return retrieval.interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "round", "place")


@register("""WITH k AS (SELECT doc_id, n_chars, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS same, source FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY n_chars DESC, doc_id) AS rn FROM k)
    SELECT max(CASE WHEN rn = 1 THEN doc_id END) AS best_id, max(n_chars) AS best_score, count(*) AS members, min(doc_id) AS first_id FROM b GROUP BY same""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.merge_duplicates(table(spark, sf_dir, "documents"), F.md5(scoring.normal_answer(F.col("text")).cast("binary")), "doc_id", F.col("n_chars"))


@register("""WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM conversations)
    SELECT conv_id, turn, sentence, count(*) AS n FROM s GROUP BY ALL""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("sentence")).groupBy("conv_id", "turn", "sentence").agg(F.count("*").alias("n"))


@register(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{M}\p{N}_])(?:may|might|maybe|perhaps|possibly|unsure)(?:[^\p{L}\p{M}\p{N}_]|$)') THEN 'uncertain' WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{M}\p{N}_])(?:no|not|never|none|without)(?:[^\p{L}\p{M}\p{N}_]|$)') THEN 'negated' ELSE 'affirmed' END AS polarity,
    CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{M}\p{N}_])(?:may|might|maybe|perhaps|possibly|unsure)(?:[^\p{L}\p{M}\p{N}_]|$)') THEN 0.55 ELSE 1.0 END::DOUBLE AS certainty FROM conversations""")
def polarity_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.polarity(F.col("text")).alias("polarity"), tx.certainty(F.col("text")).alias("certainty"))


RULES = {"numbers": "[0-9]{3,}", "marks": "[#$%&*]{3}", "bars": r"\|", "the": r"(?i)\bthe\b", "licence": "(?i)licen[cs]e"}


@register("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in RULES.items()) + ") AS families FROM documents")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.labels(F.col("text"), RULES), ",").alias("families"))


@register(r"""SELECT page_id, array_to_string(regexp_extract_all(lower(html), '[0-9]+(?:\.[0-9]+)? ?(?:px|em|mg|ml)\b'), '|') AS quantities FROM pages""")
def quant_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.quantities(F.col("html"), ("px", "em", "mg", "ml")).alias("quantities"))


@register("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS n_latin, len(regexp_extract_all(text, '[À-ÿ]')) AS n_accented FROM documents")
def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("n_latin"), F.regexp_count("text", F.lit("[À-ÿ]")).cast("long").alias("n_accented"))


# ---- scoring and metrics -------------------------------------------------------------------------------------------


@register("""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents), e AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS g FROM n),
    p AS (SELECT doc_id, unnest(string_split(t, ' ')) AS token FROM e WHERE g IS NOT NULL), q AS (SELECT doc_id, unnest(string_split(g, ' ')) AS token FROM e WHERE g IS NOT NULL),
    a AS (SELECT doc_id, token, count(*) AS np FROM p WHERE token <> '' GROUP BY ALL), b AS (SELECT doc_id, token, count(*) AS ng FROM q WHERE token <> '' GROUP BY ALL),
    s AS (SELECT doc_id, CAST(sum(CASE WHEN np IS NOT NULL AND ng IS NOT NULL THEN least(np, ng) ELSE 0 END) AS BIGINT) AS shared, sum(coalesce(np, 0)) + sum(coalesce(ng, 0)) AS both_sides FROM a FULL JOIN b USING (doc_id, token) GROUP BY doc_id)
    SELECT doc_id, shared, CASE WHEN shared > 0 THEN round(2.0::DOUBLE * shared / both_sides, 6) ELSE 0 END AS f1 FROM s""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even document against the next odd one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 2).alias("pair"))
    odd = docs.filter("doc_id % 2 = 1").select("pair", F.col("text").alias("gold"))
    return scoring.token_f1(docs.filter("doc_id % 2 = 0").join(odd, "pair"), "doc_id", "text", "gold")


@register("SELECT doc_id, round((greatest(1, least(5, quality * 4 + 1)) + greatest(1, least(5, toxic * 9 - 2)))::DOUBLE / 2, 3) AS mean_score FROM labels")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(F.col("quality") * 4 + 1, F.col("toxic") * 9 - 2)
    return table(spark, sf_dir, "labels").select("doc_id", F.round(scoring.rubric_mean(marks, 1, 5), 3).alias("mean_score"))


@register("""SELECT source, lang, count(*) AS n, count(quality) AS n_judged, count(*) FILTER (quality = 1) AS n_correct, round(avg(quality), 6) AS accuracy, round(avg(CASE WHEN quality = 1 THEN n_chars::DOUBLE END), 6) AS mean_score
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.query_metrics(rows, ["source", "lang"], F.col("quality") == 1, F.when(F.col("quality") == 1, F.col("n_chars").cast("double")))


@register("SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def scope_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.scope_rollup(rows, "lang", [F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate")])


@register("""WITH t AS (SELECT l_orderkey, bool_or(l_returnflag <> 'R') AS ok FROM lineitem WHERE l_quantity > 10 GROUP BY 1), j AS (SELECT o_orderpriority, ok FROM orders LEFT JOIN t ON o_orderkey = l_orderkey),
    g AS (SELECT o_orderpriority, count(*) AS expected, count(ok) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS unattempted FROM j GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN unattempted > 0 THEN 'partial' ELSE 'complete' END AS status FROM g""")
def build_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), "o_orderpriority")
    tries = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("order"), "l_returnflag")
    return metrics.completeness(orders, tries, "order", "o_orderpriority", F.col("l_returnflag") != "R")


@register("SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1 GROUP BY 1, 2")
def latest_per_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.keep_newest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"])


@register("""SELECT d.doc_id, CASE WHEN n_chars < 100 THEN 'X1' WHEN quality IS NULL THEN 'X3' WHEN toxic = 1 THEN 'M5' WHEN quality = 0 THEN 'M2' ELSE 'none' END AS code FROM documents d LEFT JOIN labels USING (doc_id)""")
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    code = metrics.first_failure([("X1", F.col("n_chars") < 100), ("X3", F.col("quality").isNull()), ("M5", F.col("toxic") == 1), ("M2", F.col("quality") == 0)], "none")
    return rows.select("doc_id", code.alias("code"))


@register("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus <> 'O') AS terminal, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus <> 'O') / count(*), 4) AS percent FROM orders GROUP BY 1")
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") != "O")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), done.alias("terminal"), F.round(100.0 * done / F.count("*"), 4).alias("percent"))


@register("SELECT l_orderkey, count(*) AS n_lines, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity, round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE, 2) AS price FROM lineitem GROUP BY 1")
def run_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("price"))


# ---- streams -------------------------------------------------------------------------------------------------------


@register("SELECT event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE, 2) AS total FROM events GROUP BY 1")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadline.streaming import streams

    stream = streams.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = streams.latest_of_batches(streams.progress(stream, "event_type", "value"), ["event_type"], shared_folder(spark))
    return out.withColumn("total", F.col("total").cast("double"))


@register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
    n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM n GROUP BY user_id, nth""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a gap of half an hour, by the window that the stream of sessions uses too."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = events.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


@register(f"""WITH {FACTS}, c AS (SELECT subject_id, max(event_ts) FILTER (family = 'purchase') AS cutoff FROM facts GROUP BY subject_id)
    SELECT subject_id, count(*) FILTER (event_ts <= cutoff) AS n_visible, count(*) FILTER (event_ts > cutoff OR cutoff IS NULL) AS n_hidden FROM facts JOIN c USING (subject_id) GROUP BY subject_id""")
def point_in_time_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts up to each subject's last purchase are visible; without one nothing is."""
    known = facts(spark, sf_dir)
    cutoffs = known.groupBy("subject_id").agg(F.max(F.when(F.col("family") == "purchase", F.col("event_ts"))).alias("cutoff"))
    seen = F.coalesce(F.col("event_ts") <= F.col("cutoff"), F.lit(False))
    return known.join(cutoffs, "subject_id").groupBy("subject_id").agg(F.count_if(seen).alias("n_visible"), F.count_if(~seen).alias("n_hidden"))


@register("""WITH s AS (SELECT o_orderkey, unnest(parts) AS p_partkey FROM (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)), k AS (SELECT p_partkey FROM part WHERE p_size <= 25)
    SELECT o_orderkey, count(k.p_partkey) AS n_resolved, count(*) - count(k.p_partkey) AS n_missing FROM s LEFT JOIN k USING (p_partkey) GROUP BY o_orderkey""")
def evidence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part references of each order, resolved against the small parts."""
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    known = table(spark, sf_dir, "part").filter("p_size <= 25").select("p_partkey", F.lit(1).alias("known"))
    found = refs.select("o_orderkey", F.explode("parts").alias("p_partkey")).join(known, "p_partkey", "left")
    return found.groupBy("o_orderkey").agg(F.count("known").alias("n_resolved"), F.count_if(F.col("known").isNull()).alias("n_missing"))


@register(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([A-F])(?:[^\p{L}\p{N}_]|$)', 1))), ',') AS letters, list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])([A-F])(?:[^\p{L}\p{N}_]|$)', 1))) = ['A'] AS is_correct FROM conversations""")
def option_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = tx.option_letters(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(letters, ",").alias("letters"), (letters == F.array(F.lit("A"))).alias("is_correct"))


ANSWER = "CASE turn % 5 WHEN 3 THEN 'Not mentioned, in the record.' WHEN 4 THEN 'The question is NOT answerable: ask the doctor' ELSE text END"


@register(f"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower({ANSWER}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) IN (" + ", ".join(f"'{p}'" for p in fixed.ABSTENTIONS) + ") AS abstains FROM conversations")
def abstention_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a whole turn, in normal form, is one of the accepted phrases."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.abstains(F.expr(ANSWER)).alias("abstains"))


@register("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN 'k is missing' WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'k is out of range' ELSE '' END AS error FROM events""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads as scores, with what is wrong with them."""
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k.isNull(), "k is missing").when(k > 90, "k is out of range").otherwise("").alias("error"))


@register("SELECT lang, source, count(*) AS n_cases, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS n_wrong, min(CASE WHEN quality = 0 THEN doc_id END) AS first_wrong FROM documents JOIN labels USING (doc_id) GROUP BY lang, source")
def error_case_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n_cases"), F.count_if(F.col("quality") == 0).alias("n_wrong"), F.min(F.when(F.col("quality") == 0, F.col("doc_id"))).alias("first_wrong"))


@register("SELECT n_regionkey, sha256(string_agg(n_name, '|' ORDER BY n_name)) AS scope_key, count(*) AS n FROM nation GROUP BY n_regionkey")
def scope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("scope_key"), F.count("*").alias("n"))


@register("""WITH h AS (SELECT doc_id % 2 AS half, avg(quality) AS quality, avg(toxic) AS toxic FROM labels GROUP BY 1)
    SELECT round(b.quality - a.quality, 6) AS quality_gain, round(b.toxic - a.toxic, 6) AS toxic_gain, b.quality >= a.quality AND b.toxic <= a.toxic AS accepted FROM h a, h b WHERE a.half = 0 AND b.half = 1""")
def patch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the odd half against those of the even half, and whether none is worse."""
    side = lambda n, c: F.avg(F.when(F.col("doc_id") % 2 == n, F.col(c)))
    m = table(spark, sf_dir, "labels").agg(side(0, "quality").alias("q0"), side(1, "quality").alias("q1"), side(0, "toxic").alias("t0"), side(1, "toxic").alias("t1"))
    return m.select(F.round(F.col("q1") - F.col("q0"), 6).alias("quality_gain"), F.round(F.col("t1") - F.col("t0"), 6).alias("toxic_gain"), ((F.col("q1") >= F.col("q0")) & (F.col("t1") <= F.col("t0"))).alias("accepted"))


@register("""WITH f AS (SELECT event_id, user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS session_no, event_type FROM events), n AS (SELECT user_id, event_type, min(session_no) FILTER (session_no > 2) AS next_session FROM f GROUP BY ALL)
    SELECT user_id, event_type, count(*) FILTER (session_no BETWEEN 1 AND 2) AS n_in_window, next_session FROM f JOIN n USING (user_id, event_type) GROUP BY user_id, event_type, next_session""")
def query_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each type in the first two days, and the next later day that has the type."""
    day = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long")
    rows = table(spark, sf_dir, "events").withColumn("session_no", day)
    return rows.groupBy("user_id", "event_type").agg(F.count_if(F.col("session_no").between(1, 2)).alias("n_in_window"), F.min(F.when(F.col("session_no") > 2, F.col("session_no"))).alias("next_session"))


@register(f"WITH {HITS}, n AS (SELECT item_id, count(*) AS n_terms FROM q GROUP BY 1) SELECT item_id, doc_id, hits, round(hits::DOUBLE / n_terms, 6) AS similarity FROM s JOIN n USING (item_id) WHERE hits::DOUBLE / n_terms >= 0.42")
def lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each benchmark item's terms that a document has, for the pairs with 0.42 or more."""
    share = F.col("hits") / F.col("n_terms")
    return hits(spark, sf_dir).filter(share >= 0.42).select("item_id", "doc_id", "hits", F.round(share, 6).alias("similarity"))
