"""Registered queries that rank each subject's states for a question about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.operators import ranking, selection
from threadline.operators import states as st
from threadline.operators.tables import materialize
from threadline.plans.base import PHRASES, STATEMENTS, TASKS, _pick, matches, quoted, register, statements
from threadline.plans.rule_queries import FACETS_SQL, OPERATOR_SQL, SCOPES_SQL, aliases_sql
from threadline.plans.state_queries import LINKS, searchable

TERMS = ("metformin", "glucose", "pain", "insulin", "二甲双胍", "family support", "blood pressure", "sleep", "空腹血糖", "HbA1c")
#: A question about each subject, in SQL that both engines read.
QUESTION = {
    "query_id": "subject_id", "task": _pick(TASKS, "subject_id"), "question": _pick(PHRASES, "subject_id"), "kw1": _pick(TERMS, "subject_id"), "kw2": _pick(TERMS, "(subject_id * 3 + 1)"), "target": _pick(TERMS, "(subject_id * 7 + 5)"),
    "opt1": _pick(TERMS, "(subject_id + 4)"), "opt2": _pick(TERMS, "(subject_id + 7)"),
}
QUESTIONS_SQL = f"qs AS (SELECT *, {OPERATOR_SQL} AS operator, {SCOPES_SQL} AS scopes, {FACETS_SQL} AS facets, list_distinct([kw1, kw2]) AS keywords, CASE WHEN task = 'multiple_choice' THEN [opt1, opt2] ELSE CAST([] AS VARCHAR[]) END AS options FROM (SELECT *, question AS text FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in QUESTION.items())} FROM (SELECT DISTINCT subject_id FROM st))))"


def questions(rows: DataFrame) -> DataFrame:
    # A question's rules cost more than its bytes tell: their rows stay spread over the tasks.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = rows.select("subject_id").distinct().repartition(parts, "subject_id").selectExpr(*[f"{e} AS {n}" for n, e in QUESTION.items()])
    text, task = F.col("question"), F.col("task")
    options = F.when(task == "multiple_choice", F.array(F.struct(F.lit("A").alias("id"), F.col("opt1").alias("text")), F.struct(F.lit("B").alias("id"), F.col("opt2").alias("text")))).otherwise(F.array().cast("array<struct<id:string,text:string>>"))
    return q.select("query_id", "task", "question", "target", F.array_distinct(F.array("kw1", "kw2")).alias("keywords"), options.alias("options"), rules.temporal_operator(text, task).alias("operator"), rules.question_scopes(text, task).alias("scopes"), F.array_sort(rules.question_facets(text, task)).alias("facets"))


def scored(spark: SparkSession, sf_dir: str, asked: str = "true") -> DataFrame:
    """Statements against their subject's question, of the questions that meet ``asked``."""
    rows = statements(spark, sf_dir)
    pairs = searchable(rows).select("subject_id", "state_id", "family", "status", "polarity", "seconds", "text", "searchable").join(ranking.with_parts(questions(rows).filter(asked)).withColumnRenamed("query_id", "subject_id"), "subject_id").withColumnRenamed("subject_id", "query_id")
    return ranking.score(pairs)


SIM = lambda t: f"""(SELECT CASE WHEN q = '' OR doc = '' THEN 0.0::DOUBLE WHEN contains(doc, q) THEN 1.0 WHEN regexp_matches(q, '\\p{{Han}}') THEN len(list_filter(grams, lambda g: contains(doc, g)))::DOUBLE / greatest(1, len(grams))
    WHEN len(tokens) = 0 THEN 0.0 ELSE len(list_filter(tokens, lambda k: list_contains(string_split_regex(doc, '[^a-z0-9]+'), k)))::DOUBLE / len(tokens) END
    FROM (SELECT q, list_distinct(list_filter(string_split_regex(q, '[^a-z0-9]+'), lambda k: length(k) > 1)) AS tokens, list_distinct(CASE WHEN length(q) >= 4 THEN list_transform(range(1, length(q)), lambda i: q[i:i+1]) ELSE list_transform(range(1, length(q) + 1), lambda i: q[i:i]) END) AS grams FROM (SELECT regexp_replace(lower({t}), '[\\s\\p{{P}}\\p{{S}}]', '', 'g') AS q)))"""  # noqa: E731
SCORED = f"""{LINKS}, ev AS (SELECT l.state_id, string_agg(e.text, ' ' ORDER BY l.place) AS words FROM links l JOIN evidence e USING (evidence_id) WHERE e.text <> '' GROUP BY 1), {QUESTIONS_SQL},
    pr AS (SELECT st.state_id, st.family, st.status, st.polarity, st.seconds, st.text AS body, lower(concat_ws(' ', st.text, family, status, polarity, words)) AS hay, qs.* EXCLUDE (text) FROM st LEFT JOIN ev USING (state_id) JOIN qs ON qs.query_id = st.subject_id),
    dc AS (SELECT *, regexp_replace(hay, '[\\s\\p{{P}}\\p{{S}}]', '', 'g') AS doc FROM pr),
    seeded AS (SELECT *, list_concat(keywords, [target], options) AS seeds, list_filter(flatten(list_transform(facets, lambda f: string_split(f, '_'))), lambda w: length(w) > 2) AS fwords FROM dc),
    al AS (SELECT term, {aliases_sql('term')} AS syn FROM (SELECT unnest({list(TERMS)}) AS term)),
    tm AS (SELECT state_id, term, {SIM('term')} AS sim FROM (SELECT DISTINCT state_id, doc, unnest(list_concat(list_filter(list_distinct(list_concat(seeds, fwords)), lambda t: NOT contains(hay, lower(t)) AND length(t) > 1))) AS term FROM seeded)),
    nearest AS (SELECT state_id, max(sim) AS nearest FROM tm GROUP BY 1),
    cn AS (SELECT state_id, count(*) AS n FROM (SELECT state_id, hay, doc, term, {SIM('term')} AS sim FROM (SELECT state_id, hay, doc, unnest({list(ranking.CONCEPTS)}) AS term FROM dc WHERE task IN {fx.COMPLEX_TASKS} AND regexp_matches(lower(concat_ws(' ', question, target, array_to_string(keywords, ' '))), '{ranking.DIABETES}'))) WHERE contains(hay, lower(term)) OR sim >= 0.7 GROUP BY 1),
    ac AS (SELECT state_id, count(DISTINCT a) AS n FROM (SELECT state_id, hay, unnest(al.syn) AS a FROM (SELECT state_id, hay, unnest(seeds) AS term FROM seeded) JOIN al USING (term)) WHERE contains(hay, lower(a)) GROUP BY 1),
    op AS (SELECT state_id, list(id ORDER BY id) FILTER (s > 0) AS option_ids, sum(least(2.4, s)) AS s FROM (SELECT state_id, id, CASE WHEN contains(hay, lower(term)) THEN 2.4 WHEN len(list_filter(syn, lambda a: contains(hay, lower(a)))) > 0 THEN 2.1 WHEN sim >= 0.55 THEN sim * 2 ELSE 0 END AS s
        FROM (SELECT o.*, al.syn, {SIM('o.term')} AS sim FROM (SELECT state_id, hay, doc, unnest(options) AS term, unnest(range(1, len(options) + 1)) AS nth FROM dc) o JOIN al USING (term)), LATERAL (SELECT CASE nth WHEN 1 THEN 'A' ELSE 'B' END AS id)) GROUP BY 1),
    base AS (SELECT seeded.*, list_filter(keywords, lambda k: contains(hay, lower(k))) AS hk, contains(hay, lower(target)) AS ht, coalesce(ac.n, 0) AS na, coalesce(cn.n, 0) AS nc, coalesce(nearest, 0) AS near, coalesce(op.s, 0) AS so, coalesce(op.option_ids, CAST([] AS VARCHAR[])) AS option_ids,
        list_filter(facets, lambda f: len(list_filter(string_split(f, '_'), lambda w: length(w) > 2 AND contains(hay, w))) > 0) AS mf, coalesce(list_max(list_transform(list_filter(scopes, lambda s: s[1:2] = family), lambda s: CAST(s[4:4] AS INT))), 0) AS sw
        FROM seeded LEFT JOIN ac USING (state_id) LEFT JOIN cn USING (state_id) LEFT JOIN nearest USING (state_id) LEFT JOIN op USING (state_id)),
    sc AS (SELECT query_id, state_id, family, polarity, seconds, body, operator, task, option_ids, mf, round(list_sum(list_concat([0.0::DOUBLE], list_transform(hk, lambda k: 4 + least(1.0, length(k) / 20)))) + CASE WHEN ht THEN 4.25 ELSE 0 END + CASE WHEN na > 0 THEN 3.8 + least(1.0, na * 0.15) ELSE 0 END
        + CASE WHEN nc > 0 THEN 2.25 + least(1.25, nc * 0.2) ELSE 0 END + CASE WHEN near >= 0.42 THEN near * 2.7 ELSE 0 END + len(mf) * 0.55 + CASE WHEN sw > 0 THEN 0.45 + sw * 0.25 ELSE 0 END + so
        + CASE WHEN task = 'state_update' THEN CASE WHEN status = 'active' THEN 0.45 ELSE 0 END + CASE WHEN family = 'LO' THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(hay, '{ranking.STATUS_WORDS}') THEN 0.3 ELSE 0 END ELSE 0 END
        + CASE WHEN task = 'temporal_localization' THEN 0.25 ELSE 0 END + CASE WHEN task IN {fx.COMPLEX_TASKS} AND len(mf) > 0 THEN 0.3 ELSE 0 END, 4)::DOUBLE AS score,
        list_filter([CASE WHEN ht THEN 'target_match' END, CASE WHEN len(hk) > 0 THEN 'keyword_match' END, CASE WHEN na > 0 THEN 'medical_alias_match' END, CASE WHEN nc > 0 THEN 'semantic_concept_match' END, CASE WHEN near >= 0.42 THEN 'lexical_ngram_match' END,
            CASE WHEN len(mf) > 0 THEN 'evidence_facet_match' END, CASE WHEN sw > 0 THEN 'scope_family_prior' END, CASE WHEN so > 0 THEN 'option_match' END], lambda x: x IS NOT NULL) AS reasons FROM base),
    tr AS (SELECT *, CASE WHEN list_has_any(reasons, {list(ranking.STRONG)}) THEN 3 WHEN list_has_any(reasons, ['lexical_ngram_match', 'evidence_facet_match']) THEN 2 ELSE 1 END AS tier FROM sc WHERE len(reasons) > 0),
    od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN operator IN ('earliest', 'latest') THEN -tier ELSE 0 END, CASE operator WHEN 'earliest' THEN seconds WHEN 'latest' THEN -seconds ELSE 0 END, score DESC, seconds DESC, list_position({list(fx.FAMILIES)}, family), lower(body), state_id) AS place FROM tr)"""


@register(f"WITH {SCORED} SELECT query_id, state_id, score, array_to_string(reasons, ',') AS reasons, array_to_string(mf, ',') AS facets, array_to_string(option_ids, ',') AS options FROM sc")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of a subject against the question about it."""
    return scored(spark, sf_dir).select("query_id", "state_id", "score", F.array_join("reasons", ",").alias("reasons"), F.array_join("matched_facets", ",").alias("facets"), F.array_join("option_ids", ",").alias("options"))


def candidates(spark: SparkSession, sf_dir: str, asked: str = "true") -> DataFrame:
    # Stored, as a filter on the reasons alone would have Spark work every score out twice.
    return ranking.ordered(materialize(scored(spark, sf_dir, asked).drop("searchable"), "scored").filter(F.size("reasons") > 0))


LIMIT_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in fx.CANDIDATE_LIMITS.items()) + " ELSE 12 END"


@register(f"WITH {SCORED} SELECT query_id, state_id, place, score FROM od WHERE place <= {LIMIT_SQL}")
def task_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that a question of its task may keep."""
    return candidates(spark, sf_dir).filter(F.col("place") <= rules.candidate_limit(F.col("task"), F.size("options"))).select("query_id", "state_id", "place", "score")


SCHEDULE = f"""{SCORED}, held AS (SELECT od.query_id, od.place, l.evidence_id FROM od JOIN links l USING (state_id)), fst AS (SELECT query_id, evidence_id, min(place) AS first FROM held GROUP BY 1, 2),
    nov AS (SELECT query_id, place, bool_or(first = place) AS novel FROM held JOIN fst USING (query_id, evidence_id) GROUP BY 1, 2), near_pairs AS (SELECT DISTINCT a.query_id, a.place AS a, b.place AS b FROM held a JOIN held b USING (query_id, evidence_id)),
    reach AS (SELECT query_id, place AS a, place AS b FROM od UNION SELECT reach.query_id, reach.a, p.b FROM reach JOIN near_pairs p ON p.query_id = reach.query_id AND p.a = reach.b), grp AS (SELECT query_id, a AS place, min(b) AS g FROM reach GROUP BY 1, 2),
    gs AS (SELECT *, count(*) OVER (PARTITION BY query_id, g) AS n FROM grp), pp AS (SELECT od.*, gs.g, CASE WHEN gs.n = 1 THEN 'unique' WHEN od.place = gs.g THEN 'representative' WHEN coalesce(novel, false) THEN 'novel_evidence' ELSE 'deferred_sibling' END AS priority FROM od JOIN gs USING (query_id, place) LEFT JOIN nov USING (query_id, place)),
    tn AS (SELECT *, CASE WHEN priority = 'deferred_sibling' THEN row_number() OVER (PARTITION BY query_id, g, priority ORDER BY place) ELSE 0 END AS turn FROM pp),
    sd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, CASE WHEN priority = 'deferred_sibling' THEN g ELSE place END) AS schedule FROM tn)"""


def scheduled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from threadline.plans.base import table  # noqa: F401

    links = st.links_of(statements(spark, sf_dir))
    return ranking.provenance_schedule(candidates(spark, sf_dir), links), links


@register(f"WITH RECURSIVE {SCHEDULE} SELECT query_id, state_id, place, priority, schedule FROM sd")
def provenance_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that bring evidence of their own first, their siblings in turn after them."""
    return scheduled(spark, sf_dir)[0].select("query_id", "state_id", "place", "priority", "schedule")


@register(f"""WITH RECURSIVE {SCHEDULE}, ek AS (SELECT state_id, string_agg(DISTINCT CAST(evidence_id AS VARCHAR), '|' ORDER BY CAST(evidence_id AS VARCHAR)) AS evidence_key FROM links GROUP BY 1),
    k AS (SELECT sd.*, concat_ws(chr(1), polarity, trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), evidence_key) AS same FROM sd LEFT JOIN ek USING (state_id))
    SELECT query_id, arg_min(state_id, schedule) AS state_id, min(schedule) AS schedule, max(score) AS score, string_agg(CAST(state_id AS VARCHAR), ',' ORDER BY schedule) AS members, count(*) AS n_members,
        array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS reasons, array_to_string(list_sort(list_distinct(list(family))), ',') AS families FROM k GROUP BY query_id, same""")
def coalesced_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links = scheduled(spark, sf_dir)
    return ranking.coalesced(rows, links)


@register(f"""WITH {SCORED}, mc AS (SELECT * FROM od WHERE task = 'multiple_choice'), po AS (SELECT query_id, state_id, place, unnest(option_ids) AS option FROM mc), tk AS (SELECT DISTINCT query_id, state_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, option ORDER BY place) AS nth FROM po) WHERE nth <= 6),
    rk AS (SELECT mc.query_id, mc.state_id, mc.place, tk.state_id IS NOT NULL AS by_quota, row_number() OVER (PARTITION BY mc.query_id ORDER BY tk.state_id IS NOT NULL DESC, place) AS rank FROM mc LEFT JOIN tk USING (query_id, state_id)) SELECT query_id, state_id, place, by_quota FROM rk WHERE rank <= 12""")
def option_quota_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with options: the best of each option up to its share of twelve, then the best of the rest."""
    rows = candidates(spark, sf_dir, "task = 'multiple_choice'").withColumn("n_options", F.size("options"))
    return ranking.quota_selection(rows, rules.candidate_limit(F.col("task"), F.col("n_options")))


DIVERSIFIED = f"""{SCORED}, wt AS (SELECT od.*, q.facets AS asked, q.scopes, list_has_any(reasons, {[*ranking.STRONG, 'semantic_concept_match']}) AS strong FROM od JOIN qs q USING (query_id)),
    wq AS (SELECT *, (SELECT max(CAST(s[4:5] AS INT)) FROM (SELECT unnest(scopes) AS s) WHERE s[1:2] = family) * 10 + {' + '.join(f"CASE WHEN family = '{f}' AND list_contains(asked, '{n}') THEN {v} ELSE 0 END" for n, f, v, _ in selection.QUOTAS)} AS weight,
        coalesce({', '.join(f"CASE WHEN family = '{f}' AND list_contains(asked, '{n}') THEN {q} END" for n, f, _, q in selection.QUOTAS if q > 1)}, 1) AS quota, strong AND row_number() OVER (PARTITION BY query_id, strong ORDER BY place) <= {selection.STRONG_FIRST} AS head FROM wt),
    nf AS (SELECT *, row_number() OVER (PARTITION BY query_id, family, head ORDER BY place) AS nth, count(*) FILTER (head) OVER (PARTITION BY query_id, family) AS heads FROM wq),
    s1 AS (SELECT *, CASE WHEN head THEN 1 WHEN weight >= 100 AND heads = 0 AND nth = 1 THEN 2 WHEN weight >= 100 AND nth <= quota - heads THEN 3 WHEN weight < 100 AND heads = 0 AND nth = 1 THEN 4 END AS early FROM nf),
    fresh AS (SELECT query_id, arg_min(state_id, place) AS state_id FROM (SELECT query_id, state_id, place, early, unnest(mf) AS facet FROM s1) GROUP BY query_id, facet HAVING count(early) = 0),
    s2 AS (SELECT *, coalesce(early, CASE WHEN (query_id, state_id) IN (SELECT query_id, state_id FROM fresh) OR nth = 1 AND count(early) OVER (PARTITION BY query_id, family) = 0 THEN 5 ELSE 6 END) AS step FROM s1)"""


@register(f"""WITH {DIVERSIFIED} SELECT * FROM (SELECT query_id, state_id, row_number() OVER (PARTITION BY query_id ORDER BY step, CASE WHEN step BETWEEN 2 AND 4 THEN -weight END, CASE WHEN step BETWEEN 2 AND 4 THEN family END, place) AS pick FROM s2) WHERE pick <= 18""")
def diversified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection of eighteen for questions that need many facets, over every question's candidates."""
    return selection.diversified(candidates(spark, sf_dir), 18)


@register(f"WITH {SCORED} SELECT od.query_id, l.evidence_id, count(DISTINCT od.state_id) AS n_states FROM od JOIN links l USING (state_id) GROUP BY 1, 2")
def evidence_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = st.links_of(statements(spark, sf_dir))
    return candidates(spark, sf_dir).select("query_id", "state_id").join(links, "state_id").groupBy("query_id", "evidence_id").agg(F.count("state_id").alias("n_states"))


CHANNELS = ("keyword_match", "target_match", "medical_alias_match", "semantic_concept_match", "lexical_ngram_match", "scope_family_prior", "evidence_facet_match", "option_match")


@register(f"WITH {SCORED} SELECT query_id, " + ", ".join(f"count(*) FILTER (list_contains(reasons, '{n}')) AS {n}" for n in CHANNELS) + " FROM od GROUP BY query_id")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counts need no order of the candidates; a question without any gives no row.
    counts = scored(spark, sf_dir).groupBy("query_id").agg(F.count_if(F.size("reasons") > 0).alias("n"), *[F.count_if(F.array_contains("reasons", n)).alias(n) for n in CHANNELS])
    return counts.filter("n > 0").drop("n")


@register(f"""WITH {SCORED}, o AS (SELECT query_id, state_id, place, unnest(option_ids) AS option_id FROM od) SELECT query_id, option_id, count(*) AS n_qualified, string_agg(CAST(state_id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 12) AS selected FROM o GROUP BY 1, 2""")
def option_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per option of a question the candidates that match it, and those of them that are selected."""
    # A question without options has none to match.
    rows = candidates(spark, sf_dir, "size(options) > 0").select("query_id", "state_id", "place", F.explode("option_ids").alias("option_id"))
    chosen = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 12, F.struct("place", "state_id")))), lambda x: x["state_id"].cast("string"))
    return rows.groupBy("query_id", "option_id").agg(F.count("*").alias("n_qualified"), chosen.alias("s")).select("query_id", "option_id", "n_qualified", F.when(F.size("s") > 0, F.array_join("s", ",")).alias("selected"))


TERM_SQL = quoted(r"[a-z][a-z0-9.+-]{2,}|[0-9]+(?:\.[0-9]+)?(?:%|mg|kg|mmol/l)?|\p{IsHan}{2,8}")
BY_TASK = "CASE task " + " ".join(f"WHEN '{t}' THEN {list(f)}" for t, f in fx.REQUIRED_FACETS.items()) + " ELSE ['direct_facts'] END"
BY_QUESTION = f"CASE WHEN regexp_matches(question, '{fx.REASON_QUESTION}') THEN {list(fx.REASON_FACETS)} ELSE CAST([] AS VARCHAR[]) END"
REQUIRED = f"list_concat(facets, list_filter({BY_TASK}, lambda f: NOT list_contains(facets, f)), list_filter({BY_QUESTION}, lambda f: NOT list_contains(facets, f) AND NOT list_contains({BY_TASK}, f)))[1:{fx.MOST_FACETS}]"
SPECIAL = {"direct_facts": "len(hits) > 0 OR ht", "event_time": "true", "option_evidence": "no > 0", "current_status": f"status = 'active' OR {matches('hay', fx.FACET_PATTERNS['current_status'])}", "previous_state": "status <> 'active'"}
COVERED = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{f}' END" for f, t in {**{f: f"family IN ({', '.join(repr(x) for x in fam)})" + (f" AND {matches('hay', fx.FACET_PATTERNS[f])}" if f in fx.FACET_PATTERNS else "") for f, fam in fx.FACET_FAMILIES.items() if f not in SPECIAL}, **SPECIAL}.items()) + "], lambda x: x IS NOT NULL)"
INDEXED = f"""{LINKS}, ev AS (SELECT l.state_id, string_agg(e.text, ' ' ORDER BY l.place) AS words FROM links l JOIN evidence e USING (evidence_id) WHERE e.text <> '' GROUP BY 1), {QUESTIONS_SQL},
    raw AS (SELECT query_id, lower(concat_ws(' ', question, target, array_to_string(keywords, ' '), array_to_string(options, ' '))) AS low FROM qs),
    qt AS (SELECT query_id, list_distinct(list_filter(flatten([regexp_extract_all(low, {TERM_SQL}), list_transform({aliases_sql('low')}, lambda a: lower(a)), {', '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN {list(w)} ELSE CAST([] AS VARCHAR[]) END" for p, w in ranking.AREAS)}]), lambda t: length(t) > 1 AND NOT list_contains({list(ranking.QUERY_STOP_TERMS)}, t))) AS terms FROM raw),
    pr AS (SELECT st.state_id, st.family, st.status, st.seconds, lower(st.text) AS body, lower(concat_ws(' ', st.text, family, status, polarity, words)) AS hay, qs.* EXCLUDE (text), qt.terms FROM st LEFT JOIN ev USING (state_id) JOIN qs ON qs.query_id = st.subject_id JOIN qt USING (query_id)),
    ih AS (SELECT *, list_filter(terms, lambda t: contains(hay, t)) AS hits, contains(hay, lower(target)) AS ht, len(list_filter(scopes, lambda s: s[1:2] = family)) > 0 AS sh, len(list_filter(options, lambda o: len(list_filter(regexp_extract_all(lower(o), {TERM_SQL}), lambda t: contains(hay, t))) > 0)) AS no, {REQUIRED} AS required FROM pr),
    ix AS (SELECT *, list_filter(required, lambda f: list_contains(held, f)) AS gate_facets FROM (SELECT *, {COVERED} AS held FROM ih))"""


GATE_SCORE = "round(least(len(hits), 24) * 5 + CASE WHEN sh THEN 3 ELSE 0 END + no * 5 + len(gate_facets) * 1.25 + CASE WHEN ht THEN 6 ELSE 0 END + CASE WHEN operator IN ('current', 'latest') AND status = 'active' THEN 1 ELSE 0 END + CASE WHEN operator = 'history' AND family = 'BC' THEN 1 ELSE 0 END, 3)::DOUBLE"


@register(f"""WITH {INDEXED} SELECT query_id, state_id, round(least(len(hits), 24) * 5 + CASE WHEN sh THEN 3 ELSE 0 END + no * 5 + len(gate_facets) * 1.25 + CASE WHEN ht THEN 6 ELSE 0 END + CASE WHEN operator IN ('current', 'latest') AND status = 'active' THEN 1 ELSE 0 END + CASE WHEN operator = 'history' AND family = 'BC' THEN 1 ELSE 0 END, 3)::DOUBLE AS gate_score,
    least(len(hits), 24) AS lexical_hits, array_to_string(list_sort(gate_facets), ',') AS gate_facets FROM ix""")
def index_gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of a subject against the question about it, by the evidence index."""
    return indexed(spark, sf_dir).select("query_id", "state_id", "gate_score", F.col("lexical_hits").cast("long").alias("lexical_hits"), F.array_join(F.array_sort("gate_facets"), ",").alias("gate_facets"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    pairs = searchable(rows).select("subject_id", "state_id", "family", "status", "polarity", "seconds", "text", "searchable").join(ranking.with_terms(questions(rows)).withColumnRenamed("query_id", "subject_id"), "subject_id").withColumnRenamed("subject_id", "query_id")
    return ranking.index_score(pairs)


@register(f"""WITH {INDEXED}, cv AS (SELECT query_id, list_distinct(flatten(list(gate_facets))) AS covered, any_value(required) AS required FROM ix WHERE len(hits) > 0 OR no > 0 GROUP BY 1)
    SELECT query_id, len(list_intersect(covered, required)) AS n_covered, len(required) AS n_required, round(len(list_intersect(covered, required))::DOUBLE / len(required), 6) AS ratio, array_to_string(list_sort(list_filter(required, lambda f: NOT list_contains(covered, f))), ',') AS missing FROM cv""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question the facets that its matching statements cover, and those that none does."""
    rows = indexed(spark, sf_dir).filter((F.col("lexical_hits") > 0) | (F.col("option_hits") > 0))
    each = rows.select("query_id", "required", F.explode_outer("gate_facets").alias("facet")).groupBy("query_id").agg(F.collect_set("facet").alias("covered"), F.first("required").alias("required"))
    both = F.array_intersect("covered", "required")
    return each.select("query_id", F.size(both).cast("long").alias("n_covered"), F.size("required").cast("long").alias("n_required"), F.round(F.size(both) / F.size("required"), 6).alias("ratio"), F.array_join(F.array_sort(F.array_except("required", "covered")), ",").alias("missing"))
