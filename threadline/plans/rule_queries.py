"""Registered queries of the text rules over statements, turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.functions.text import nfkc_lower
from threadline.plans.base import STATEMENTS, matches, named, quoted, register, statements, table

FOLLOWED = "(PARTITION BY subject_id, family ORDER BY state_id)"


def with_prior(rows: DataFrame) -> DataFrame:
    """Each statement with the one before it of its subject and family."""
    w = W.partitionBy("subject_id", "family").orderBy("state_id")
    return rows.select("*", F.lag("state_id").over(w).alias("prior_id"), F.lag("text").over(w).alias("prior_text"), F.lag("polarity").over(w).alias("prior_polarity"), F.lag("source_type").over(w).alias("prior_source"))


PRIOR = f"{STATEMENTS}, pr AS (SELECT *, lag(state_id) OVER {FOLLOWED} AS prior_id, lag(text) OVER {FOLLOWED} AS prior_text, lag(polarity) OVER {FOLLOWED} AS prior_polarity, lag(source_type) OVER {FOLLOWED} AS prior_source FROM st)"

DRUGS_SQL = f"list_transform({named('text', fx.MEDICATIONS)}, lambda x: 'medication:' || x)"
KIND_SQL = "CASE " + " ".join(f"WHEN {matches('text', p)} THEN '{n}'" for n, p in fx.GLUCOSE_KINDS.items()) + " ELSE 'general' END"


def topic_key_sql(column: str = "text") -> str:
    inner = f"""(SELECT CASE WHEN len(drugs) > 0 THEN array_to_string(drugs, ',') WHEN len(general) > 0 THEN array_to_string(list_transform(general, lambda t: CASE WHEN t = 'glucose' THEN 'glucose:' || kind ELSE t END), ',')
        ELSE regexp_replace(lower(text), {quoted(fx.TOPIC_NOISE)}, '', 'g') END FROM (SELECT text, drugs, kind, list_filter(general, lambda t: t <> 'medication' OR len(drugs) = 0) AS general FROM (SELECT text, {DRUGS_SQL} AS drugs, {named('text', fx.TOPICS)} AS general, {KIND_SQL} AS kind FROM (SELECT {column} AS text))))"""
    return inner


@register(f"WITH {STATEMENTS} SELECT state_id, {topic_key_sql('st.text')} AS topic_key, array_to_string(list_concat({DRUGS_SQL}, list_filter({named('text', fx.TOPICS)}, lambda t: t <> 'medication' OR len({named('text', fx.MEDICATIONS)}) = 0)), ',') AS topics FROM st")
def topic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", rules.topic_key(F.col("text")).alias("topic_key"), F.array_join(rules.topics(F.col("text")), ",").alias("topics"))


def assertion_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({c}), {quoted(fx.ASSERTION_WORDS)}, '', 'g'), {quoted(fx.ASSERTION_ENGLISH)}, '', 'g'), '[\\s\\p{{P}}\\p{{S}}]', '', 'g')"


def quantity_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), {quoted(fx.QUANTITY)}), lambda x: regexp_replace(x, '\\s+', '', 'g')), '|')"


def status_sql(c: str) -> str:
    return f"array_to_string({named(f'lower({c})', fx.STATUSES)}, '|')"


@register(f"WITH {STATEMENTS} SELECT state_id, {assertion_sql('text')} AS assertion, {quantity_sql('text')} AS quantities, {status_sql('text')} AS statuses FROM st")
def fact_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", rules.assertion(F.col("text")).alias("assertion"), rules.quantity_signature(F.col("text")).alias("quantities"), rules.status_signature(F.col("text")).alias("statuses"))


SAME_SQL = " AND ".join(["polarity = prior_polarity", *[f"{f('text')} = {f('prior_text')}" for f in (assertion_sql, quantity_sql, status_sql)]])
RESOLVES_SQL = f"prior_polarity <> 'negated' AND (polarity = 'negated' OR {matches('text', fx.RESOLVED)})"
OPPOSITE_SQL = f"{matches('text', fx.OPPOSITE)} <> {matches('prior_text', fx.OPPOSITE)}"


@register(f"""WITH {PRIOR} SELECT state_id, prior_id, {matches('text', fx.CORRECTION)} AS correction, {matches('text', fx.RECONCILIATION)} AS reconciled, {OPPOSITE_SQL} AS opposite, {RESOLVES_SQL} AS resolves, {SAME_SQL} AS equivalent FROM pr WHERE prior_id IS NOT NULL""")
def fact_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_prior(statements(spark, sf_dir)).filter("prior_id is not null")
    prior = F.col("prior_text")
    return pairs.select(
        "state_id", "prior_id", rules.is_correction(F.col("text")).alias("correction"), rules.is_reconciliation(F.col("text")).alias("reconciled"), rules.are_opposite(F.col("text"), prior).alias("opposite"),
        rules.resolves(F.col("prior_polarity"), F.col("polarity"), F.col("text")).alias("resolves"), rules.same_fact(F.col("text"), F.col("polarity"), prior, F.col("prior_polarity")).alias("equivalent"),
    )


D = {n: matches("text", p) for n, p in fx.DOMAINS.items()}
DOMAINS_SQL = f"list_filter([CASE WHEN family IN ('CS', 'LO') OR {D['biological']} THEN 'biological' END, CASE WHEN family = 'PA' OR {D['psychological']} THEN 'psychological' END, CASE WHEN {D['behavioral']} THEN 'behavioral' END, CASE WHEN {D['social']} THEN 'social' END, CASE WHEN family = 'CP' THEN 'care' END], lambda x: x IS NOT NULL)"


@register(f"WITH {STATEMENTS}, d AS (SELECT state_id, family, {DOMAINS_SQL} AS found FROM st) SELECT state_id, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') WHEN family = 'BC' THEN 'social' ELSE 'biological' END AS domains FROM d")
def factor_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", F.array_join(rules.domains(F.col("family"), F.col("text")), ",").alias("domains"))


ASSERTED_SQL = ", ".join(f"CASE WHEN {matches('text', p)} THEN CAST({c} AS DOUBLE) END AS {n}_confidence" for n, (p, c) in fx.ASSERTED.items())


@register(f"WITH {STATEMENTS} SELECT state_id, {ASSERTED_SQL}, array_to_string({named('lower(text)', fx.CUES)}, ',') AS cues FROM st")
def relation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidences = [rules.asserted(F.lit(n), F.col("text")).alias(f"{n}_confidence") for n in fx.ASSERTED]
    return statements(spark, sf_dir).select("state_id", *confidences, F.array_join(rules.cues(F.col("text")), ",").alias("cues"))


FIVE = dict(list(fx.MEDICATIONS.items())[:5])


def protected_sql(c: str) -> str:
    return "concat_ws('#', " + ", ".join(f"array_to_string(regexp_extract_all(lower({c}), {quoted(p)}), ',')" for p in fx.PROTECTED.values()) + f", array_to_string(list_sort({named(f'lower({c})', FIVE)}), ','))"


@register(f"WITH {PRIOR} SELECT state_id, {protected_sql('text')} AS signature, prior_text IS NOT NULL AND {protected_sql('text')} = {protected_sql('prior_text')} AS same_as_prior FROM pr")
def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a quotation may not change, and whether the statement before agrees in all of it."""
    rows = with_prior(statements(spark, sf_dir))
    return rows.select("state_id", rules.protected_signature(F.col("text")).alias("signature"), (F.col("prior_text").isNotNull() & (rules.protected_signature(F.col("text")) == F.coalesce(rules.protected_signature(F.col("prior_text")), F.lit("")))).alias("same_as_prior"))


PLAIN_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', ' ', 'g'), {quoted(fx.ARTICLES)}, ' ', 'g'), '\\s+', ' ', 'g'))"
_MARKS = "".join("\\" + c if c.isascii() else c for c in dict.fromkeys(fx.OFFICIAL_MARKS)).replace("'", "''")


@register(f"""SELECT conv_id, turn, md5({PLAIN_SQL}) AS plain, md5(regexp_replace(lower(nfkc), '[{_MARKS}\\s]', '', 'g')) AS official, md5(regexp_replace(lower(nfkc), {quoted(fx.CLAIM_MARKS)}, '', 'g')) AS claim,
    {PLAIN_SQL} IN ({', '.join(f"'{p}'" for p in fx.ABSTENTIONS)}) AS abstains FROM (SELECT conv_id, turn, text, text AS nfkc FROM conversations)""")
def answer_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in the normal forms of answers; hashes stand for the texts. The table's texts are in NFKC already."""
    digest = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest(rules.plain_answer(F.col("text"))).alias("plain"), digest(rules.official_answer(F.col("text"))).alias("official"), digest(rules.claim(F.col("text"))).alias("claim"), rules.abstains(F.col("text")).alias("abstains"))


@register(f"""WITH {STATEMENTS}, t AS (SELECT state_id, lower(text) AS low FROM st), h AS (SELECT state_id, list_concat(regexp_extract_all(low, '[a-z][a-z0-9.+-]{{1,}}'), flatten(list_transform(regexp_extract_all(low, '\\p{{Han}}+'), lambda b: list_transform(range(1, length(b)), lambda i: b[i:i+1])))) AS tokens FROM t)
    SELECT state_id, len(list_distinct(tokens)) AS n_tokens, array_to_string(list_sort(list_distinct(tokens)), ' ') AS tokens FROM h""")
def diagnostic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = rules.diagnostic_tokens(F.col("text"))
    return statements(spark, sf_dir).select("state_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def language_sql(c: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({c}, '\\p{{Han}}')) > len(regexp_extract_all({c}, '[A-Za-z]')) * 0.3 THEN 'zh' ELSE 'en' END"


@register(f"""WITH {PRIOR} SELECT state_id, {language_sql('text')} AS language, coalesce(trim(text) <> '' AND {language_sql('prior_text')} <> {language_sql('text')}
    AND CASE WHEN {language_sql('prior_text')} = 'zh' THEN len(regexp_extract_all(text, '[A-Za-z]')) > 8 ELSE len(regexp_extract_all(text, '\\p{{Han}}')) > 2 END AND prior_text IS NOT NULL, false) AS mismatch FROM pr""")
def language_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's language, and whether it is another than that of the statement before it."""
    rows = with_prior(statements(spark, sf_dir))
    return rows.select("state_id", rules.language(F.col("text")).alias("language"), F.coalesce(rules.language_mismatch(F.col("prior_text"), F.col("text")) & F.col("prior_text").isNotNull(), F.lit(False)).alias("mismatch"))


def brands_sql(c: str) -> str:
    for brand, drug in fx.BRANDS:
        c = f"regexp_replace({c}, '(?i){brand}', '{drug}', 'g')"
    return f"trim({c})"


def canonical_sql(c: str) -> str:
    for name, drug in fx.CANONICAL_DRUGS:
        c = f"regexp_replace({c}, '(?i)\\b{name}\\b', '{drug}', 'g')"
    return f"trim({c})"


@register(f"""WITH {STATEMENTS}, b AS (SELECT state_id, source_type, text AS raw, {brands_sql('text')} AS t FROM st), l AS (SELECT *, {language_sql('t')} AS lang FROM b),
    s AS (SELECT *, CASE WHEN lang = 'zh' THEN CASE WHEN source_type = 'doctor' THEN '医生' ELSE '患者' END ELSE CASE WHEN source_type = 'doctor' THEN 'Doctor' ELSE 'Patient' END END AS subject FROM l)
    SELECT state_id, CASE WHEN regexp_matches(t, '(?i)^(患者|医生|记录|Profile|Patient|Doctor)[:：]') THEN regexp_replace(t, '(?i)^(Profile|Patient|Doctor)[:：]\\s*', '')
        WHEN lang = 'zh' AND regexp_matches(t, '^(我|本人)') THEN subject || regexp_replace(t, '^(我|本人)', '') WHEN lang = 'zh' AND regexp_matches(t, '^(患者|医生)') THEN t WHEN lang = 'zh' THEN subject || t
        WHEN regexp_matches(t, '(?i)^I\\b') THEN subject || substr(t, 2) WHEN regexp_matches(t, '(?i)^(Patient|Doctor)\\b') THEN t ELSE subject || ' ' || t END AS atomic, {canonical_sql('raw')} AS canonical FROM s""")
def atomic_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", rules.atomic(F.col("text"), F.col("source_type")).alias("atomic"), rules.canonical_drugs(F.col("text")).alias("canonical"))


VALUE_SQL = "trim(regexp_replace(text, '[*_~`>#•·]', '', 'g'))"


@register(f"""WITH {STATEMENTS} SELECT state_id, {matches(VALUE_SQL, fx.GREETING)} OR (source_type = 'doctor' OR {matches(VALUE_SQL, '(?i)^(?:医生|Doctor)')}) AND {matches(VALUE_SQL, fx.SUPPORTIVE)} AND NOT {matches(VALUE_SQL, fx.DURABLE)} AS filler FROM st""")
def filler_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", rules.is_filler(F.col("text"), F.col("source_type")).alias("filler"))


KINDS_SQL = f"list_filter({named('text', fx.CLAIM_KINDS)}, lambda k: k <> 'started' OR NOT list_contains({named('text', fx.CLAIM_KINDS)}, 'restarted'))"


@register(f"""WITH {STATEMENTS} SELECT state_id, array_to_string({named('text', fx.UNCONFIRMED)}, ',') AS guards, array_to_string({KINDS_SQL}, ',') AS kinds,
    len({named('text', fx.MEDICATIONS)}) <> 1 OR {matches('text', fx.CLAIM_CORRECTION)} OR len({KINDS_SQL}) > 1 AS unsafe FROM st""")
def medication_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements say about drugs: why they confirm nothing, the kinds of action, whether a claim is unsafe."""
    return statements(spark, sf_dir).select("state_id", F.array_join(rules.claim_guards(F.col("text")), ",").alias("guards"), F.array_join(rules.claim_kinds(F.col("text")), ",").alias("kinds"), rules.unsafe_claim(F.col("text")).alias("unsafe"))


def aliases_sql(c: str) -> str:
    groups = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({c}), '{t.lower()}')" for t in g) + " THEN [" + ", ".join(f"'{t}'" for t in g) + "] ELSE CAST([] AS VARCHAR[]) END" for g in fx.ALIASES)
    return f"list_sort(list_distinct(flatten([{groups}])))"


@register(f"WITH {STATEMENTS} SELECT state_id, array_to_string({aliases_sql('text')}, ',') AS aliases FROM st")
def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("state_id", F.array_join(F.array_sort(rules.aliases(F.col("text"))), ",").alias("aliases"))


QUESTION = "concat('Which holds?', chr(10), 'A. ', text, chr(10), 'B) none', chr(10), 'C、', family)"


@register(f"""WITH {STATEMENTS}, q AS (SELECT state_id, {QUESTION} AS question FROM st), o AS (SELECT state_id, regexp_extract_all(question, '(?:^|\\n)\\s*([A-Z])[.、)]\\s*([^\\n]+)', 1) AS ids, regexp_extract_all(question, '(?:^|\\n)\\s*([A-Z])[.、)]\\s*([^\\n]+)', 2) AS texts FROM q)
    SELECT state_id, len(ids) AS n_options, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] || '=' || trim(texts[i])), '|') AS options FROM o""")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.parsed_options(F.expr(QUESTION.replace("chr(10)", "char(10)")))
    return statements(spark, sf_dir).select("state_id", found.alias("o")).select("state_id", F.size("o").cast("long").alias("n_options"), F.array_join(F.transform("o", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"))


@register("WITH t AS (SELECT conv_id, turn, upper(text) AS u FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(u, {quoted(p)}, 1)" for p in fx.OPTION_PATTERNS) + "]))), ',') AS letters FROM t")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(rules.option_letters(F.col("text")), ",").alias("letters"))


SCOPES_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {w} > 0 THEN '{f}=' || CAST({w} AS VARCHAR) END"
    for f in fx.FAMILIES
    for w in ["greatest(0, " + ", ".join([f"CASE WHEN {matches('lower(text)', p)} THEN {fx.PRIORITY_WEIGHT[priority]} ELSE 0 END" for p, scopes, _ in fx.QUESTION_RULES for family, priority in scopes if family == f] + (["CASE WHEN task = 'state_update' THEN 3 ELSE 0 END"] if f == "LO" else [])) + ")"]
) + "], lambda x: x IS NOT NULL)"
NONE_SQL = "CAST([] AS VARCHAR[])"
FACETS_SQL = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN {matches('lower(text)', p)} THEN {list(facets)} ELSE {NONE_SQL} END" for p, _, facets in fx.QUESTION_RULES) + f", CASE WHEN task = 'state_update' THEN ['current_status', 'longitudinal_change'] WHEN task IN {fx.COMPLEX_TASKS} THEN ['direct_facts', 'clinical_context', 'longitudinal_change'] ELSE {NONE_SQL} END])))"
OPERATOR_SQL = "CASE " + " ".join("WHEN " + matches("lower(text)", p) + ({"current": " OR task = 'state_update'", "event_time": " OR task = 'temporal_localization'"}.get(n, "")) + f" THEN '{n}'" for n, p in fx.TEMPORAL_RULES) + " ELSE 'none' END"
SLOT_SQL = "CASE " + " ".join(f"WHEN task = '{t}' THEN '{s}'" for t, s in fx.SLOT_OF_TASK.items()) + " " + " ".join(f"WHEN {matches('lower(text)', p)} THEN '{n}'" for n, p in fx.SLOT_RULES) + " WHEN task = 'entity_exact_match' THEN 'entity' ELSE 'fact' END"


@register(f"WITH {STATEMENTS} SELECT state_id, array_to_string({SCOPES_SQL}, ',') AS scopes, array_to_string({FACETS_SQL}, ',') AS facets, {OPERATOR_SQL} AS temporal_operator, {SLOT_SQL} AS answer_slot FROM st")
def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements read as questions: families and facets they ask about, the view in time, the slot of the answer."""
    task = F.col("task")
    return statements(spark, sf_dir).select("state_id", F.array_join(rules.question_scopes(F.col("text"), task), ",").alias("scopes"), F.array_join(F.array_sort(rules.question_facets(F.col("text"), task)), ",").alias("facets"), rules.temporal_operator(F.col("text"), task).alias("temporal_operator"), rules.answer_slot(F.col("text"), task).alias("answer_slot"))


ROUTE_SQL = f"CASE WHEN task IN {fx.COMPLEX_TASKS} THEN 'focus,trace,connect,evaluate,verify,answer' WHEN task IN {fx.TEMPORAL_TASKS} OR ({OPERATOR_SQL}) <> 'none' THEN 'focus,trace,verify,answer' ELSE 'focus,verify,answer' END"


@register(f"""WITH {STATEMENTS}, r AS (SELECT state_id, task, {ROUTE_SQL} AS route FROM st)
    SELECT state_id, route, CASE WHEN route = 'focus,trace,connect,evaluate,verify,answer' THEN 'focus,trace,verify,answer' ELSE route END AS short_route, CASE task {' '.join(f"WHEN '{t}' THEN {n}" for t, n in fx.CANDIDATE_LIMITS.items())} ELSE 12 END AS candidate_limit FROM r""")
def action_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each task, whole and under a budget of four, and how many candidates it may keep."""
    rows = statements(spark, sf_dir)
    task, operator = F.col("task"), rules.temporal_operator(F.col("text"), F.col("task"))
    return rows.select("state_id", F.array_join(rules.desired_actions(task, operator), ",").alias("route"), F.array_join(rules.desired_actions(task, operator, 4), ",").alias("short_route"), rules.candidate_limit(task, F.lit(0)).alias("candidate_limit"))


HELD_SQL = "list_filter([" + ", ".join(f"CASE WHEN family IN ({', '.join(repr(f) for f in fam)})" + (f" AND {matches('lower(text)', fx.FACET_PATTERNS[n])}" if n in fx.FACET_PATTERNS else "") + f" THEN '{n}' END" for n, fam in fx.FACET_FAMILIES.items()) + "], lambda x: x IS NOT NULL)"


@register(f"WITH {STATEMENTS} SELECT state_id, array_to_string({HELD_SQL}, ',') AS facets FROM st")
def state_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets that each statement can cover, by its family and words."""
    return statements(spark, sf_dir).select("state_id", F.array_join(rules.facets_of(F.col("family"), nfkc_lower(F.col("text"))), ",").alias("facets"))


REQUIRED_SQL = "CASE task " + " ".join(f"WHEN '{t}' THEN {list(f)}" for t, f in fx.REQUIRED_FACETS.items()) + " ELSE ['direct_facts'] END"


@register(f"""WITH {STATEMENTS}, h AS (SELECT subject_id, task, list_distinct(flatten(list({HELD_SQL}))) AS held FROM st GROUP BY subject_id, task), r AS (SELECT subject_id, task, held, {REQUIRED_SQL} AS required FROM h)
    SELECT subject_id, task, len(list_intersect(required, held)) AS n_covered, array_to_string(list_filter(required, lambda x: NOT list_contains(held, x)), ',') AS missing, len(list_intersect(required, held)) = len(required) AS complete FROM r""")
def facet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per subject and task the required facets that no statement covers, from distinct facets of each."""
    rows = statements(spark, sf_dir).select("subject_id", "task", F.explode_outer(rules.facets_of(F.col("family"), nfkc_lower(F.col("text")))).alias("facet"))
    held = rows.groupBy("subject_id", "task").agg(F.collect_set("facet").alias("held")).withColumn("required", rules.required_facets(F.col("task")))
    missing = F.array_except("required", "held")
    return held.select("subject_id", "task", F.size(F.array_intersect("required", "held")).cast("long").alias("n_covered"), F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


IS = {n: matches("text", p) for n, p in fx.ROUTES.items()}
PATIENT = f"(source_type = 'patient' OR {IS['subject']})"
AGREES = f"({PATIENT} AND {IS['agreement']})"
ROUTED = f"""CASE WHEN {IS['question']} THEN CASE WHEN {PATIENT} AND {IS['confirming']} THEN ['PA'] ELSE {NONE_SQL} END ELSE list_filter([CASE WHEN {IS['background']} THEN 'BC' END, CASE WHEN ({PATIENT} OR {IS['observed']} OR {IS['reported']}) AND {IS['experience']} AND NOT ({IS['intent']} AND NOT {AGREES}) THEN 'PE' END,
    CASE WHEN {PATIENT} AND {IS['appraisal']} THEN 'PA' END, CASE WHEN {IS['judgment']} OR {IS['taking']} OR NOT {IS['directive']} AND {IS['stopped']} THEN 'CS' END, CASE WHEN {IS['care']} OR {AGREES} THEN 'CP' END, CASE WHEN {IS['change']} THEN 'LO' END], lambda x: x IS NOT NULL) END"""


@register(f"WITH {STATEMENTS} SELECT state_id, array_to_string({ROUTED}, ',') AS families FROM st")
def routed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of each statement by the rules of words, source and form."""
    return statements(spark, sf_dir).select("state_id", F.array_join(rules.routed_families(F.col("text"), F.col("source_type")), ",").alias("families"))


WORD = r"[a-z][a-z0-9-]{2,}|\p{IsHan}+|[0-9]+(?:[-–—~～][0-9]+)?(?:斤|公斤|kg|mg|%|mmol/l)?"
NUMBER = r"[0-9]+(?:[-–—~～][0-9]+)?(?:斤|公斤|kg|mg|%|mmol/l)?"
#: Phrases of each statement asked as a question with options, in their order, and which of them are keywords.
PHRASES_SQL = f"""q AS (SELECT state_id, {QUESTION} AS question FROM st), b AS (SELECT *, lower(regexp_replace(question, '(?:^|\\n)\\s*[A-Z][.、)]\\s*[^\\n]+', ' ', 'g')) AS base FROM q), w AS (SELECT *, regexp_extract_all(base, {quoted(WORD)}) AS words FROM b),
    r AS (SELECT *, flatten(list_transform(range(1, len(words) + 1), lambda i: list_transform(range(1, least(4, len(words) - i + 1) + 1), lambda n: words[i:i+n-1]))) AS runs FROM w),
    p AS (SELECT state_id, list_concat(list_concat(regexp_extract_all(base, {quoted(NUMBER)}), list_transform(regexp_extract_all(question, '(?:^|\\n)\\s*([A-Z])[.、)]\\s*([^\\n]+)', 2), lambda o: trim(o))), list_filter(list_transform(list_filter(runs, lambda x: NOT list_has_any(x, {list(fx.FRAMING)}) AND (len(x) > 1 OR NOT list_contains({list(fx.STOP_TERMS)}, x[1]))), lambda x: array_to_string(x, '')), lambda x: length(x) <= 20)) AS phrases FROM r)"""
KEPT_SQL = f"list_filter(phrases, lambda x: length(x) BETWEEN 2 AND 40 AND NOT list_contains({list(fx.STOP_TERMS)}, lower(x)))"


@register(f"""WITH {STATEMENTS}, {PHRASES_SQL}
    SELECT state_id, array_to_string(list_sort(list_distinct({KEPT_SQL})), '|') AS keywords FROM p""")
def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of statements asked as questions with options."""
    question = F.expr(QUESTION.replace("chr(10)", "char(10)"))
    return statements(spark, sf_dir).select("state_id", F.array_join(F.array_sort(rules.keyword_phrases(question)), "|").alias("keywords"))
