"""Registered queries on what a question may use and how it ended: heads, lost relations, visibility, routing, error cases, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import answers as an
from threadline.operators import selection
from threadline.operators import states as st
from threadline.operators.tables import numbered
from threadline.plans.answer_queries import ANSWERS_SQL, SCORED, WRONG, scores
from threadline.plans.base import STATEMENTS, matches, register, statements
from threadline.plans.ranking_queries import GATE_SCORE, INDEXED, indexed
from threadline.plans.rule_queries import FOLLOWED
from threadline.plans.state_queries import BOUND, FACTORED, PAIRS, REACH, REASON, RELATION, evidence_of, pairs_of, verified


@register(f"WITH RECURSIVE {STATEMENTS}, lin AS (SELECT * FROM (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS other_id FROM st) WHERE other_id IS NOT NULL AND state_id % 5 <> 0), {FACTORED}, {REACH.format(v='s2')} SELECT group_id, head_id, count(*) AS n_states FROM grp JOIN hd USING (group_id) WHERE head_status = 'active' GROUP BY 1, 2")
def display_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest states of groups that lineage, equal factors and temporal edges tie together, those of a valid status only."""
    from threadline.functions import rules

    rows = statements(spark, sf_dir)
    prior = F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id"))
    ties = rows.select("state_id", prior.alias("other_id")).filter("other_id is not null and state_id % 5 <> 0")
    groups = st.lineage_groups(rows.withColumn("factor_key", rules.topic_key(F.col("text"))), ties, ["subject_id", "family", "factor_key"])
    return st.current_states(rows, groups).filter("head_status = 'active'").groupBy("group_id", "head_id").agg(F.count("*").alias("n_states"))


VERIFIED = f"""{BOUND}, {FACTORED}, vis AS (SELECT s2.* FROM s2 JOIN bound USING (state_id) WHERE n_declared = n_resolved), lin AS (SELECT state_id, prior AS other_id FROM (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS prior FROM vis) WHERE prior IS NOT NULL AND state_id % 3 = 0), {REACH.format(v='vis')},
    ver AS (SELECT st.state_id, st.subject_id, {REASON} AS reason FROM st LEFT JOIN bound USING (state_id) LEFT JOIN grp USING (state_id) LEFT JOIN hd USING (group_id))"""


@register(f"""WITH RECURSIVE {VERIFIED}, {PAIRS}, rel AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RELATION.items())} FROM pairs WHERE from_id IS NOT NULL), rl AS (SELECT edge_id, e1 AS evidence_id FROM rel UNION SELECT edge_id, e2 FROM rel),
    proof AS (SELECT edge_id, count(*) FILTER (e.evidence_id IS NULL) AS n_missing, min(e.subject_id) AS low, max(e.subject_id) AS high FROM rl LEFT JOIN evidence e USING (evidence_id) GROUP BY 1),
    s AS (SELECT edge_id, from_id, to_id, verified AND rel.status = 'verified' AS checked, coalesce(verified AND rel.status = 'verified' AND NOT causal AND a.subject_id = b.subject_id AND n_missing = 0 AND low = a.subject_id AND high = a.subject_id, false) AS supported FROM rel LEFT JOIN st a ON a.state_id = from_id LEFT JOIN st b ON b.state_id = to_id LEFT JOIN proof USING (edge_id)),
    f AS (SELECT s.*, x.reason AS from_reason, y.reason AS to_reason, x.state_id IS NOT NULL AND x.reason IS NULL AND y.reason IS NULL AS whole FROM s LEFT JOIN ver x ON x.state_id = from_id LEFT JOIN ver y ON y.state_id = to_id)
    SELECT edge_id, CASE WHEN supported AND whole THEN 'verified' WHEN NOT checked THEN 'edge_not_verified' WHEN supported AND coalesce(from_reason, 'superseded_for_current_view') = 'superseded_for_current_view' AND coalesce(to_reason, 'superseded_for_current_view') = 'superseded_for_current_view' THEN 'edge_endpoint_superseded_for_current_view' ELSE 'edge_endpoint_or_evidence_missing' END AS outcome FROM f""")
def relation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each relation: verified, never checked, lost with a superseded end (which blocks nothing), or missing something."""
    rows = statements(spark, sf_dir)
    rel = pairs_of(rows).selectExpr(*[f"{e} AS {n}" for n, e in RELATION.items()])
    proof = rel.select("edge_id", F.explode(F.array_distinct(F.array("e1", "e2"))).alias("evidence_id"))
    supported = st.supported_relations(rel.drop("e1", "e2"), rows, proof, evidence_of(rows))
    ver = verified(rows)
    end = lambda n: ver.select(F.col("state_id").alias(f"{n}_id"), F.col("reason").alias(f"{n}_reason"), F.lit(True).alias(f"{n}_there"))
    full = rel.join(supported, "edge_id").join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    stale = lambda n: F.coalesce(F.col(f"{n}_reason"), F.lit("superseded_for_current_view")) == "superseded_for_current_view"
    whole = F.col("from_there").isNotNull() & F.col("from_reason").isNull() & F.col("to_reason").isNull()
    outcome = F.when(F.col("supported") & whole, "verified").when(~(F.col("verified") & (F.col("status") == "verified")), "edge_not_verified").when(F.col("supported") & stale("from") & stale("to"), "edge_endpoint_superseded_for_current_view").otherwise("edge_endpoint_or_evidence_missing")
    return full.select("edge_id", outcome.alias("outcome"))


@register(f"""WITH {STATEMENTS}, p AS (SELECT subject_id, state_id, session_no, state_id % 6 = 5 AS noise, row_number() OVER (PARTITION BY subject_id ORDER BY seconds, state_id) AS pos FROM st), c AS (SELECT subject_id, max(pos) FILTER (NOT noise AND session_no <= 12) AS cutoff FROM p GROUP BY 1)
    SELECT subject_id, cutoff, count(*) FILTER (pos <= cutoff) AS n_visible, count(*) FILTER (pos <= cutoff AND noise) AS n_noise, count(*) FILTER (cutoff IS NULL OR pos > cutoff) AS n_hidden FROM p JOIN c USING (subject_id) GROUP BY 1, 2""")
def query_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of session 12 sees all positions up to the last regular one of that session, noise before it included."""
    rows = numbered(statements(spark, sf_dir).select("subject_id", "state_id", "session_no", "seconds"), ["subject_id"], [F.asc("seconds"), F.asc("state_id")], "pos").withColumn("noise", F.col("state_id") % 6 == 5)
    cut = rows.groupBy("subject_id").agg(F.max(F.when(~F.col("noise") & (F.col("session_no") <= 12), F.col("pos"))).alias("cutoff"))
    seen = F.coalesce(F.col("pos") <= F.col("cutoff"), F.lit(False))
    return rows.join(cut, "subject_id").groupBy("subject_id", "cutoff").agg(F.count_if(seen).alias("n_visible"), F.count_if(seen & F.col("noise")).alias("n_noise"), F.count_if(~seen).alias("n_hidden"))


RISK = r"(?i)自伤|自杀|轻生|具体计划|可用手段|self[- ]?harm|suicid"
UNSURE = r"(?i)不确定|不清楚|maybe|might|\bmay\b"


@register(f"""WITH {STATEMENTS}, c AS (SELECT subject_id, bool_or(status = 'conflict') AS in_conflict, count(DISTINCT evidence_id) AS n_evidence FROM st GROUP BY 1) SELECT state_id, CASE WHEN {matches('text', RISK)} THEN 'ESCALATE' WHEN in_conflict AND state_id % 2 = 0 THEN 'VERIFY' WHEN {matches('text', UNSURE)} THEN 'ASK' ELSE 'ANSWER' END AS action, n_evidence FROM st JOIN c USING (subject_id)""")
def action_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each message: escalate a risk, verify a conflict in the record (for every other message), ask where it is unsure."""
    from threadline.functions import rules

    rows = statements(spark, sf_dir)
    flags = rows.groupBy("subject_id").agg(F.bool_or(F.col("status") == "conflict").alias("in_conflict"), F.countDistinct("evidence_id").alias("n_evidence"))
    text = F.col("text")
    action = F.when(rules.has(text, RISK), "ESCALATE").when(F.col("in_conflict") & (F.col("state_id") % 2 == 0), "VERIFY").when(rules.has(text, UNSURE), "ASK").otherwise("ANSWER")
    return rows.join(flags, "subject_id").select("state_id", action.alias("action"), "n_evidence")


@register(f"""WITH {STATEMENTS} SELECT subject_id, state_id, row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN state_id % 9 <> 0 THEN seconds END NULLS LAST, state_id) AS place FROM st""")
def chronological_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in the order of time; those without one (here every ninth) last, in the order in which they came."""
    rows = statements(spark, sf_dir).select("subject_id", "state_id", F.when(F.col("state_id") % 9 != 0, F.col("seconds")).alias("at"))
    return numbered(rows, ["subject_id"], [F.asc_nulls_last("at"), F.asc("state_id")], "place").select("subject_id", "state_id", "place")


@register(f"""WITH {SCORED}, h AS (SELECT answer_id % 2 AS half, avg(score) AS s, avg(CASE WHEN is_correct THEN 1.0 WHEN NOT is_correct THEN 0.0 END) AS a, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) AS f, avg(CASE WHEN judge_failed THEN 1.0 ELSE 0.0 END) AS j, avg(latency) AS l FROM sr GROUP BY 1),
    p AS (SELECT b.s - a.s AS s, b.a - a.a AS a, b.f - a.f AS f, b.j - a.j AS j, b.l - a.l AS l FROM h a, h b WHERE a.half = 0 AND b.half = 1)
    SELECT round(s, 6) AS score_gain, round(a, 6) AS accuracy_gain, round(f, 6) AS failure_gain, round(j, 6) AS judge_failure_gain, round(l, 6) AS latency_gain, array_to_string(list_filter([CASE WHEN s < 0 THEN 'score' END, CASE WHEN a < 0 THEN 'accuracy' END, CASE WHEN f > 0 THEN 'failures' END, CASE WHEN j > 0 THEN 'judge_failures' END, CASE WHEN l > 5 THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS failed,
        s >= 0 AND a >= 0 AND f <= 0 AND j <= 0 AND l <= 5 AS accepted FROM p""")
def patch_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five measures of the odd answers against those of the even ones; a change is accepted if none is worse."""
    half = lambda n, c: F.avg(F.when(F.col("answer_id") % 2 == n, c))
    measures = {"s": F.col("score"), "a": F.col("is_correct").cast("int"), "f": (F.col("status") == "failed").cast("int"), "j": F.coalesce(F.col("judge_failed"), F.lit(False)).cast("int"), "l": F.col("latency")}
    m = scores(spark, sf_dir).agg(*[(half(1, c) - half(0, c)).alias(n) for n, c in measures.items()])
    c = F.col
    failed = F.concat_ws(",", F.when(c("s") < 0, "score"), F.when(c("a") < 0, "accuracy"), F.when(c("f") > 0, "failures"), F.when(c("j") > 0, "judge_failures"), F.when(c("l") > 5, "latency"))
    names = {"s": "score_gain", "a": "accuracy_gain", "f": "failure_gain", "j": "judge_failure_gain", "l": "latency_gain"}
    return m.select(*[F.round(n, 6).alias(name) for n, name in names.items()], failed.alias("failed"), (failed == "").alias("accepted"))


@register(f"""WITH {SCORED}, w AS (SELECT answer_id, sr.subject_id, sr.session_no, status FROM sr WHERE coalesce({WRONG}, false)), v AS (SELECT w.answer_id, count(*) AS n_states, count(DISTINCT x.evidence_id) AS n_evidence FROM w JOIN st x ON x.subject_id = w.subject_id AND x.session_no <= w.session_no GROUP BY 1),
    b AS (SELECT w.answer_id, count(*) AS n_failed_builds FROM w JOIN (SELECT DISTINCT subject_id, session_no FROM st WHERE state_id % 10 = 3) f ON f.subject_id = w.subject_id AND f.session_no <= w.session_no GROUP BY 1)
    SELECT answer_id, status, n_states, n_evidence, coalesce(n_failed_builds, 0) AS n_failed_builds FROM w JOIN v USING (answer_id) LEFT JOIN b USING (answer_id)""")
def error_case_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wrong answer with the states and evidence that it could see and the builds that failed before it."""
    rows = statements(spark, sf_dir)
    bad = scores(spark, sf_dir).filter(an.is_wrong()).select("answer_id", "subject_id", F.col("session_no").alias("up_to"), "status")
    seen = bad.join(rows.select("subject_id", "session_no", "evidence_id"), "subject_id").filter("session_no <= up_to").groupBy("answer_id", "status").agg(F.count("*").alias("n_states"), F.countDistinct("evidence_id").alias("n_evidence"))
    failed = rows.filter("state_id % 10 = 3").select("subject_id", "session_no").distinct()
    builds = bad.join(failed, "subject_id").filter("session_no <= up_to").groupBy("answer_id").agg(F.count("*").alias("n_failed_builds"))
    return seen.join(builds, "answer_id", "left").select("answer_id", "status", "n_states", "n_evidence", F.coalesce("n_failed_builds", F.lit(0)).alias("n_failed_builds"))


KIND = f"CASE WHEN task IN {fx.COMPLEX_TASKS} OR len(required) > {selection.MANY_FACETS} THEN 'complex' WHEN task = 'multiple_choice' THEN 'multiple_choice' ELSE 'other' END"
BOUND_OF = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in selection.GATE_LIMITS.items()) + " END"
GATE = f"""{INDEXED}, shared AS (SELECT DISTINCT a.state_id, b.state_id AS other_id FROM links a JOIN links b USING (evidence_id) WHERE a.state_id <> b.state_id UNION SELECT * FROM (SELECT state_id, lag(state_id) OVER (PARTITION BY subject_id, family ORDER BY state_id) AS other_id FROM st) WHERE other_id IS NOT NULL),
    kin AS (SELECT s.*, row_number() OVER (PARTITION BY s.state_id ORDER BY o.seconds DESC, s.other_id) AS nth FROM shared s JOIN st o ON o.state_id = s.other_id),
    g0 AS (SELECT *, {KIND} AS kind, len(list_filter(terms, lambda t: contains(body, t))) > 0 OR no > 0 AS strong, len(hits) > 0 OR sh OR no > 0 AS signal, row_number() OVER (PARTITION BY query_id ORDER BY {GATE_SCORE} DESC, seconds DESC, state_id) AS place FROM ix),
    g1 AS (SELECT *, signal AND row_number() OVER (PARTITION BY query_id, signal ORDER BY place) <= {BOUND_OF(1)} AS direct FROM g0), g2 AS (SELECT *, direct AND (strong OR kind <> 'complex' AND sh) AS relevant FROM g1),
    anchors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, relevant ORDER BY place) AS turn FROM g2) WHERE relevant AND turn <= {BOUND_OF(2)}),
    tied AS (SELECT query_id, kin.other_id AS state_id, min(place * 1000 + nth) AS tie FROM anchors a JOIN kin ON kin.state_id = a.state_id AND kin.nth <= {BOUND_OF(3)} GROUP BY ALL),
    g3 AS (SELECT g2.*, tie, direct OR tie IS NOT NULL AS chosen FROM g2 LEFT JOIN tied USING (query_id, state_id)),
    cov AS (SELECT * FROM (SELECT *, unnest(gate_facets) AS facet FROM g3) WHERE strong OR NOT list_contains({list(selection.DIRECT_FACETS)}, facet) AND (tie IS NOT NULL OR (kind <> 'complex' OR list_contains({list(selection.FAMILY_FACETS)}, facet)) AND sh)),
    open_facets AS (SELECT query_id, facet, any_value(list_position(required, facet)) AS pos, list(place ORDER BY place) FILTER (NOT chosen) AS places FROM cov GROUP BY 1, 2 HAVING NOT bool_or(chosen AND (relevant OR tie IS NOT NULL)) AND count(*) FILTER (NOT chosen) > 0),
    fl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM open_facets),
    fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken FROM fl UNION ALL SELECT fl.query_id, fl.i, list_concat(taken, list_filter(places, lambda p: NOT list_contains(taken, p))[1:1]) FROM fold JOIN fl ON fl.query_id = fold.query_id AND fl.i = fold.i + 1),
    repair AS (SELECT query_id, unnest(taken) AS place, unnest(range(1, len(taken) + 1)) AS turn FROM (SELECT query_id, arg_max(taken, i) AS taken FROM fold GROUP BY 1)),
    g4 AS (SELECT g3.*, repair.turn, CASE WHEN direct THEN 1 WHEN tie IS NOT NULL THEN 2 WHEN repair.turn IS NOT NULL THEN 3 WHEN signal THEN 4 END AS n FROM g3 LEFT JOIN repair USING (query_id, place)),
    gate AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, CASE n WHEN 2 THEN tie WHEN 3 THEN turn END, place) AS pick FROM g4 WHERE n IS NOT NULL) WHERE pick <= {BOUND_OF(0)})"""


@register(f"WITH RECURSIVE {GATE} SELECT query_id, state_id, pick, ['direct', 'related', 'facet', 'fill'][n] AS step FROM gate")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that each question may use: direct hits, what is related to them, one for each missing facet, the rest."""
    return selection.coverage_gate(indexed(spark, sf_dir), kin_of(statements(spark, sf_dir)))


def kin_of(rows: DataFrame) -> DataFrame:
    """(state_id, other_id, nth): lineage and shared evidence of each state, the newest first."""
    links = st.links_of(rows)
    shared = links.join(links.select("evidence_id", F.col("state_id").alias("other_id")), "evidence_id").filter("state_id <> other_id").select("state_id", "other_id")
    prior = rows.select("state_id", F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id")).alias("other_id")).filter("other_id is not null")
    both = shared.union(prior).distinct().join(rows.select(F.col("state_id").alias("other_id"), "seconds"), "other_id")
    return both.select("state_id", "other_id", F.row_number().over(W.partitionBy("state_id").orderBy(F.desc("seconds"), "other_id")).alias("nth"))


# Words that diagnose nothing.
DIAGNOSTIC_STOP = ("患者", "问题", "回答", "答案", "正确", "错误", "需要", "信息", "根据", "没有", "这个", "什么", "应该", "可以", "进行", "the", "and", "answer", "patient", "question", "correct", "incorrect")
TOKENS = lambda c: f"list_distinct(list_concat(regexp_extract_all(lower({c}), '[a-z][a-z0-9.+-]{{1,}}'), flatten(list_transform(regexp_extract_all(lower({c}), '\\p{{Han}}+'), lambda b: list_transform(range(1, length(b)), lambda i: b[i:i+1])))))"


@register(f"""WITH {ANSWERS_SQL}, t AS (SELECT answer_id, subject_id, list_filter({TOKENS('gold')}, lambda x: NOT list_contains({list(DIAGNOSTIC_STOP)}, x)) AS terms, {TOKENS('output')} AS said FROM an), s AS (SELECT subject_id, state_id, {TOKENS('text')} AS tokens FROM st),
    h AS (SELECT answer_id, max(len(list_intersect(terms, tokens))) AS raw_hits, max(CASE WHEN state_id % 5 <> 0 THEN len(list_intersect(terms, tokens)) ELSE 0 END) AS state_hits, max(CASE WHEN state_id % 6 = 0 THEN len(list_intersect(terms, tokens)) ELSE 0 END) AS working_hits FROM t JOIN s USING (subject_id) GROUP BY 1)
    SELECT answer_id, len(terms) AS n_terms, len(terms) = 0 OR raw_hits >= least(2, len(terms)) AS in_raw, len(terms) = 0 OR state_hits >= least(2, len(terms)) AS in_states, len(terms) = 0 OR working_hits >= least(2, len(terms)) AS in_working_set, len(terms) = 0 OR len(list_intersect(terms, said)) >= least(2, len(terms)) AS in_answer FROM t JOIN h USING (answer_id)""")
def stage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to which stage the words of a gold answer got: two of them (or all) in one item of the record, its states, the working
    set (here every sixth state), and the answer. Terms meet by key, counted before they are shuffled."""
    from threadline.functions import rules
    from threadline.plans.answer_queries import answers

    stop = F.array(*map(F.lit, DIAGNOSTIC_STOP))
    asked = answers(spark, sf_dir).select("answer_id", "subject_id", F.array_except(rules.diagnostic_tokens(F.col("gold")), stop).alias("terms"), rules.diagnostic_tokens(F.col("output")).alias("said"))
    items = statements(spark, sf_dir).select("subject_id", "state_id", F.explode(rules.diagnostic_tokens(F.col("text"))).alias("term"))
    met = asked.select("answer_id", "subject_id", F.explode("terms").alias("term")).join(items, ["subject_id", "term"]).groupBy("answer_id", "state_id").agg(F.count("*").alias("hits"))
    best = lambda keep: F.max(F.when(keep, F.col("hits")).otherwise(0))
    found = met.groupBy("answer_id").agg(F.max("hits").alias("raw"), best(F.col("state_id") % 5 != 0).alias("states"), best(F.col("state_id") % 6 == 0).alias("working"))
    rows = asked.join(found, "answer_id", "left").withColumn("need", F.least(F.lit(2), F.size("terms")))
    enough = lambda c: (F.size("terms") == 0) | (F.coalesce(c, F.lit(0)) >= F.col("need"))
    return rows.select("answer_id", F.size("terms").cast("long").alias("n_terms"), enough(F.col("raw")).alias("in_raw"), enough(F.col("states")).alias("in_states"), enough(F.col("working")).alias("in_working_set"), enough(F.size(F.array_intersect("terms", "said"))).alias("in_answer"))
