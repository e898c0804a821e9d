"""Registered queries over the states of records: versions, edges, evidence, current heads, verification, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators import states as st
from threadline.operators import versioning
from threadline.plans.base import STATEMENTS, matches, register, statements
from threadline.plans.rule_queries import FOLLOWED, assertion_sql, quantity_sql, status_sql, topic_key_sql

# ---- folds ---------------------------------------------------------------------------------------------------------


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of six subjects' groups, so that keys have histories, as versions by subject, family and topic."""
    from threadline.functions import rules

    rows = statements(spark, sf_dir).withColumns({"subject_id": F.col("subject_id") % 6, "event_order": F.col("seconds"), "factor_key": rules.topic_key(F.col("text"))})
    return versioning.fold_states(rows, ["subject_id", "family", "factor_key"])


SAME_KEY = "o.subject_id = n.subject_id AND o.family = n.family AND o.factor_key = n.factor_key AND o.ingest_seq < n.ingest_seq"
FOLD = f"""{STATEMENTS}, f AS (SELECT * REPLACE (subject_id % 6 AS subject_id), {topic_key_sql('st.text')} AS factor_key, concat_ws('#', {assertion_sql('text')}, {quantity_sql('text')}, {status_sql('text')}) AS same FROM st),
    v AS (SELECT *, row_number() OVER (PARTITION BY subject_id, family, factor_key ORDER BY ingest_seq) AS version FROM f),
    b AS (SELECT n.state_id, arg_max(o.state_id, CAST(o.seconds AS HUGEINT) * 100000000000 + o.ingest_seq) AS prior_id FROM v n JOIN v o ON {SAME_KEY} AND o.seconds <= n.seconds GROUP BY 1),
    a AS (SELECT n.state_id, arg_min(o.state_id, CAST(o.seconds AS HUGEINT) * 100000000000 + o.ingest_seq) AS successor_id FROM v n JOIN v o ON {SAME_KEY} AND o.seconds > n.seconds GROUP BY 1),
    p AS (SELECT v.*, b.prior_id, a.successor_id, o.source_type AS p_source, o.polarity AS p_polarity, o.same AS p_same, o.text AS p_text FROM v LEFT JOIN b USING (state_id) LEFT JOIN a USING (state_id) LEFT JOIN v o ON o.state_id = b.prior_id),
    x AS (SELECT state_id, version, prior_id, successor_id, {matches('text', fx.CORRECTION)} OR {matches('text', fx.RECONCILIATION)} AS settles, CASE WHEN {matches('text', fx.CORRECTION)} AND p_source = source_type THEN 'SUPERSEDE'
        WHEN p_source <> source_type AND {matches('text', fx.OPPOSITE)} <> {matches('p_text', fx.OPPOSITE)} THEN 'CONFLICT' WHEN p_polarity <> 'negated' AND (polarity = 'negated' OR {matches('text', fx.RESOLVED)}) THEN 'RESOLVE'
        WHEN p_polarity = polarity AND p_same = same THEN 'NOOP' ELSE 'UPDATE' END AS plain FROM p),
    r AS (SELECT state_id, version, prior_id, successor_id, 'ADD' AS operation, 'active' AS status, CAST(NULL AS BIGINT) AS conflicts_with FROM x WHERE prior_id IS NULL
        UNION ALL SELECT x.state_id, x.version, x.prior_id, x.successor_id, CASE WHEN r.status = 'conflict' THEN CASE WHEN x.settles THEN 'RESOLVE' ELSE 'CONFLICT' END ELSE x.plain END,
            CASE WHEN r.status = 'conflict' THEN CASE WHEN x.settles THEN 'resolved' ELSE 'conflict' END WHEN x.plain = 'CONFLICT' THEN 'conflict' WHEN x.plain = 'RESOLVE' THEN 'resolved' ELSE 'active' END,
            CASE WHEN r.status = 'conflict' AND NOT x.settles THEN coalesce(r.conflicts_with, r.state_id) WHEN r.status <> 'conflict' AND x.plain = 'CONFLICT' THEN r.state_id END FROM x JOIN r ON x.prior_id = r.state_id)"""


@register(f"WITH RECURSIVE {FOLD} SELECT state_id, version, prior_id AS predecessor_id, successor_id, operation, status, conflicts_with FROM r")
def state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir)


@register(f"""WITH RECURSIVE {FOLD}, own AS (SELECT CASE WHEN operation IN ('SUPERSEDE', 'CONFLICT', 'RESOLVE') THEN state_id ELSE prior_id END AS from_id, CASE operation WHEN 'SUPERSEDE' THEN prior_id WHEN 'CONFLICT' THEN conflicts_with WHEN 'RESOLVE' THEN prior_id ELSE state_id END AS to_id,
        CASE operation WHEN 'SUPERSEDE' THEN 'supersedes' WHEN 'CONFLICT' THEN 'conflicts' WHEN 'RESOLVE' THEN 'resolves' WHEN 'NOOP' THEN 'persists' ELSE 'updates' END AS relation, 'version_transition' AS source FROM r WHERE prior_id IS NOT NULL),
    late AS (SELECT r.state_id, r.successor_id, 'updates', 'backfill_successor_transition' FROM r JOIN r s ON r.successor_id = s.state_id WHERE r.status <> 'conflict' AND s.status <> 'conflict')
    SELECT from_id, to_id, relation, max(source) AS source FROM (SELECT * FROM own UNION ALL SELECT * FROM late) GROUP BY 1, 2, 3""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioning.state_transitions(folded(spark, sf_dir))


# ---- evidence ------------------------------------------------------------------------------------------------------

LINKS = f"""{STATEMENTS}, links AS (SELECT state_id, subject_id, evidence_id, 0 AS place FROM st UNION ALL SELECT state_id, subject_id, other_evidence_id, 1 FROM st WHERE other_evidence_id IS NOT NULL),
    evidence AS (SELECT evidence_id, subject_id, string_agg(text, '; ' ORDER BY state_id) AS text, min(seconds) AS seconds, CASE WHEN evidence_id % 6 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS certainty FROM st WHERE evidence_id % 10 <> 7 GROUP BY evidence_id, subject_id
        UNION ALL SELECT DISTINCT other_evidence_id, CASE WHEN state_id % 40 = 0 THEN -1 ELSE subject_id END, '', CAST(NULL AS BIGINT), 1.0::DOUBLE FROM st WHERE other_evidence_id IS NOT NULL AND state_id = (SELECT min(state_id) FROM st o WHERE o.other_evidence_id = st.other_evidence_id))"""


def evidence_of(rows: DataFrame) -> DataFrame:
    """Evidence that the statements' own hours give, but for one in ten, and that of their topics."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state_id", "text"))), lambda x: x["text"]), "; ")
    hours = rows.filter("evidence_id % 10 <> 7").groupBy("evidence_id", "subject_id").agg(text.alias("text"), F.min("seconds").alias("seconds"))
    hours = hours.withColumn("certainty", F.when(F.col("evidence_id") % 6 == 0, 0.5).otherwise(1.0))
    first = rows.filter("other_evidence_id is not null").groupBy(F.col("other_evidence_id").alias("evidence_id")).agg(F.min_by(F.when(F.col("state_id") % 40 == 0, F.lit(-1)).otherwise(F.col("subject_id")), "state_id").alias("subject_id"))
    return hours.unionByName(first.select("evidence_id", "subject_id", F.lit("").alias("text"), F.lit(None).cast("long").alias("seconds"), F.lit(1.0).alias("certainty")))


BOUND = f"{LINKS}, bound AS (SELECT l.state_id, count(*) AS n_declared, count(*) FILTER (e.subject_id = l.subject_id) AS n_resolved FROM links l LEFT JOIN evidence e USING (evidence_id) GROUP BY 1)"


@register(f"WITH {BOUND} SELECT * FROM bound")
def evidence_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    return st.bindings(st.links_of(rows), evidence_of(rows))


@register(f"""WITH {LINKS}, f AS (SELECT subject_id, evidence_id, min(state_id) AS first FROM links GROUP BY 1, 2), t AS (SELECT f.*, e.evidence_id IS NOT NULL AS there FROM f LEFT JOIN (SELECT DISTINCT evidence_id FROM evidence) e USING (evidence_id))
    SELECT subject_id, coalesce(string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY first, evidence_id) FILTER (there), '') AS evidence_ids, coalesce(string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY first, evidence_id) FILTER (NOT there), '') AS missing_ids FROM t GROUP BY 1""")
def evidence_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    return st.evidence_context(st.links_of(rows), evidence_of(rows), F.col("state_id"))


@register(f"""WITH {LINKS}, e AS (SELECT l.state_id, string_agg(e.text, ' ' ORDER BY l.place) AS words FROM links l JOIN evidence e USING (evidence_id) WHERE e.text <> '' GROUP BY 1)
    SELECT state_id, md5(lower(concat_ws(' ', text, family, status, polarity, words))) AS digest, length(lower(concat_ws(' ', text, family, status, polarity, words))) AS n_chars FROM st LEFT JOIN e USING (state_id)""")
def searchable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a state is searched by: value, family, status, polarity and its evidence; a hash stands for it."""
    text = searchable(statements(spark, sf_dir))
    return text.select("state_id", F.md5(F.col("searchable").cast("binary")).alias("digest"), F.length("searchable").cast("long").alias("n_chars"))


def searchable(rows: DataFrame) -> DataFrame:
    from threadline.functions.text import nfkc_lower

    found = st.links_of(rows).join(evidence_of(rows).filter("text <> ''").select("evidence_id", F.col("text").alias("words")), "evidence_id")
    words = found.groupBy("state_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"]), " ").alias("words"))
    return rows.join(words, "state_id", "left").withColumn("searchable", nfkc_lower(F.concat_ws(" ", "text", "family", "status", "polarity", "words")))


@register(f"""WITH {LINKS}, rows AS (SELECT * FROM st JOIN links USING (state_id, subject_id, evidence_id)),
    side AS (SELECT l.evidence_id, s.state_id, s.family, s.text, {'list_position(' + str(list(fx.FAMILIES)) + ', s.family)'} AS rank FROM links l JOIN st s USING (state_id)),
    pairs AS (SELECT a.evidence_id, a.state_id AS from_id, b.state_id AS to_id, a.text || ' ' || b.text AS words, CASE WHEN b.family = 'CP' AND a.family = 'BC' THEN 'constrains' WHEN b.family = 'CP' AND a.family = 'PA' THEN 'motivates'
        WHEN a.family = 'CP' AND b.family = 'LO' AND {matches('b.text', fx.LATER)} THEN 'followed_by' WHEN b.family = 'LO' AND {matches('b.text', fx.CAUSE)} THEN 'contributes_to' ELSE 'informs' END AS relation
        FROM side a JOIN side b ON a.evidence_id = b.evidence_id AND (a.rank < b.rank OR a.rank = b.rank AND a.state_id < b.state_id)),
    cued AS (SELECT *, CASE {' '.join(f"WHEN relation = '{n}' AND {matches('words', p)} THEN {c}" for n, (p, c) in fx.ASSERTED.items())} END AS cue FROM pairs)
    SELECT from_id, to_id, relation, min(evidence_id) AS evidence_id, max(coalesce(cue, 0.35))::DOUBLE AS confidence, CASE WHEN bool_or(cue IS NOT NULL) THEN 'asserted' ELSE 'hypothesized' END AS support FROM cued GROUP BY 1, 2, 3""")
def shared_evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    return st.shared_evidence_edges(rows, st.links_of(rows))


# ---- current heads and verification --------------------------------------------------------------------------------

LINEAGE = f"lin AS (SELECT state_id, prior AS other_id FROM (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS prior FROM st) WHERE prior IS NOT NULL AND state_id % 3 = 0)"
FACTORED = f"s2 AS (SELECT st.*, {topic_key_sql('st.text')} AS factor_key FROM st)"


def lineage_of(rows: DataFrame) -> DataFrame:
    """A third of the statements supersede the one before of their subject and family."""
    prior = F.lag("state_id").over(W.partitionBy("subject_id", "family").orderBy("state_id"))
    return rows.select("state_id", prior.alias("other_id")).filter("other_id is not null and state_id % 3 = 0")


def groups_of(rows: DataFrame) -> DataFrame:
    from threadline.functions import rules

    return st.lineage_groups(rows.withColumn("factor_key", rules.topic_key(F.col("text"))), lineage_of(rows), ["subject_id", "family", "factor_key"])


VISIBLE = f"{BOUND}, {LINEAGE}, {FACTORED}, vis AS (SELECT s2.* FROM s2 JOIN bound USING (state_id) WHERE n_declared = n_resolved)"
REACH = """e AS (SELECT l.state_id AS a, l.other_id AS b FROM lin l JOIN {v} x ON x.state_id = l.state_id JOIN {v} y ON y.state_id = l.other_id UNION SELECT state_id, min(state_id) OVER (PARTITION BY subject_id, family, factor_key) FROM {v}),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a), grp AS (SELECT a AS state_id, min(b) AS group_id FROM reach GROUP BY a),
    hd AS (SELECT group_id, arg_max(state_id, CAST(seconds AS HUGEINT) * 100000000 + state_id) AS head_id, arg_max(status, CAST(seconds AS HUGEINT) * 100000000 + state_id) AS head_status FROM grp JOIN {v} USING (state_id) GROUP BY 1)"""


@register(f"WITH RECURSIVE {STATEMENTS}, {LINEAGE}, {FACTORED}, {REACH.format(v='s2')} SELECT state_id, group_id, head_id, head_status FROM grp JOIN hd USING (group_id)")
def current_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements(spark, sf_dir)
    return st.current_states(rows, groups_of(rows))


VIEW = "CASE subject_id % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'history' WHEN 2 THEN 'latest' ELSE 'none' END"
REASON = f"""CASE WHEN coalesce(n_declared, 0) = 0 THEN 'missing_evidence_binding' WHEN n_resolved < n_declared THEN 'unresolved_or_cross_patient_evidence_id' WHEN status = 'conflict' THEN 'unresolved_conflict_not_a_verified_fact'
    WHEN {VIEW} IN ('current', 'latest') AND head_status = 'conflict' THEN 'unresolved_conflict_for_current_view' WHEN {VIEW} IN ('current', 'latest') AND head_id <> state_id THEN 'superseded_for_current_view'
    WHEN {VIEW} = 'none' AND status = 'resolved' THEN 'state_not_valid_for_requested_temporal_view' END"""
VERIFIED = f"""{VISIBLE}, {REACH.format(v='vis')}, ver AS (SELECT st.state_id, st.subject_id, {REASON} AS reason FROM st LEFT JOIN bound USING (state_id) LEFT JOIN grp USING (state_id) LEFT JOIN hd USING (group_id))"""


def verified(rows: DataFrame) -> DataFrame:
    bound = st.bindings(st.links_of(rows), evidence_of(rows))
    visible = rows.join(bound.filter("n_declared = n_resolved").select("state_id"), "state_id", "left_semi")
    return st.verify_states(rows, bound, st.current_states(visible, groups_of(visible)), F.expr(VIEW))


@register(f"""WITH RECURSIVE {BOUND}, {FACTORED}, vis AS (SELECT s2.* FROM s2 JOIN bound USING (state_id) WHERE n_declared = n_resolved),
    lin AS (SELECT state_id, prior AS other_id FROM (SELECT state_id, lag(state_id) OVER {FOLLOWED} AS prior FROM vis) WHERE prior IS NOT NULL AND state_id % 3 = 0), {REACH.format(v='vis')},
    ver AS (SELECT st.state_id, st.subject_id, {REASON} AS reason FROM st LEFT JOIN bound USING (state_id) LEFT JOIN grp USING (state_id) LEFT JOIN hd USING (group_id))
    SELECT state_id, subject_id, reason, reason IS NOT NULL AND reason <> 'superseded_for_current_view' AS blocking FROM ver""")
def verified_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements against the view in time that their subject is asked for."""
    return verified(statements(spark, sf_dir))


# ---- relations -----------------------------------------------------------------------------------------------------

PAIRS = f"pairs AS (SELECT *, lag(state_id) OVER w AS from_id, lag(evidence_id) OVER w AS from_evidence, lag(text) OVER w AS from_text FROM st WINDOW w AS (PARTITION BY subject_id ORDER BY state_id))"
RELATION = {"edge_id": "state_id", "from_id": "CASE WHEN state_id % 17 = 0 THEN state_id - 1 ELSE from_id END", "to_id": "state_id", "verified": "state_id % 10 <> 3", "status": "CASE WHEN state_id % 8 = 5 THEN 'candidate' ELSE 'verified' END", "causal": "state_id % 31 = 7", "e1": "evidence_id", "e2": "from_evidence"}


def pairs_of(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("subject_id").orderBy("state_id")
    return rows.select("*", F.lag("state_id").over(w).alias("from_id"), F.lag("evidence_id").over(w).alias("from_evidence"), F.lag("text").over(w).alias("from_text")).filter("from_id is not null")


@register(f"""WITH {LINKS}, {PAIRS}, rel AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RELATION.items())} FROM pairs WHERE from_id IS NOT NULL), rl AS (SELECT edge_id, e1 AS evidence_id FROM rel UNION SELECT edge_id, e2 FROM rel),
    proof AS (SELECT edge_id, count(*) FILTER (e.evidence_id IS NULL) AS n_missing, min(e.subject_id) AS low, max(e.subject_id) AS high FROM rl LEFT JOIN evidence e USING (evidence_id) GROUP BY 1)
    SELECT edge_id, coalesce(verified AND rel.status = 'verified' AND NOT causal AND a.subject_id = b.subject_id AND n_missing = 0 AND low = a.subject_id AND high = a.subject_id, false) AS supported
    FROM rel LEFT JOIN st a ON a.state_id = from_id LEFT JOIN st b ON b.state_id = to_id LEFT JOIN proof USING (edge_id)""")
def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between a subject's statements in turn; some of them broken."""
    rows = statements(spark, sf_dir)
    rel = pairs_of(rows).selectExpr(*[f"{e} AS {n}" for n, e in RELATION.items()])
    proof = rel.select("edge_id", F.explode(F.array_distinct(F.array("e1", "e2"))).alias("evidence_id"))
    return st.supported_relations(rel.drop("e1", "e2"), rows, proof, evidence_of(rows))


PROPOSAL = {
    "proposal_id": "state_id", "from_state_id": "from_id", "to_state_id": "CASE WHEN state_id % 19 = 0 THEN -state_id ELSE state_id END", "relation_type": "CASE state_id % 5 WHEN 0 THEN 'motivates' WHEN 1 THEN 'constrains' WHEN 2 THEN 'care_targets' WHEN 3 THEN 'observed_after_care' ELSE 'followed_by' END",
    "relation_evidence_id": "CASE WHEN state_id % 23 = 0 THEN evidence_id + 1 ELSE evidence_id END", "relation_quote": "concat(from_text, '; ', text)", "from_claim_quote": "CASE WHEN state_id % 29 = 0 THEN 'ab' ELSE from_text END", "to_claim_quote": "CASE WHEN state_id % 27 = 0 THEN concat(text, '!') ELSE text END",
    "assessment": "CASE WHEN state_id % 12 = 0 THEN 'unresolved' ELSE 'supports' END", "confidence": "CAST(CASE WHEN state_id % 10 < 2 THEN 0.7 ELSE 0.9 END AS DOUBLE)",
}
CUE_SQL = "CASE t.relation_type " + " ".join(f"WHEN '{n}' THEN {matches('lower(t.relation_quote)', p)}" for n, p in {**fx.CUES, "followed_by": r"(?:之后|随后|后来|先.{0,30}后|after|following|then)"}.items()) + " END"
CLAIM = lambda c: f"regexp_replace(lower({c}), '" + fx.CLAIM_MARKS.replace("'", "''") + "', '', 'g')"


#: The first rule that a proposal t between the states a and b breaks, with e its evidence.
REJECTED = f"""CASE WHEN assessment <> 'supports' THEN 'assessment_' || assessment WHEN confidence < 0.8 THEN 'confidence_below_threshold' WHEN a.state_id IS NULL OR b.state_id IS NULL THEN 'endpoint_not_in_verified_working_state' WHEN a.subject_id <> b.subject_id THEN 'cross_patient_endpoint'
        WHEN a.status IN ('conflict', 'rejected') OR b.status IN ('conflict', 'rejected') THEN 'invalid_endpoint_status' WHEN NOT coalesce(e.subject_id = a.subject_id, false) THEN 'missing_or_cross_patient_relation_evidence'
        WHEN NOT EXISTS (SELECT 1 FROM links l WHERE l.state_id IN (t.from_state_id, t.to_state_id) AND l.evidence_id = t.relation_evidence_id) THEN 'relation_evidence_not_bound_to_an_endpoint'
        WHEN len(regexp_extract_all(from_claim_quote, '[\\p{{L}}\\p{{N}}]')) < 4 OR len(regexp_extract_all(to_claim_quote, '[\\p{{L}}\\p{{N}}]')) < 4 THEN 'endpoint_claim_quote_too_short'
        WHEN NOT contains(a.text, from_claim_quote) OR NOT contains(b.text, to_claim_quote) THEN 'endpoint_claim_quote_not_verbatim' WHEN NOT contains(e.text, relation_quote) THEN 'relation_quote_not_verbatim'
        WHEN NOT contains(relation_quote, from_claim_quote) OR NOT contains(relation_quote, to_claim_quote) THEN 'relation_quote_does_not_bind_both_claims' WHEN {CLAIM('a.text')} = {CLAIM('b.text')} THEN 'duplicate_claim_endpoints' WHEN e.certainty < 0.8 THEN 'uncertain_evidence'
        WHEN relation_type = 'motivates' AND NOT (a.family = 'PA' AND b.family = 'CP') THEN 'motivates_family_direction_invalid' WHEN relation_type = 'constrains' AND NOT (b.family = 'CP' AND a.family IN ('BC', 'PE', 'CS', 'PA')) THEN 'constrains_family_direction_invalid'
        WHEN relation_type = 'care_targets' AND NOT (a.family = 'CP' AND b.family = 'CS') THEN 'care_targets_family_direction_invalid' WHEN relation_type = 'observed_after_care' AND NOT (a.family = 'CP' AND b.family = 'LO') THEN 'observed_after_care_family_direction_invalid'
        WHEN NOT {CUE_SQL} THEN 'explicit_relation_cue_missing' WHEN relation_type = 'followed_by' AND a.seconds > b.seconds THEN 'followed_by_temporal_order_invalid' END"""


@register(f"""WITH {LINKS}, {PAIRS}, t AS (SELECT {', '.join(f'{e} AS {n}' for n, e in PROPOSAL.items())} FROM pairs WHERE from_id IS NOT NULL)
    SELECT t.proposal_id, {REJECTED} AS reject_reason
    FROM t LEFT JOIN st a ON a.state_id = t.from_state_id LEFT JOIN st b ON b.state_id = t.to_state_id LEFT JOIN evidence e ON e.evidence_id = t.relation_evidence_id""")
def proposed_relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations proposed between a subject's statements in turn, and the first rule that each breaks."""
    rows = statements(spark, sf_dir)
    return st.check_proposals(pairs_of(rows).selectExpr(*[f"{e} AS {n}" for n, e in PROPOSAL.items()]), rows, st.links_of(rows), evidence_of(rows))


@register(f"""WITH {LINKS}, {PAIRS}, sel AS (SELECT * FROM st WHERE state_id % 6 = 0), ways AS (SELECT from_id AS a, state_id AS b FROM pairs WHERE from_id IS NOT NULL UNION ALL SELECT state_id, from_id FROM pairs WHERE from_id IS NOT NULL),
    near AS (SELECT s.subject_id, w.b AS state_id FROM sel s JOIN ways w ON w.a = s.state_id UNION SELECT l.subject_id, l.state_id FROM links l WHERE (l.subject_id, l.evidence_id) IN (SELECT l2.subject_id, l2.evidence_id FROM links l2 JOIN sel ON sel.state_id = l2.state_id)),
    room AS (SELECT subject_id, 24 - count(*) AS room FROM sel GROUP BY 1), placed AS (SELECT near.subject_id, state_id, row_number() OVER (PARTITION BY near.subject_id ORDER BY seconds DESC, state_id) AS place FROM near JOIN st USING (state_id) WHERE state_id NOT IN (SELECT state_id FROM sel))
    SELECT subject_id, state_id, place FROM placed JOIN room USING (subject_id) WHERE place <= room""")
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one hop adds to every sixth statement of a subject, the latest first, within a budget of 24."""
    rows = statements(spark, sf_dir)
    edges = pairs_of(rows).select("from_id", F.col("state_id").alias("to_id"))
    return st.expand_neighbours(rows, rows.filter("state_id % 6 = 0"), edges, st.links_of(rows), 24, F.col("seconds"))
