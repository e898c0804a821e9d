"""Registered queries of evaluations merged into proofs, each beside its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import proofs
from threadline.operators import states as st
from threadline.operators.tables import materialize
from threadline.plans.base import register, statements
from threadline.plans.state_queries import LINKS, PAIRS, PROPOSAL, REJECTED, RELATION, evidence_of, pairs_of

#: A note on a statement and the one before it, which an evaluator reads; its id is the negative of the statement's.
OFFER = {**PROPOSAL, "subject_id": "subject_id", "relation_evidence_id": "CASE WHEN state_id % 23 = 0 THEN evidence_id ELSE -state_id END"}
EVALUATION = {"verdict": "CASE subject_id % 6 WHEN 1 THEN 'unresolved' WHEN 4 THEN 'contradicted' ELSE 'supported' END", "competing_checked": "subject_id % 7 <> 3", "n_missing": "CASE WHEN subject_id % 8 = 2 THEN 1 ELSE 0 END", "path_required": "subject_id % 3 = 0"}
REQUIRED = ("CS", "CP", "LO")

_LIST = lambda e: ", ".join(f"{x} AS {n}" for n, x in e.items())
MERGED = f"""{LINKS}, {PAIRS}, rel AS (SELECT {_LIST(RELATION)} FROM pairs WHERE from_id IS NOT NULL), rl AS (SELECT edge_id, e1 AS evidence_id FROM rel UNION SELECT edge_id, e2 FROM rel),
    rp AS (SELECT edge_id, count(*) FILTER (e.evidence_id IS NULL) AS n_missing, min(e.subject_id) AS low, max(e.subject_id) AS high FROM rl LEFT JOIN evidence e USING (evidence_id) GROUP BY 1),
    stored AS (SELECT a.subject_id, from_id, to_id, 'updates' AS type FROM rel JOIN st a ON a.state_id = from_id JOIN st b ON b.state_id = to_id JOIN rp USING (edge_id) WHERE verified AND rel.status = 'verified' AND NOT causal AND a.subject_id = b.subject_id AND n_missing = 0 AND low = a.subject_id AND high = a.subject_id),
    q AS (SELECT DISTINCT subject_id, {_LIST(EVALUATION)} FROM st), ev AS (SELECT evidence_id, subject_id, text, certainty FROM evidence UNION ALL SELECT -state_id, subject_id, concat(from_text, '; ', text), 1.0 FROM pairs WHERE from_id IS NOT NULL),
    lk AS (SELECT state_id, evidence_id FROM links UNION ALL SELECT state_id, -state_id FROM pairs WHERE from_id IS NOT NULL), t AS (SELECT {_LIST(OFFER)} FROM pairs WHERE from_id IS NOT NULL),
    judged AS (SELECT t.proposal_id, t.subject_id, t.from_state_id, t.to_state_id, t.relation_type, CASE WHEN NOT (relation_type = 'followed_by' AND assessment = 'supports') AND NOT (verdict = 'supported' AND competing_checked AND n_missing = 0)
        THEN CASE WHEN verdict <> 'supported' THEN 'overall_verdict_' || verdict WHEN NOT competing_checked THEN 'competing_hypotheses_not_checked' ELSE 'blocking_missing_evidence' END ELSE {REJECTED.replace("FROM links l", "FROM lk l")} END AS reject_reason
        FROM t JOIN q ON q.subject_id = t.subject_id LEFT JOIN st a ON a.state_id = t.from_state_id LEFT JOIN st b ON b.state_id = t.to_state_id LEFT JOIN ev e ON e.evidence_id = t.relation_evidence_id)"""


def offered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Statements, links and evidence with the notes, evaluations, and proposals judged."""
    rows = statements(spark, sf_dir)
    notes = pairs_of(rows)
    links = st.links_of(rows).select("state_id", "evidence_id").unionByName(notes.select("state_id", (-F.col("state_id")).alias("evidence_id")))
    evidence = evidence_of(rows).select("evidence_id", "subject_id", "text", "certainty").unionByName(notes.select((-F.col("state_id")).alias("evidence_id"), "subject_id", F.concat("from_text", F.lit("; "), "text").alias("text"), F.lit(1.0).alias("certainty")))
    asked = rows.select("subject_id").distinct().selectExpr("subject_id", *[f"{e} AS {n}" for n, e in EVALUATION.items()])
    proposals = notes.selectExpr(*[f"{e} AS {n}" for n, e in OFFER.items()])
    return rows, asked, proofs.judged_proposals(proposals, asked, rows, links, evidence)


@register(f"WITH {MERGED} SELECT proposal_id, subject_id, from_state_id, to_state_id, relation_type, reject_reason FROM judged")
def judged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed relations under their subject's evaluation: what the whole verdict forbids, then what each breaks."""
    return offered(spark, sf_dir)[2].select("proposal_id", "subject_id", "from_state_id", "to_state_id", "relation_type", "reject_reason")


@register(f"""WITH RECURSIVE {MERGED}, n AS (SELECT DISTINCT st.subject_id, st.state_id, st.family FROM st JOIN links USING (state_id) JOIN evidence e ON e.evidence_id = links.evidence_id AND e.subject_id = st.subject_id),
    al AS (SELECT *, true AS persistent FROM stored UNION ALL SELECT subject_id, from_state_id, to_state_id, relation_type, false FROM judged WHERE reject_reason IS NULL),
    m AS (SELECT subject_id, from_id, to_id, type, bool_or(persistent) AS persistent FROM al GROUP BY ALL), k AS (SELECT m.* FROM m JOIN q USING (subject_id) WHERE (NOT path_required OR (NOT persistent AND type <> 'followed_by')) AND from_id IN (SELECT state_id FROM n) AND to_id IN (SELECT state_id FROM n)),
    bw AS (SELECT from_id AS a, to_id AS b FROM k UNION SELECT to_id, from_id FROM k), reach AS (SELECT state_id AS a, state_id AS b FROM n UNION SELECT reach.a, bw.b FROM reach JOIN bw ON bw.a = reach.b), g AS (SELECT a AS state_id, min(b) AS component FROM reach GROUP BY 1),
    s AS (SELECT subject_id, component, count(*) AS size, list_distinct(list(family)) AS families FROM g JOIN n USING (state_id) GROUP BY 1, 2), big AS (SELECT subject_id, arg_max(families, size * 1000000000 - component) AS joined, max(size) AS size, list_distinct(flatten(list(families))) AS here FROM s GROUP BY 1),
    p AS (SELECT q.*, coalesce(size, 0) AS largest, coalesce(joined, []) AS joined, coalesce(here, []) AS here, (SELECT count(*) FROM k WHERE k.subject_id = q.subject_id) AS n_support FROM q LEFT JOIN big USING (subject_id))
    SELECT subject_id, n_support, largest, array_to_string(list_filter({list(REQUIRED)}, lambda f: NOT list_contains(here, f)), ',') AS missing, array_to_string(list_filter({list(REQUIRED)}, lambda f: NOT list_contains(joined, f)), ',') AS disconnected,
        CASE WHEN largest > 0 AND list_has_all(joined, {list(REQUIRED)}) AND (NOT path_required OR (n_support > 0 AND largest > 1)) THEN 'supported' ELSE 'unresolved' END AS verdict FROM p""")
def merged_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's proof after the accepted relations joined the stored ones, whose components are kept and only merged."""
    rows, asked, judged = offered(spark, sf_dir)
    rel = pairs_of(rows).selectExpr(*[f"{e} AS {n}" for n, e in RELATION.items()])
    links = rel.select("edge_id", F.explode(F.array_distinct(F.array("e1", "e2"))).alias("evidence_id"))
    supported = st.supported_relations(rel.drop("e1", "e2"), rows, links, evidence_of(rows)).filter("supported")
    ends = rel.join(supported, "edge_id", "left_semi").select("from_id", "to_id", F.lit("updates").alias("type"))
    stored = materialize(ends.join(rows.select(F.col("state_id").alias("from_id"), "subject_id"), "from_id"), "stored")
    there = st.links_of(rows).join(evidence_of(rows).select("evidence_id", "subject_id"), ["evidence_id", "subject_id"], "left_semi").select("state_id").distinct()
    nodes = materialize(rows.select("subject_id", "state_id", "family").join(there, "state_id", "left_semi"), "nodes")
    relations = materialize(proofs.merged_relations(stored, judged), "relations")
    questions = asked.select("subject_id", F.array(*map(F.lit, REQUIRED)).alias("required"), "path_required")
    out = proofs.merged_proofs(questions, nodes, proofs.stored_components(nodes, stored), relations)
    return out.withColumns({"missing": F.array_join("missing", ","), "disconnected": F.array_join("disconnected", ",")})
