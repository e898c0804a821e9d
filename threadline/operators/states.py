"""States of a record: their evidence, lineage, current heads, verification and relations.

All functions take states as rows of (state_id, subject_id, family, status, seconds, ...), links as rows of (state_id,
subject_id, evidence_id) and evidence as rows of (evidence_id, subject_id, ...). A subject's states are joined by key;
nothing is collected but what a state or an edge owns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.functions import rules
from threadline.operators.graph import components
from threadline.operators.tables import materialize


def links_of(states: DataFrame) -> DataFrame:
    """(state_id, subject_id, evidence_id, place): one row for each distinct evidence id that a state declares."""
    ids = F.array_distinct(F.filter(F.array("evidence_id", "other_evidence_id"), lambda x: x.isNotNull()))
    return states.select("state_id", "subject_id", F.posexplode(ids).alias("place", "evidence_id"))


def bindings(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(state_id, n_declared, n_resolved): evidence counts as resolved if it is there and of the state's subject."""
    there = evidence.select("evidence_id", F.col("subject_id").alias("owner"))
    found = links.join(there, "evidence_id", "left")
    return found.groupBy("state_id").agg(F.count("*").alias("n_declared"), F.count_if(F.col("owner") == F.col("subject_id")).alias("n_resolved"))


def evidence_context(links: DataFrame, evidence: DataFrame, order: Column) -> DataFrame:
    """Per subject the distinct evidence ids in the order of their first state, resolved and missing."""
    first = links.groupBy("subject_id", "evidence_id").agg(F.min(order).alias("first"))
    found = first.join(evidence.select("evidence_id", F.lit(True).alias("there")), "evidence_id", "left")
    pick = lambda keep: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("first", "evidence_id", F.coalesce("there", F.lit(False)).alias("there"))), keep)), lambda x: x["evidence_id"].cast("string")), ",")
    return found.groupBy("subject_id").agg(pick(lambda x: x["there"]).alias("evidence_ids"), pick(lambda x: ~x["there"]).alias("missing_ids"))


def lineage_groups(states: DataFrame, lineage: DataFrame, factor: Sequence[str]) -> DataFrame:
    """(state_id, group_id): components of lineage links and equal factors, the factor as a group key first."""
    states = materialize(states.select("state_id", *factor), "factors")
    heads = states.groupBy(*factor).agg(F.min("state_id").alias("first_id"))
    same = states.join(heads, list(factor)).withColumnRenamed("first_id", "other_id")
    # Links of a lineage mostly stay in the first key of the factor, as a subject.
    by = lambda df: df.select("state_id", "other_id", factor[0])
    found = components(by(same).union(by(lineage.join(states, "state_id", "left"))), "state_id", "other_id", factor[0])
    return found.select(F.col("node").alias("state_id"), F.col("component").alias("group_id"))


def current_states(states: DataFrame, groups: DataFrame) -> DataFrame:
    """(state_id, group_id, head_id, head_status): the newest of each group; a group with a head in conflict has none that is current."""
    rows = states.join(groups, "state_id")
    newest = F.max_by(F.struct("state_id", "status"), F.struct("seconds", "session_no", "state_id"))
    heads = rows.groupBy("group_id").agg(newest.alias("h")).select("group_id", F.col("h.state_id").alias("head_id"), F.col("h.status").alias("head_status"))
    return rows.select("state_id", "group_id").join(heads, "group_id")


def verify_states(states: DataFrame, bound: DataFrame, heads: DataFrame, operator: Column) -> DataFrame:
    """Each state's rejection (null if it is accepted) and whether it blocks an answer.

    ``operator``: the view in time that is asked for. ``heads``: of the states whose evidence is all there.
    """
    rows = states.join(bound, "state_id", "left").join(heads, "state_id", "left")
    current = operator.isin("current", "latest")
    historical = operator.isin("history", "earliest", "first", "event_time", "before", "after", "range")
    is_head = F.coalesce((F.col("head_id") == F.col("state_id")) & (F.col("head_status") != "conflict"), F.lit(False))
    in_conflict = F.coalesce(F.col("head_status") == "conflict", F.lit(False))
    replaced = F.coalesce(~F.col("head_status").isin("conflict", "rejected"), F.lit(False))
    reason = (
        F.when(F.coalesce("n_declared", F.lit(0)) == 0, "missing_evidence_binding").when(F.col("n_resolved") < F.col("n_declared"), "unresolved_or_cross_patient_evidence_id")
        .when(F.col("status") == "conflict", "unresolved_conflict_not_a_verified_fact").when(current & ~is_head & in_conflict, "unresolved_conflict_for_current_view").when(current & ~is_head, "superseded_for_current_view")
        .when((F.col("status") == "rejected") | (~historical & ~current & F.col("status").isin("resolved", "inactive")), "state_not_valid_for_requested_temporal_view")
    )
    rows = rows.withColumn("reason", reason)
    blocking = F.when(F.col("reason") == "superseded_for_current_view", ~replaced).otherwise(F.col("reason").isNotNull())
    return rows.select("state_id", "subject_id", "reason", blocking.alias("blocking"))


def supported_relations(relations: DataFrame, states: DataFrame, relation_links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(edge_id, supported): verified, not causal, both ends of the subject, every evidence id of the subject there."""
    end = lambda n: states.select(F.col("state_id").alias(f"{n}_id"), F.col("subject_id").alias(f"{n}_subject"))
    there = evidence.select("evidence_id", F.col("subject_id").alias("owner"))
    proof = relation_links.join(there, "evidence_id", "left").groupBy("edge_id").agg(F.collect_set("owner").alias("owners"), F.count_if(F.col("owner").isNull()).alias("n_missing"))
    rows = relations.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left").join(proof, "edge_id", "left")
    good = F.col("verified") & (F.col("status") == "verified") & ~F.col("causal") & (F.col("from_subject") == F.col("to_subject")) & (F.col("n_missing") == 0) & (F.col("owners") == F.array("from_subject"))
    return rows.select("edge_id", F.coalesce(good, F.lit(False)).alias("supported"))


def check_proposals(proposals: DataFrame, states: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(proposal_id, reject_reason): the first rule that a proposed relation breaks, null if it is accepted."""
    end = lambda n: states.select(*[F.col(c).alias(f"{n}_{c}") for c in ("state_id", "subject_id", "family", "status", "text", "seconds")])
    proof = evidence.select(F.col("evidence_id").alias("relation_evidence_id"), F.col("subject_id").alias("e_subject"), F.col("text").alias("e_text"), F.col("certainty").alias("e_certainty"))
    bound = links.select(F.col("state_id").alias("bound_id"), F.col("evidence_id").alias("bound_evidence"))
    rows = proposals.join(end("from"), "from_state_id", "left").join(end("to"), "to_state_id", "left").join(proof, "relation_evidence_id", "left")
    ends = rows.select("proposal_id", "relation_evidence_id", F.explode(F.array("from_state_id", "to_state_id")).alias("bound_id"))
    tied = ends.join(bound, (ends["bound_id"] == bound["bound_id"]) & (ends["relation_evidence_id"] == bound["bound_evidence"]), "left_semi").select("proposal_id").distinct().withColumn("tied", F.lit(True))
    rows = rows.join(tied, "proposal_id", "left")
    c = F.col
    long_enough = lambda q: F.regexp_count(q, F.lit(r"[\p{L}\p{N}]")) >= 4
    inside = lambda whole, part: F.contains(whole, part)
    no = lambda x: ~F.coalesce(x, F.lit(False))
    kind, low = c("relation_type"), F.lower(c("relation_quote"))
    cue = F.lit(False)
    for name, pattern in {**fx.CUES, "followed_by": r"(?:之后|随后|后来|先.{0,30}后|after|following|then)"}.items():
        cue = F.when(kind == name, rules.has(low, pattern)).otherwise(cue)
    reason = F.when(c("assessment") != "supports", F.concat(F.lit("assessment_"), c("assessment")))
    for name, broken in (
        ("confidence_below_threshold", c("confidence") < 0.8), ("endpoint_not_in_verified_working_state", c("from_subject_id").isNull() | c("to_subject_id").isNull()), ("cross_patient_endpoint", c("from_subject_id") != c("to_subject_id")),
        ("invalid_endpoint_status", c("from_status").isin("conflict", "rejected") | c("to_status").isin("conflict", "rejected")), ("missing_or_cross_patient_relation_evidence", no(c("e_subject") == c("from_subject_id"))),
        ("relation_evidence_not_bound_to_an_endpoint", c("tied").isNull()), ("endpoint_claim_quote_too_short", ~long_enough(c("from_claim_quote")) | ~long_enough(c("to_claim_quote"))),
        ("endpoint_claim_quote_not_verbatim", no(inside(c("from_text"), c("from_claim_quote"))) | no(inside(c("to_text"), c("to_claim_quote")))), ("relation_quote_not_verbatim", no(inside(c("e_text"), c("relation_quote")))),
        ("relation_quote_does_not_bind_both_claims", no(inside(c("relation_quote"), c("from_claim_quote"))) | no(inside(c("relation_quote"), c("to_claim_quote")))), ("duplicate_claim_endpoints", rules.claim(c("from_text")) == rules.claim(c("to_text"))),
        ("uncertain_evidence", F.coalesce(c("e_certainty") < 0.8, F.lit(False))), ("motivates_family_direction_invalid", (kind == "motivates") & ~((c("from_family") == "PA") & (c("to_family") == "CP"))),
        ("constrains_family_direction_invalid", (kind == "constrains") & ~((c("to_family") == "CP") & c("from_family").isin("BC", "PE", "CS", "PA"))), ("care_targets_family_direction_invalid", (kind == "care_targets") & ~((c("from_family") == "CP") & (c("to_family") == "CS"))),
        ("observed_after_care_family_direction_invalid", (kind == "observed_after_care") & ~((c("from_family") == "CP") & (c("to_family") == "LO"))), ("explicit_relation_cue_missing", ~cue),
        ("followed_by_temporal_order_invalid", (kind == "followed_by") & (c("from_seconds") > c("to_seconds"))),
    ):
        reason = reason.when(broken, name)
    return rows.select("proposal_id", reason.alias("reject_reason"))


def expand_neighbours(states: DataFrame, selected: DataFrame, edges: DataFrame, links: DataFrame, budget: int, preference: Column) -> DataFrame:
    """(subject_id, state_id, place): states one hop from the selected ones, by edges either way or shared evidence, the
    preferred first, as many as the budget leaves room for after the selected."""
    chosen = selected.select("subject_id", F.col("state_id").alias("chosen_id"))
    ways = edges.select(F.col("from_id").alias("chosen_id"), F.col("to_id").alias("state_id")).union(edges.select("to_id", "from_id"))
    by_edge = chosen.join(ways, "chosen_id").select("subject_id", "state_id")
    held = links.join(selected.select("state_id"), "state_id", "left_semi").select("subject_id", "evidence_id").distinct()
    by_evidence = links.join(held, ["subject_id", "evidence_id"], "left_semi").select("subject_id", "state_id")
    near = by_edge.union(by_evidence).distinct().join(selected.select("state_id"), "state_id", "left_anti")
    near = near.join(states.drop("subject_id"), "state_id")
    w = W.partitionBy("subject_id").orderBy(preference.desc(), "state_id")
    room = selected.groupBy("subject_id").agg((F.lit(budget) - F.count("*")).alias("room"))
    return near.withColumn("place", F.row_number().over(w).cast("long")).join(room, "subject_id").filter("place <= room").select("subject_id", "state_id", "place")


def shared_evidence_edges(states: DataFrame, links: DataFrame) -> DataFrame:
    """Candidate edges between states of one evidence, from the earlier family to the later one, with relation and confidence.

    An evidence item is one statement of a source, so its states are few; pairs are the edges that are asked for.
    """
    rank = F.array_position(F.array(*map(F.lit, fx.FAMILIES)), F.col("family"))
    side = lambda n: links.join(states.select("state_id", "family", "text", rank.alias("rank")), "state_id").select("evidence_id", *[F.col(c).alias(f"{n}_{c}") for c in ("state_id", "family", "text", "rank")])
    ordered = F.struct("from_rank", "from_state_id") < F.struct("to_rank", "to_state_id")
    pairs = side("from").join(side("to"), "evidence_id").filter(ordered)
    a, b, words = F.col("from_family"), F.col("to_family"), F.col("to_text")
    relation = (
        F.when((b == "CP") & (a == "BC"), "constrains").when((b == "CP") & (a == "PA"), "motivates").when((a == "CP") & (b == "LO") & rules.has(words, fx.LATER), "followed_by")
        .when((b == "LO") & rules.has(words, fx.CAUSE), "contributes_to").otherwise("informs")
    )
    pairs = pairs.withColumn("relation", relation)
    cue = rules.asserted(F.col("relation"), F.concat_ws(" ", "from_text", "to_text"))
    first = pairs.groupBy("from_state_id", "to_state_id", "relation").agg(F.min("evidence_id").alias("evidence_id"), F.max(F.coalesce(cue, F.lit(0.35))).alias("confidence"), F.max(cue.isNotNull()).alias("asserted"))
    return first.select(F.col("from_state_id").alias("from_id"), F.col("to_state_id").alias("to_id"), "relation", "evidence_id", "confidence", F.when(F.col("asserted"), "asserted").otherwise("hypothesized").alias("support"))
