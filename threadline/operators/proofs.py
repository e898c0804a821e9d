"""Relations that an evaluator proposes, merged into the proof of a question: gate, checks, components, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.operators.graph import components, merge_components
from threadline.operators.states import check_proposals

CHRONOLOGY = "followed_by"


def gate_reason() -> Column:
    """Why a whole evaluation supports nothing, null if it may; order in time alone passes without it."""
    whole = F.when(~F.col("verdict").eqNullSafe("supported"), F.concat(F.lit("overall_verdict_"), F.coalesce("verdict", F.lit("null"))))
    whole = whole.when(~F.coalesce("competing_checked", F.lit(False)), "competing_hypotheses_not_checked").when(F.coalesce("n_missing", F.lit(0)) > 0, "blocking_missing_evidence")
    return F.when(~((F.col("relation_type") == CHRONOLOGY) & (F.col("assessment") == "supports")), whole)


def judged_proposals(proposals: DataFrame, evaluations: DataFrame, states: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Proposals (with subject_id) and ``reject_reason``: that of their subject's evaluation (subject_id, verdict, competing_checked,
    n_missing), else the first check that they break; null is accepted. A subject without an evaluation has the verdict null."""
    checked = check_proposals(proposals, states, links, evidence).withColumnRenamed("reject_reason", "broken")
    rows = proposals.join(evaluations.select("subject_id", "verdict", "competing_checked", "n_missing"), "subject_id", "left").withColumn("gate", gate_reason())
    return rows.join(checked, "proposal_id").withColumn("reject_reason", F.coalesce("gate", "broken")).drop("verdict", "competing_checked", "n_missing", "gate", "broken")


def merged_relations(stored: DataFrame, judged: DataFrame) -> DataFrame:
    """Supported stored relations (subject_id, from_id, to_id, type) and accepted proposals, each once; the stored one stays of equals."""
    key = ["subject_id", "from_id", "to_id", "type"]
    new = judged.filter("reject_reason is null").select("subject_id", F.col("from_state_id").alias("from_id"), F.col("to_state_id").alias("to_id"), F.col("relation_type").alias("type"), F.lit(False).alias("persistent"))
    return stored.select(*key, F.lit(True).alias("persistent")).unionByName(new).groupBy(*key).agg(F.max("persistent").alias("persistent"))


def merged_proofs(questions: DataFrame, nodes: DataFrame, labels: DataFrame, relations: DataFrame) -> DataFrame:
    """The proof of each question (one a subject: subject_id, required, path_required) after a merge.

    ``nodes`` (subject_id, state_id, family) are the states with evidence, ``labels`` (node, component) the components of the stored
    relations between them, ``relations`` the merged ones. Where a question needs a path, only new relations that tell more than an
    order in time connect; else the stored components are merged with the new edges and not computed again. The largest component
    counts, of equals that with the least state. A question without states is unresolved, with all its families missing.
    """
    inside = lambda c: nodes.select(F.col("state_id").alias(c))
    asked = relations.join(questions.select("subject_id", "path_required"), "subject_id").join(inside("from_id"), "from_id", "left_semi").join(inside("to_id"), "to_id", "left_semi")
    telling = asked.filter(~F.col("persistent") & (~F.col("path_required") | (F.col("type") != CHRONOLOGY)))
    on_paths = nodes.join(questions.filter("path_required").select("subject_id"), "subject_id", "left_semi").select(F.col("state_id").alias("node"), F.col("state_id").alias("component"))
    stored = labels.join(on_paths, "node", "left_anti").select("node", "component")
    found = merge_components(stored.unionByName(on_paths), telling, "from_id", "to_id")
    sizes = nodes.join(found, nodes["state_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "state_id"))
    sizes = sizes.groupBy("subject_id", "component").agg(F.count("*").alias("size"), F.collect_set("family").alias("families"))
    largest = sizes.groupBy("subject_id").agg(F.max_by(F.struct("families", "size"), F.struct("size", -F.col("component"))).alias("l"), F.flatten(F.collect_set("families")).alias("here"))
    n_support = asked.filter(~F.col("path_required") | (~F.col("persistent") & (F.col("type") != CHRONOLOGY))).groupBy("subject_id").agg(F.count("*").alias("n"))
    rows = questions.join(largest, "subject_id", "left").join(n_support, "subject_id", "left")
    none = F.array().cast("array<string>")
    missing, apart = F.array_except("required", F.coalesce("here", none)), F.array_except("required", F.coalesce(F.col("l.families"), none))
    n, size = F.coalesce("n", F.lit(0)), F.coalesce(F.col("l.size"), F.lit(0))
    whole = (size > 0) & (F.size(apart) == 0) & (~F.col("path_required") | ((n > 0) & (size > 1)))
    return rows.select("subject_id", n.cast("long").alias("n_support"), size.cast("long").alias("largest"), missing.alias("missing"), apart.alias("disconnected"), F.when(whole, "supported").otherwise("unresolved").alias("verdict"))


def stored_components(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Components of stored relations between states with evidence; a lone state is its own."""
    inside = lambda c: nodes.select(F.col("state_id").alias(c))
    edges = stored.select("from_id", "to_id").join(inside("from_id"), "from_id", "left_semi").join(inside("to_id"), "to_id", "left_semi")
    return components(edges.unionByName(nodes.select(F.col("state_id").alias("from_id"), F.col("state_id").alias("to_id"))), "from_id", "to_id")
