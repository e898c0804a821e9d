"""Selections of a question's candidates, each candidate's step and place in it computed by windows.

Both selections give every candidate a step, the reason for which it would be taken, and an order within the step; what is
taken are the first by step and order, up to the question's limit. Nothing is picked in a loop over rows, and no question's
candidates meet in a Python task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadline.functions import fixed as fx
from threadline.operators.ranking import STRONG
from threadline.operators.tables import materialize

# What a facet that is asked for adds to its family's weight, and how many of the family it may take.
QUOTAS = (("symptoms_or_adverse_effects", "PE", 98, 4), ("objective_results", "CS", 100, 2), ("treatment_response", "LO", 92, 2), ("medication_status", "CS", 96, 2), ("adherence", "PE", 94, 1), ("contraindications_and_allergies", "CS", 90, 1), ("care_plan", "CP", 75, 1), ("medical_history", "BC", 70, 1), ("patient_preference", "PA", 65, 1))
#: Weight from which a family decides a question; candidates with a strong reason that go first.
DECIDING, STRONG_FIRST = 100, 3

# Candidates, direct hits, anchors and relations of an anchor that a question may have; facets that only a direct
# hit can cover, and those that the family alone can; required facets from which a question is a complex one.
GATE_LIMITS = {"complex": (40, 14, 8, 3), "multiple_choice": (32, 10, 5, 2), "other": (24, 10, 5, 2)}
DIRECT_FACETS = ("diagnosis", "objective_results", "contraindications_and_allergies", "allergies_and_contraindications", "safety_constraints", "serious_complications", "medical_history", "patient_preference", "care_plan")
FAMILY_FACETS = ("current_status", "previous_state", "event_time")
MANY_FACETS = 7


def one_of(column: Column, names: tuple[str, ...]) -> Column:
    return column.isin(*names)


def diversified(candidates: DataFrame, limit: int, order: str = "place") -> DataFrame:
    """(query_id, state_id, pick) of at most ``limit`` candidates (query_id, state_id, family, reasons, matched_facets, and the question's facets and scopes).

    Steps: 1 the first STRONG_FIRST with a strong reason; 2 the first of each deciding family without any of these; 3 of
    deciding families as many as their quota leaves; 4 the first of each other family asked for that has none yet; 5 the first
    to bring a family or a facet that steps 1 to 4 don't; 6 the rest. Steps 2 to 4 go by weight, the others by ``order``.
    """
    c = F.col
    asked = lambda name, family: F.array_contains("facets", name) & (c("family") == family)
    weight = F.array_max(F.transform(F.filter("scopes", lambda s: F.substring(s, 1, 2) == c("family")), lambda s: F.substring(s, 4, 2).cast("int"))) * 10
    for name, family, value, _ in QUOTAS:
        weight = weight + F.when(asked(name, family), value).otherwise(0)
    by = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy(order))
    rows = candidates.select("query_id", "state_id", order, "family", "matched_facets", weight.alias("weight"), F.coalesce(*[F.when(asked(name, family), q) for name, family, _, q in QUOTAS if q > 1], F.lit(1)).alias("quota"), F.arrays_overlap("reasons", F.array(*map(F.lit, (*STRONG, "semantic_concept_match")))).alias("strong"))
    rows = rows.withColumn("head", c("strong") & (by("strong") <= STRONG_FIRST))
    rows = rows.withColumns({"nth": by("family", "head"), "heads": F.sum(c("head").cast("int")).over(W.partitionBy("query_id", "family"))})
    without = c("heads") == 0
    step = F.when(c("head"), 1).when((c("weight") >= DECIDING) & without & (c("nth") == 1), 2).when((c("weight") >= DECIDING) & (c("nth") <= c("quota") - c("heads")), 3).when((c("weight") < DECIDING) & without & (c("nth") == 1), 4)
    rows = rows.withColumn("step", step).withColumn("held", F.count("step").over(W.partitionBy("query_id", "family")))
    facets = rows.select("query_id", order, "step", F.explode("matched_facets").alias("facet")).groupBy("query_id", "facet").agg(F.count("step").alias("shown"), F.min(order).alias(order))
    fresh = facets.filter("shown = 0").select("query_id", order).distinct().withColumn("fresh", F.lit(True))
    rows = rows.join(fresh, ["query_id", order], "left")
    rows = rows.withColumn("step", F.coalesce("step", F.when(c("fresh") | (c("held") == 0) & (c("nth") == 1), 5), F.lit(6)))
    weighed = c("step").between(2, 4)
    first = W.partitionBy("query_id").orderBy("step", F.when(weighed, -c("weight")), F.when(weighed, c("family")), order)
    return rows.withColumn("pick", F.row_number().over(first).cast("long")).filter(c("pick") <= limit).select("query_id", "state_id", "pick")


def bound(i: int) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in GATE_LIMITS.items()])


def with_direct(indexed: DataFrame) -> DataFrame:
    """Rows of index_score with the kind of question, their place, whether they match, are direct hits, and relevant ones."""
    c = F.col
    kind = F.when(one_of(c("task"), fx.COMPLEX_TASKS) | (F.size("required") > MANY_FACETS), "complex").when(c("task") == "multiple_choice", "multiple_choice").otherwise("other")
    strong = (c("value_hits") > 0) | (c("option_hits") > 0)
    best = [F.desc("gate_score"), F.desc("seconds"), F.asc("state_id")]
    rows = indexed.select("query_id", "state_id", "gate_score", "gate_facets", "required", "scope_hit", strong.alias("strong"), kind.alias("kind"), ((c("lexical_hits") > 0) | c("scope_hit") | (c("option_hits") > 0)).alias("signal"), F.row_number().over(W.partitionBy("query_id").orderBy(*best)).alias("place"))
    nth = F.row_number().over(W.partitionBy("query_id", "signal").orderBy("place"))
    rows = rows.withColumn("direct", c("signal") & (nth <= bound(1)))
    return rows.withColumn("relevant", c("direct") & (c("strong") | (c("kind") != "complex") & c("scope_hit")))


def coverable(tied: Column) -> Column:
    """Whether a row of with_direct can cover its ``facet``."""
    c = F.col
    by_family = ((c("kind") != "complex") | one_of(c("facet"), FAMILY_FACETS)) & c("scope_hit")
    return c("strong") | ~one_of(c("facet"), DIRECT_FACETS) & (tied | by_family)


def coverage_gate(indexed: DataFrame, related: DataFrame) -> DataFrame:
    """(query_id, state_id, pick, step): which of a question's statements (``indexed``, rows of index_score) it may use.

    ``related``: (state_id, other_id, nth). Steps: the first that match are direct; what is related to the first relevant ones
    among them is related; for each required facet that neither covers, the first other statement that can cover it and that no
    facet before took; the rest that match fill up. GATE_LIMITS bound the steps by the kind of question.
    """
    c = F.col
    # Read four times below: stored, so that what gives the scores runs once.
    rows = materialize(with_direct(indexed), "direct")
    by = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy("place"))
    anchors = rows.withColumn("turn", by("relevant")).filter(c("relevant") & (c("turn") <= bound(2))).select("query_id", "state_id", "place", bound(3).alias("most"))
    tied = anchors.join(related, "state_id").filter("nth <= most").groupBy("query_id", c("other_id").alias("state_id")).agg(F.min(F.struct("place", "nth")).alias("tie"))
    rows = rows.join(tied, ["query_id", "state_id"], "left").withColumn("chosen", c("direct") | c("tie").isNotNull())

    covering = rows.withColumn("facet", F.explode("gate_facets")).filter(coverable(c("tie").isNotNull()))
    met = covering.withColumn("met", F.max((c("chosen") & (c("relevant") | c("tie").isNotNull())).cast("int")).over(W.partitionBy("query_id", "facet")))
    # As many facets as there are may take a statement before this one does.
    able_rows = met.filter("met = 0 and not chosen").withColumn("turn", by("facet")).filter(c("turn") <= F.size("required"))
    lists = able_rows.groupBy("query_id", "facet", F.array_position("required", c("facet")).alias("at")).agg(F.sort_array(F.collect_list("place")).alias("places"))
    taken = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "places"))), F.array().cast("array<int>"), lambda done, x: F.concat(done, F.slice(F.array_except(x["places"], done), 1, 1)))
    repair = lists.groupBy("query_id").agg(taken.alias("taken")).select("query_id", F.posexplode("taken").alias("turn", "place"))

    rows = rows.join(repair, ["query_id", "place"], "left")
    step = F.when(c("direct"), 1).when(c("tie").isNotNull(), 2).when(c("turn").isNotNull(), 3).when(c("signal"), 4)
    rows = rows.withColumn("n", step).filter("n is not null")
    first = W.partitionBy("query_id").orderBy("n", F.when(c("n") == 2, c("tie")), F.when(c("n") == 3, c("turn")), "place")
    names = F.element_at(F.array(*map(F.lit, ("direct", "related", "facet", "fill"))), c("n"))
    return rows.withColumn("pick", F.row_number().over(first).cast("long")).filter(c("pick") <= bound(0)).select("query_id", "state_id", "pick", names.alias("step"))
