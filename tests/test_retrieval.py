"""The evidence index: bounds hold, fewer pairs are read, and the choice is that over all states."""

import pytest
from pyspark.sql import functions as F

from threadline.operators import evidence_index as ei
from threadline.operators import ranking, selection
from threadline.operators.tables import materialize
from threadline.plans.outcome_queries import kin_of
from threadline.plans.retrieval_queries import indexed_record


@pytest.fixture(scope="module")
def record(spark):
    """One subject with a long record, and questions of three kinds about it."""
    rows, asked, index = indexed_record(spark, "/root/testdata/sf0.01")
    states = index.states.withColumn("subject_id", F.lit(0)).drop("run")
    asked = asked.filter("query_id in (8, 9, 11)").withColumn("subject_id", F.lit(0))
    return materialize(kin_of(rows), "kin"), materialize(asked, "asked"), ei.build_index(states)


def test_the_gate_over_the_index_is_that_over_all_states(record):
    related, asked, index = record
    whole = materialize(ranking.index_score(index.states.join(asked, "subject_id")), "all")
    read = materialize(ei.gate_reads(asked, related, index), "some")
    assert read.count() < 0.7 * whole.count() and read.select("query_id", "state_id").distinct().count() == read.count()
    assert sorted(selection.coverage_gate(read, related).collect()) == sorted(selection.coverage_gate(whole, related).collect())
    # No state scores more than its block's bound, and none that matches lies in a block that may not.
    met = whole.join(ei.bounds(asked, index), ["query_id", *ei.BLOCK])
    signal = (F.col("lexical_hits") > 0) | F.col("scope_hit") | (F.col("option_hits") > 0)
    assert met.count() == whole.count() and met.filter((F.col("gate_score") > F.col("bound")) | signal & ~F.col("may_match")).isEmpty()


def test_nothing_to_index(record):
    related, asked, index = record
    empty = ei.build_index(index.states.drop("run").limit(0))
    assert ei.gate(asked, related, empty).isEmpty()
    lineage = related.select("state_id", "other_id").limit(0)
    links = related.select("state_id", F.col("other_id").alias("evidence_id")).limit(0)
    assert ei.retrieve(asked, related, lineage, links, empty).isEmpty()


def test_states_of_the_gate_stay_without_a_reason(spark):
    scored = spark.createDataFrame([(1, 1, []), (1, 2, ["target_match"]), (1, 3, [])], "query_id long, state_id long, reasons array<string>")
    gated = spark.createDataFrame([(1, 3), (1, 2)], "query_id long, state_id long")
    assert {r["state_id"]: r["reasons"] for r in ei.united(scored, gated).collect()} == {2: ["target_match", "evidence_index_gate"], 3: ["evidence_index_gate"]}
