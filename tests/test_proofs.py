"""Merged components against components from scratch, and the gate and verdict of merged proofs by hand."""

import random

from pyspark.sql import functions as F

from threadline.operators import proofs
from threadline.operators.graph import components, label_changes, merge_components


def labels_of(frame):
    return {r["node"]: r["component"] for r in frame.collect()}


def test_merged_components_equal_those_from_scratch(spark):
    rng = random.Random(11)
    shape = "a long, b long"
    pick = lambda n, most: [(rng.randrange(most), rng.randrange(most)) for _ in range(n)]
    old = pick(150, 300)
    labels = components(spark.createDataFrame(old, shape), "a", "b").cache()
    for new in ([], pick(1, 300), pick(40, 400), [(0, 350), (350, 351), (351, 299)], [(7, 7), (777, 777)], old[:5] * 2, [(None, 3), (4, None)]):
        edges = spark.createDataFrame(new, shape)
        whole = [e for e in old + new if None not in e]
        assert labels_of(merge_components(labels, edges, "a", "b")) == labels_of(components(spark.createDataFrame(whole, shape), "a", "b"))
    # What changes is as large as the new edges.
    assert label_changes(labels, spark.createDataFrame(pick(3, 300), shape), "a", "b").count() <= 6


def test_gate_of_an_evaluation(spark):
    rows = [("supported", True, 0, "motivates", "supports"), ("unresolved", True, 0, "motivates", "supports"), (None, True, 0, "motivates", "supports"), ("supported", False, 0, "motivates", "supports"), ("supported", None, 0, "motivates", "supports"), ("supported", True, 2, "motivates", "supports"), ("unresolved", False, 1, "followed_by", "supports"), ("unresolved", True, 0, "followed_by", "contradicts")]
    frame = spark.createDataFrame(rows, "verdict string, competing_checked boolean, n_missing int, relation_type string, assessment string").coalesce(1)
    assert [r[0] for r in frame.select(proofs.gate_reason()).collect()] == [None, "overall_verdict_unresolved", "overall_verdict_null", "competing_hypotheses_not_checked", "competing_hypotheses_not_checked", "blocking_missing_evidence", None, "overall_verdict_unresolved"]


def test_verdicts(spark):
    nodes = spark.createDataFrame([(s, s * 10 + n, f) for s in (1, 2, 3, 4, 6) for n, f in enumerate(["CS", "CP", "LO"])], "subject_id long, state_id long, family string")
    questions = spark.createDataFrame([(1, ["CS", "CP"], False), (2, ["CS", "CP"], True), (3, ["CS", "CP"], True), (4, ["CS", "PA"], False), (5, ["CS"], False), (6, [], True)], "subject_id long, required array<string>, path_required boolean")
    stored = spark.createDataFrame([(1, 10, 12, "updates"), (2, 20, 21, "updates"), (3, 30, 32, "updates"), (4, 40, 41, "updates")], "subject_id long, from_id long, to_id long, type string")
    judged = spark.createDataFrame(
        [(1, 12, 11, "followed_by", None), (2, 20, 21, "followed_by", None), (3, 30, 31, "motivates", None), (3, 31, 32, "motivates", "uncertain_evidence"), (4, 40, 41, "updates", None), (1, 10, 99, "motivates", None)],
        "subject_id long, from_state_id long, to_state_id long, relation_type string, reject_reason string")
    relations = proofs.merged_relations(stored, judged)
    assert relations.filter("subject_id = 4").select("persistent").collect() == [(True,)]
    out = proofs.merged_proofs(questions, nodes, proofs.stored_components(nodes, stored), relations).collect()
    got = {r["subject_id"]: (r["n_support"], r["largest"], r["missing"], r["disconnected"], r["verdict"]) for r in out}
    assert got == {
        1: (2, 3, [], [], "supported"),  # stored and new edges together; the one to a state that is not there does not count
        2: (0, 1, [], ["CP"], "unresolved"),  # a path needs more than an order in time
        3: (1, 2, [], [], "supported"), 4: (1, 2, ["PA"], ["PA"], "unresolved"), 5: (0, 0, ["CS"], ["CS"], "unresolved"), 6: (0, 1, [], [], "unresolved"),
    }
    assert proofs.merged_proofs(questions.limit(0), nodes, proofs.stored_components(nodes, stored), relations).isEmpty()
    assert {r["verdict"] for r in proofs.merged_proofs(questions, nodes.limit(0), proofs.stored_components(nodes.limit(0), stored), relations.filter(F.lit(False))).collect()} == {"unresolved"}
