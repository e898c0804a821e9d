"""What the fourth round's findings asked for, on small rows."""

import pytest

from threadline.operators import evidence_index as ei
from threadline.plans.registry import QUERIES


class Seen(Exception):
    """The plans that a test looks at are there."""


@pytest.mark.parametrize(("query", "labels"), [("index_gate", {"bounds", "first"}), ("retrieved_states", {"scored", "bounds", "first"}), ("evidence_chain_nodes", {"bounds", "first"})])
def test_what_is_worked_out_of_questions_meets_states_by_key(spark, sf_dir, monkeypatch, query, labels):
    plans, store = {}, ei.materialize

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        if labels <= set(plans):
            raise Seen
        return store(df, label)

    monkeypatch.setattr(ei, "materialize", kept)
    with pytest.raises(Seen):
        QUERIES[query](spark, sf_dir)
    for label in labels:
        assert "SortMergeJoin" in plans[label] and "BroadcastHashJoin" not in plans[label], label


def test_plans_show_the_keywords_that_questions_tell_themselves(spark, tmp_path):
    # Statement 1 is given no keywords, statement 3 is.
    rows = spark.createDataFrame([(1, "view", 4), (3, "view", 4)], "event_id long, event_type string, k int")
    rows.selectExpr("event_id", "timestamp '2024-01-02 03:00:00' AS ts", "7L AS user_id", "event_type", "1.0D AS value", """concat('{"k": ', k, '}') AS props""").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["state_id"]: r["keywords"] for r in QUERIES["merged_plans"](spark, str(tmp_path)).collect()}
    assert got == {1: "pain went away after treatment|none|PE|whichholds|holds", 3: "alpha|beta|PE"}
