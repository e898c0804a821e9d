"""Allow-lists, blind queries, removed fields and merged plans, by hand."""

import pytest
from pyspark.sql import functions as F

from threadline.operators import plan_merge, visibility


def test_views_hold_their_columns_alone(spark):
    tasks = spark.createDataFrame([(1, "memory_recall", "q", "m", "gold"), (2, "session_level_response_generation", "q", "m", "gold"), (3, None, None, None, None)], "task_id long, task_type string, question string, memory_source string, reference_answer string")
    rows = visibility.answer_rows(tasks)
    assert tuple(rows.columns) == visibility.ANSWER_VIEW and "reference_answer" not in rows.columns
    assert {r["task_id"]: r["memory_source"] for r in rows.collect()} == {1: "m", 2: None, 3: None}
    gold = spark.createDataFrame([(1, "g1", "s1", "f1", "x"), (2, "g2", "s2", "f2", "x")], "task_id long, reference_answer string, answer_source string, evaluation_focus string, question string")
    judged = {r["task_id"]: r for r in visibility.judge_rows(rows.withColumn("model_response", F.lit("out")), gold, "task_id", visibility.RUBRIC_JUDGE_VIEW).collect()}
    assert set(judged) == {1, 2} and judged[1]["question"] == "q"
    assert (judged[1]["reference_answer"], judged[1]["answer_source"], judged[1]["evaluation_focus"]) == ("g1", "s1", None)
    assert (judged[2]["reference_answer"], judged[2]["answer_source"], judged[2]["evaluation_focus"]) == (None, None, "f2")


def test_queries_that_read_hidden_columns_are_refused(spark):
    tables = {"tasks": spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, said string, gold long"), "gold": spark.createDataFrame([(1, "x")], "id long, answer string")}
    hidden = {"tasks": ("gold",), "gold": ("answer",)}
    good = visibility.check_blind(lambda t: t["tasks"].select("id", F.upper("said").alias("s")), tables, hidden)
    assert good.count() == 2
    assert visibility.check_blind(lambda t: t["tasks"].withColumn("z", F.col("gold")).select("id"), tables, hidden).count() == 2  # read without effect
    for leak in (
        lambda t: t["tasks"].withColumnRenamed("gold", "g").select("id", (F.col("g") + 1).alias("said")),  # renamed and changed
        lambda t: t["tasks"].filter("gold > 3").select("id"),  # only in a filter
        lambda t: t["tasks"].join(t["gold"].filter("answer = 'x'"), "id").select("id"),  # only through a join
        lambda t: t["tasks"].select("id").union(t["tasks"].filter("gold is not null").select("id")),  # only in how often a row is there
    ):
        with pytest.raises(visibility.LeakError):
            visibility.check_blind(leak, tables, hidden)
    empty = {n: t.limit(0) for n, t in tables.items()}
    assert visibility.check_blind(lambda t: t["tasks"].select("id", "gold"), empty, hidden).isEmpty()


def test_removed_fields_at_any_depth(spark):
    rows = spark.sql("""SELECT 1 AS id, 'e' AS entity, named_struct('a', 1, 'speaker', 's') AS x, array(named_struct('reason', 'r', 'keep', array(named_struct('numbers', 1, 'n', 2)))) AS families, named_struct('reason', 'stays', 'derived', 1) AS other,
        map('speaker', 1, 'k', 2) AS tags, map('k', named_struct('checkpoint', 1, 'z', 3)) AS deep, array(named_struct('derived', 1)) AS gone, CAST(NULL AS STRUCT<a: INT, derived: INT>) AS nothing, array(CAST(NULL AS STRUCT<a: INT, derived: INT>)) AS holes, array(array(named_struct('a', 1, 'entity', 2))) AS twice""")
    got = visibility.clean_rows(rows).first().asDict(recursive=True)
    assert got == {"id": 1, "x": {"a": 1}, "families": [{"keep": [{"n": 2}]}], "other": {"reason": "stays"}, "tags": {"k": 2}, "deep": {"k": {"z": 3}}, "nothing": None, "holes": [None], "twice": [[{"a": 1}]]}
    assert visibility.clean_rows(rows.limit(0)).isEmpty()


def test_merged_plans(spark):
    shape = "n int, question string, task string, given_target string, given_slot string, given_operator string, given_keywords array<string>, given_facets array<string>, given_scopes array<struct<family: string, priority: string>>, given_options array<struct<id: string, text: string>>, target_of string"
    question = "Which?\nA. one\nA. two\nC) three"
    rows = [
        (1, question, None, "  Ｔ1 ", "s", "Event time", [" Ａb ", "x", None, "Ab", "y" * 41], ["f", None, " f", ""], [("bc", "1"), ("BC", "3.5"), ("zz", "3"), (None, "3"), ("PE", None), ("PA", "NaN"), ("CS", "Medium")], [("c", "no"), ("b", " two "), ("b", "later"), ("dd", "x"), (None, "x"), ("e", " ")], "mine"),
        (2, question, "generic", " ", None, "whenever", None, None, None, None, "mine"),
        (3, None, None, None, None, None, [], [], [], [], "mine"),
    ]
    got = {r["n"]: r for r in plan_merge.merge_plans(spark.createDataFrame(rows, shape)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["target"], one["answer_slot"], one["temporal_operator"], one["keywords"], one["facets"]) == ("T1", "s", "event_time", ["Ab"], ["f"])
    assert one["scopes"] == ["BC=3", "PE=1", "PA=1", "CS=2"] and [tuple(o) for o in one["options"]] == [("A", "two"), ("B", "two"), ("C", "three")]
    assert (two["target"], two["answer_slot"], two["temporal_operator"]) == (None, "fact", "none") and [tuple(o) for o in two["options"]] == [("A", "one"), ("A", "two"), ("C", "three")]
    assert two["keywords"] and three["keywords"] == [] and three["scopes"] == [] and three["options"] == [] and one["target_of"] == "mine"
    assert len(plan_merge.merge_plans(spark.createDataFrame([(4, "", "", None, None, None, [f"k{n:03}" for n in range(60)], [f"f{n}" for n in range(30)], None, None, None)], shape)).first()["keywords"]) == 48
