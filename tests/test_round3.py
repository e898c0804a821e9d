"""What the third round's findings asked for, on small rows."""

import duckdb
from pyspark.sql import functions as F


def test_polarity_of_words_beside_other_letters(spark, tmp_path):
    from threadline.plans.registry import ORACLES, QUERIES

    texts = {"noñasción": "affirmed", "ciónos": "affirmed", "no.": "negated", "é no": "negated", "maybeé": "affirmed", "(maybe)": "uncertain", "nó": "affirmed", "_not_": "affirmed", "not\nnow": "negated"}
    rows = [(1, turn, "user", text) for turn, text in enumerate([*texts, None])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in QUERIES["polarity_certainty"](spark, str(tmp_path)).collect())
    assert [r[2] for r in got] == [*texts.values(), "affirmed"]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["polarity_certainty"]).fetchall()) == got


def test_components_leave_only_centres_to_the_rounds(spark, monkeypatch):
    from threadline.operators import graph

    seen = []
    solve = graph._least_labels
    monkeypatch.setattr(graph, "_least_labels", lambda edges: seen.append(edges.count()) or solve(edges))
    chains = [(k * 100 + i, k * 100 + i + 1, k) for k in range(1, 9) for i in range(50)]
    want = {n: k * 100 for k in range(1, 9) for n in range(k * 100, k * 100 + 51)}
    edges = spark.createDataFrame(chains[::2] + chains[1::2], "a long, b long, k long").repartition(7)
    got = [{r["node"]: r["component"] for r in graph.components(edges, "a", "b", *near).collect()} for near in ((), ("k",))]
    assert got == [want, want]
    assert seen[0] > 0 and seen[1] == 0  # brought together, the chains are solved where they lie


def test_stars_of_more_nodes_than_a_task_holds():
    import pyarrow as pa

    from threadline.operators import graph

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i + 1])], names=["a", "b"]) for i in range(6)]
    most, graph.STAR_NODES = graph.STAR_NODES, 3
    try:
        out = [p for b in graph._stars(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    finally:
        graph.STAR_NODES = most
    assert out == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 3), (4, 3), (5, 3), (6, 3)]


def test_scores_of_questions_worked_out_once(spark):
    from threadline.operators import ranking

    questions = spark.createDataFrame(
        [(1, "multiple_choice", "which insulin", "二甲双胍", ["metformin"], [("A", "glucose"), ("B", "sleep")], ["objective_results"], ["CS=3"], "none"), (2, "multi_hop_clinical_deduction", "glucose", "pain", ["空腹血糖", "a-b"], [], ["care_plan"], ["CP=2"], "current")],
        "query_id long, task string, question string, target string, keywords array<string>, options array<struct<id:string,text:string>>, facets array<string>, scopes array<string>, operator string",
    )
    states = spark.createDataFrame([(1, "CS", "active", "affirmed", 5, "Metformin, glucose", "metformin, glucose cs active"), (2, "CP", "resolved", "affirmed", 6, "空腹 血糖 plan", "空腹 血糖 plan cp")], "state_id long, family string, status string, polarity string, seconds long, text string, searchable string")
    pairs = states.crossJoin(questions)
    for score, ahead in ((ranking.score, ranking.with_parts), (ranking.index_score, ranking.with_terms)):
        joined = score(states.crossJoin(ahead(questions)))
        assert sorted(map(str, joined.collect())) == sorted(map(str, score(pairs).collect())) and joined.columns == score(pairs).columns


def test_blocks_hold_the_runs_of_all_their_texts(spark, monkeypatch):
    from threadline.operators import evidence_index as ei

    monkeypatch.setattr(ei, "PIECE_STATES", 4)
    rows = spark.createDataFrame([(1, "CS", k % 2, k, f"text {k} 二甲双胍"[: 6 + k]) for k in range(14)] + [(2, "CS", 0, 99, "a")], "subject_id long, family string, run long, state_id long, searchable string")
    sizes = rows.groupBy(*ei.BLOCK).agg(F.count("*").alias("n_states"))
    got = {tuple(r[:3]): set(r["grams"]) for r in ei.block_grams(rows, sizes).collect()}
    each = rows.select(*ei.BLOCK, ei.grams(F.col("searchable")).alias("grams")).collect()
    want = {}
    for r in each:
        want.setdefault(tuple(r[:3]), set()).update(r["grams"])
    assert got.keys() == want.keys() and all(want[k] <= got[k] for k in want)


def test_quotations_by_one_pass_over_each_run():
    import random

    from threadline.operators import documents

    rng = random.Random(3)
    for _ in range(200):
        a, text = ("".join(rng.choice("abc") for _ in range(rng.randint(1, most))) for most in (80, 90))
        start = rng.randrange(len(text))
        assert documents.distances(a, text, start, start + 70) == [documents.distance(a, text[start : start + n], 999) for n in range(min(70, len(text) - start) + 1)]
    quote = "abcdefghijklmnopqrstuvwxy" + "1234567890ABCDEFGHIJKLMNO".lower()[::-1]
    # Seven letters of fifty differ: 0.86, not the threshold's 0.92.
    assert documents.align_quote("zz " + quote[:10] + "zzzzzzz" + quote[17:] + " zz", quote) == ("none", -1, -1, 0.0)


def test_token_lists_of_an_answer_are_worked_out_once(spark):
    from threadline.operators import answers

    seen = []
    found, answers.rules.plain_answer = answers.rules.plain_answer, lambda t, f=answers.rules.plain_answer: seen.append(1) or f(t)
    try:
        rows = spark.createDataFrame([("x, b b", "b, x c"), ("x x b", "x b b"), (None, "x"), (",", "x"), ("", "")], "p string, g string")
        got = [round(r[0], 6) for r in rows.select(answers.token_f1(F.col("p"), F.col("g"))).collect()]
    finally:
        answers.rules.plain_answer = found
    assert got == [0.666667, 0.666667, 0.0, 0.0, 0.0]
    assert len(seen) == 4  # the whole answers, and the parts of each side


def test_boundary_answers_of_subjects_kept_together(spark, tmp_path, monkeypatch):
    from threadline.streaming import streams

    monkeypatch.setattr(streams, "SUBJECT_BUCKETS", 2)
    shape = "subject_id long, session_no long, kind string, item_id long, family string"
    subjects = [None, 0, 9_007_199_254_740_993, 9_007_199_254_740_995, *range(20, 40)]
    loads = [[], [], []]
    for s in subjects:
        n = s or 1
        loads[0] += [(s, 1, "fact", n + 1, "b"), (s, 1, "fact", n, None), (s, 2, "question", 7, None), (s, 1, "commit", None, None), (s, 1, "question", 5, None)]
        loads[1] += [(s, 2, "fact", n + 2, "a"), (s, 3, "fact", n + 3, "c"), (s, 2, "commit", None, None), (s, None, "fact", 1, "x")]
        loads[2] += [(s, 2, "question", 8, None), (s, 3, "question", 9, None), (s, 3, "commit", None, None)]
    for load in loads:
        spark.createDataFrame(load, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.resumed(streams.answers_at_boundaries(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/log")
        kept = spark.read.format("statestore").load(f"{tmp_path}/log").count()
        assert kept <= 2  # a state a group, not a subject
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in spark.read.schema(streams.BOUNDARY_ANSWERS).parquet(f"{tmp_path}/out").collect()}
    want = {}
    for s in subjects:
        n = s or 1
        want |= {(s, 1, 5): (2, n + 1, "b", False), (s, 2, 7): (3, n + 2, "a,b", False), (s, 2, 8): (None, None, None, True), (s, 3, 9): (4, n + 3, "a,b,c", False)}
    assert got == want


def test_question_rules_work_a_question_out_once(spark):
    from threadline.functions import rules
    from threadline.operators import plan_merge

    rows = spark.createDataFrame([("latest status and history?", "state_update", "high"), ("ＨＩＳＴＯＲＹ", "generic", " 2.0 "), ("", "generic", "odd"), (None, None, None)], "question string, task string, priority string")
    for rule in (rules.question_scopes, rules.question_facets, rules.temporal_operator, rules.answer_slot):
        plan = rows.select(rule(F.col("question"), F.col("task")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("compose") == 1
    given = F.array(F.struct(F.lit("bc").alias("family"), F.col("priority").alias("priority")), F.struct(F.lit("XX").alias("family"), F.lit("3").alias("priority")), F.struct(F.lit(None).cast("string").alias("family"), F.lit("1").alias("priority")))
    own = F.array(F.lit("LO=2"), F.lit("BC=1"), F.lit("LO=3"))
    got = [r[0] for r in rows.select(plan_merge.merged_scopes(own, given)).collect()]
    assert got == [["BC=3", "LO=3"], ["BC=2", "LO=3"], ["BC=1", "LO=3"], ["BC=1", "LO=3"]]


def test_questions_without_options_are_not_scored_for_options(spark, sf_dir, monkeypatch):
    from threadline.plans import ranking_queries as rq

    seen = []
    score = rq.ranking.score
    monkeypatch.setattr(rq.ranking, "score", lambda pairs: seen.append(pairs.filter("size(options) = 0").isEmpty()) or score(pairs))
    rq.option_results(spark, sf_dir)
    assert seen == [True]


def test_channels_are_counted_without_an_order(spark, sf_dir, monkeypatch):
    from threadline.plans import ranking_queries as rq

    def ordered(candidates):
        raise AssertionError("counts need no order")

    monkeypatch.setattr(rq.ranking, "ordered", ordered)
    assert rq.channel_counts(spark, sf_dir).count() > 0


def test_terms_that_only_match_as_a_whole(spark):
    from threadline.operators import ranking

    terms = {"Metformin": True, "family support": True, "a": True, "空腹血糖": False, "a-b": True, "bé12": False, "éé": True, "HbA1c": True}
    rows = spark.createDataFrame([(t, "the doc holds nothing") for t in terms] + [("bé12", "x 12 y")], "term string, doc string")
    got = rows.select("term", "doc", ranking.term_parts(F.col("term"))["whole"].alias("whole"), ranking.similarity(F.col("term"), F.lower("doc")).alias("like")).collect()
    assert {r["term"]: r["whole"] for r in got} == terms
    assert [r["like"] for r in got if r["doc"] == "x 12 y"] == [1.0]


def test_shared_pairs_come_once_without_grouping(spark):
    from threadline.plans.record_queries import shared_pairs

    links = [(1, 1, 10), (1, 1, 11), (2, 1, 10), (2, 1, 11), (2, 1, 11), (3, 1, 11), (4, 2, 11)]  # a pair shares two, one link is there twice, a subject is another
    pairs = shared_pairs(spark.createDataFrame(links, "state_id long, subject_id long, evidence_id long"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert "Aggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
