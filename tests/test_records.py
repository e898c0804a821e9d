"""Parts without SQL: readers, stores, streams over several files, quotations, cut JSON, the greedy selection, hot groups."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadline.operators import documents, quality, ranking, snapshots, tables
from threadline.sources import dialogues, stores
from threadline.streaming import streams


def test_admissions(spark, tmp_path):
    for patient in ("16", "17"):
        (tmp_path / patient).mkdir()
        (tmp_path / patient / "combined.json").write_text(json.dumps({"admissions": [{"hadm_id": 5, "conversation_lines": [{"speaker": "Patient", "turn_number": 1, "time": "t", "text": "a"}, {"speaker": "Nurse", "turn_number": 2, "text": "b"}]}, {"hadm_id": 6, "conversation_lines": []}]}))
        (tmp_path / patient / "qa.json").write_text(json.dumps({"qas": [{"qa_id": "q1", "question_type": "fact", "question": "?", "answer": "x", "scope": "single_admission"}, {"qa_id": "q2", "question_type": "adversarial", "question": "?", "answer": "y", "scope": "cross_admission"}]}))
    turns = dialogues.read_admissions(spark, f"{tmp_path}/*/combined.json").orderBy("subject_id", "turn").collect()
    assert [(r["subject_id"], r["episode_id"], r["source_type"], r["text"]) for r in turns] == [("16", "5", "patient", "a"), ("16", "5", "doctor", "b"), ("17", "5", "patient", "a"), ("17", "5", "doctor", "b")]
    read = lambda *a: sorted(r["query_id"] for r in dialogues.read_admission_questions(spark, f"{tmp_path}/16/qa.json", *a).collect())
    assert read() == ["q1", "q2"] and read("Single admission") == ["q1"] and read("all", "adversarial") == ["q2"]
    assert {r["subject_id"]: r["n_files"] for r in dialogues.catalog(spark, str(tmp_path), r"/(\d+)/[^/]+$").collect()} == {"16": 2, "17": 2}
    (tmp_path / "rubric.md").write_text("marks")
    tasks = spark.createDataFrame([("t1", "recall"), ("t2", "other")], "task_id string, task_type string")
    assert {r["task_id"]: r["rubric"] for r in dialogues.with_rubrics(spark, tasks, {"recall": f"{tmp_path}/rubric.md"}).collect()} == {"t1": "marks", "t2": None}


def test_commits_and_scans(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    nodes = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c")], "state_id long, subject_id long, value string")
    no_errors = quality.errors(quality.required("value"))
    stores.commit({"nodes": (nodes, no_errors), "edges": (nodes.limit(1), F.lit(""))}, folder)
    with pytest.raises(ValueError, match="nodes: value must be"):
        stores.commit({"edges": (nodes, F.lit("")), "nodes": (nodes.withColumn("value", F.lit(" ")), no_errors)}, folder)
    nodes.withColumn("subject_bucket", stores.bucket()).write.partitionBy("subject_bucket").parquet(f"{folder}/nodes/commit=broken")
    assert stores.committed(spark, folder, "nodes").count() == 3 and stores.committed(spark, folder, "edges").count() == 1
    assert {r["state_id"] for r in stores.of_subject(spark, folder, "nodes", 10).collect()} == {1, 2}  # neither the refused commit's nor the broken one's
    assert stores.of_subject(spark, folder, "nodes", 10).count() == 2
    stores.commit({"nodes": (nodes.filter("state_id = 1").withColumn("state_id", F.lit(0).cast("long")), no_errors)}, folder)
    assert [r["state_id"] for r in stores.of_subject(spark, folder, "nodes", 10).collect()][-1] == 0  # the last commit comes last
    wanted = spark.createDataFrame([([3, 1, 3, 9],)], "ids array<long>")
    assert [r["state_id"] for r in stores.in_request_order(nodes, "state_id", wanted, "ids").orderBy("place").collect()] == [3, 1]


def test_upserts_snapshots_exports(spark, tmp_path):
    old = spark.createDataFrame([("r", 1, 5, "a"), ("r", 2, 5, "b")], "run_id string, ordinal int, at int, note string")
    new = spark.createDataFrame([("r", 2, 5, "c"), ("s", 1, 1, "d")], old.schema)
    traces = stores.upsert(old, new, ["run_id", "ordinal"], "at")
    assert sorted((r["run_id"], r["ordinal"], r["note"]) for r in traces.collect()) == [("r", 1, "a"), ("r", 2, "c"), ("s", 1, "d")]
    bundle = {r["run_id"]: json.loads(r["bundle"]) for r in stores.run_bundles(spark.createDataFrame([("r", "x")], "run_id string, name string"), traces).collect()}
    assert [t["note"] for t in bundle["r"]["traces"]] == ["a", "c"]
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, [7]), (2, [7, 8])], "state_id long, evidence_ids array<long>")
    for _ in range(2):
        stores.save_snapshot(rows, folder, 4, 9, "k")
    evidence = spark.createDataFrame([(7,), (8,)], "evidence_id long")
    assert stores.restore_snapshot(spark, folder, 4, 9, "k", evidence).count() == 2
    with pytest.raises(ValueError, match="evidence"):
        stores.restore_snapshot(spark, folder, 4, 9, "k", evidence.limit(1))
    scores = spark.createDataFrame([(1, 10, "e1", False), (2, 10, "e1", True)], "answer_id long, subject_id long, episode_id string, is_correct boolean")
    cases = stores.error_cases(scores, ~F.col("is_correct"), spark.createDataFrame([(10, 5), (10, 4)], "subject_id long, state_id long"), spark.createDataFrame([("e1", "said")], "episode_id string, text string")).collect()
    assert len(cases) == 1 and [s["state_id"] for s in cases[0]["states"]] == [4, 5] and cases[0]["observations"][0]["text"] == "said"
    stores.export_json(spark.createDataFrame([(1, "k", 5)], "id int, token string, n int"), f"{folder}/out")
    assert json.loads(spark.read.text(f"{folder}/out").first()[0]) == {"id": 1, "token": "[REDACTED]", "n": 5}
    assert [r["n"] for r in stores.newest(spark.range(5).withColumnRenamed("id", "n"), ["n"], "n", 2).collect()] == [4, 3]


def test_fingerprints_of_rows(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "y", "")], "k int, v string, w string")
    same, other = a.orderBy(F.desc("v")), a.na.fill("")
    assert snapshots.compare(a, same, ["k"]).first()["equal"] and not snapshots.compare(a, other, ["k"]).first()["equal"]
    assert not snapshots.compare(a, a.union(a.limit(1)), ["k"]).first()["equal"]


def test_streams_resume_where_they_stopped(spark, tmp_path):
    source, log, out = (f"{tmp_path}/{n}" for n in ("in", "log", "out"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, v string").parquet(source)
    streams.commit_batches(stream(), out, log, ["id"])
    streams.commit_batches(stream(), out, log, ["id"])
    spark.createDataFrame([(2, "late"), (3, "c")], "id long, v string").coalesce(1).write.mode("append").parquet(source)
    streams.commit_batches(stream(), out, log, ["id"])
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
    assert {r["id"]: r["v"] for r in streams.committed_rows(spark, out, ["id"]).collect()} == {1: "a", 2: "b", 3: "c"}


def test_replies_come_back_as_turns(spark):
    turns, replies = spark.createDataFrame([(1, "q")], "id int, text string"), spark.createDataFrame([(2, "a", "bot")], "id int, text string, by string")
    assert streams.with_feedback(turns, replies).count() == 2


def test_cut_json():
    cut = '{"evidence": [ {"a": 1}, {"b": "x ] } \\" y"}, {"c": [1, {"d": 2}]} , {"e": "cut'
    assert documents.complete_objects(cut) == ['{"a":1}', '{"b":"x ] } \\" y"}', '{"c":[1,{"d":2}]}']
    assert documents.complete_objects(None) == documents.complete_objects("") == documents.complete_objects('{"other": [1]}') == documents.complete_objects('{"evidence": [') == []


def test_quotations():
    text = "The patient takes metformin 500 mg twice daily. Later: the dose was raised.\nThe patient sleeps well."
    at = lambda q: documents.align_quote(text, q)
    level, start, end, score = at("takes metformin 500 mg")
    assert (level, text[start:end], score) == ("exact", "takes metformin 500 mg", 1.0)
    level, start, end, _ = at("METFORMIN 500  mg, twice daily")
    assert (level, text[start:end]) == ("formatting", "metformin 500 mg twice daily")
    level, start, end, score = at("Later: the dost was raised")
    assert level == "fuzzy" and "the dose was raise" in text[start:end] and score >= 0.9
    assert at("the patient")[0] == "none" and at("nothing of this kind here")[0] == "none" and documents.align_quote(None, None)[0] == "none"
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        row = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                row[i][j] = min(row[i - 1][j] + 1, row[i][j - 1] + 1, row[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert documents.distance(a, b, 99) == row[-1][-1]


def test_clauses_hold_their_places(spark, sf_dir):
    from threadline.plans.registry import QUERIES

    texts = {f"{r['conv_id']}-{r['turn']}": r["text"] for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    rows = QUERIES["clause_places"](spark, sf_dir).collect()
    assert rows and all(texts[r["id"]][r["start"] : r["end"]] == r["clause"] for r in rows)
    one = documents.clauses(spark.createDataFrame([(1, "pain and pain, but no pain。再见"), (2, None), (3, "")], "id int, text string"), "id", "text").orderBy("start").collect()
    assert [(r["clause"], r["start"]) for r in one] == [("pain", 0), ("pain", 9), ("no pain。", 19), ("再见", 27)]


def test_steps_of_the_diversified_selection(spark):
    from threadline.operators.selection import diversified

    asked, scopes = ["objective_results", "symptoms_or_adverse_effects"], ["CS=2", "PE=1", "CP=1"]
    strong, facet = ["keyword_match"], ["care_plan"]
    # place -> (family, reasons, facets); CS weighs 120 with a quota of 2, PE 108 with 4, CP 10 with 1.
    rows = {1: ("BC", strong, []), 2: ("BC", [], []), 3: ("CS", strong, []), 4: ("LO", [], []), 5: ("PE", [], []), 6: ("CS", [], []), 7: ("CS", [], []), 8: ("CP", [], []), 9: ("PE", [], []), 10: ("CP", [], facet), 11: ("LO", [], []), 12: ("BC", [], facet)}
    df = spark.createDataFrame([(q, 100 * q + p, p, f, r, m, asked, scopes) for q in (1, 2) for p, (f, r, m) in rows.items()], "query_id long, state_id long, place long, family string, reasons array<string>, matched_facets array<string>, facets array<string>, scopes array<string>")
    # 1 and 3 are strong; PE has none yet (5); CS may take one more (6), PE up to four (9); CP has none (8); LO is new (4), so is a facet (10).
    want = [1, 3, 5, 6, 9, 8, 4, 10, 2, 7, 11, 12]
    for limit in (4, 8, 12):
        got = [r["state_id"] for r in diversified(df, limit).orderBy("query_id", "pick").collect()]
        assert got == [100 * q + p for q in (1, 2) for p in want[:limit]]
    assert diversified(df.limit(0), 3).count() == 0


def test_numbers_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}" if i % 2 else None, i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = sorted(((r["k"] or "", r["v"], r["n"]) for r in tables.numbered(df, ["k"], [F.asc("v")], "n").collect()))
    want = []
    for k in {k for k, _ in rows}:
        want += [(k or "", v, n) for n, v in enumerate(sorted(v for x, v in rows if x == k), 1)]
    assert got == sorted(want) and tables.numbered(df.limit(0), ["k"], [F.asc("v")], "n").count() == 0


def test_null_keys_are_one_key(spark):
    from threadline.operators.versioning import backfill_versions, fold_states

    facts = spark.createDataFrame([(i, 1, "a", None, i, i * 10) for i in (1, 2, 3)], "fact_id long, subject_id long, family string, factor_key long, ingest_seq long, event_order long")
    assert {r["fact_id"]: (r["version"], r["predecessor_id"]) for r in backfill_versions(facts).collect()} == {1: (1, None), 2: (2, 1), 3: (3, 2)}
    shape = "state_id long, subject_id long, family string, factor_key string, event_order long, ingest_seq long, source_type string, polarity string, text string"
    # A conflict stays until it is corrected; a late state goes between.
    states = [(1, 1, "CS", None, 10, 1, "patient", None, "takes drug a"), (2, 1, "CS", None, 20, 2, "doctor", "affirmed", "stopped drug a"), (3, 1, "CS", None, 30, 3, "patient", None, "takes drug a"), (4, 1, "CS", None, 40, 4, "patient", None, "Actually, takes drug a"), (5, 1, "CS", None, 15, 5, "patient", None, "takes  drug a!")]
    got = {r["state_id"]: (r["version"], r["predecessor_id"], r["successor_id"], r["operation"], r["status"], r["conflicts_with"]) for r in fold_states(spark.createDataFrame(states, shape), ["subject_id", "family", "factor_key"]).collect()}
    assert got == {1: (1, None, None, "ADD", "active", None), 2: (2, 1, None, "CONFLICT", "conflict", 1), 3: (3, 2, None, "CONFLICT", "conflict", 1), 4: (4, 3, None, "RESOLVE", "resolved", None), 5: (5, 1, 2, "NOOP", "active", None)}


def test_steps_of_the_coverage_gate(spark):
    from threadline.operators.selection import coverage_gate

    shape = "query_id long, state_id long, task string, gate_score double, seconds long, lexical_hits int, value_hits int, scope_hit boolean, option_hits int, gate_facets array<string>, required array<string>"

    def picks(rows, kin, task="generic", required=("direct_facts", "sleep", "adherence")):
        df = spark.createDataFrame([(7, i, task, 100.0 - i, 0, lexical, value, scope, 0, list(facets), list(required)) for i, lexical, value, scope, facets in rows], shape)
        related = spark.createDataFrame([(a, b, n) for a, others in kin.items() for n, b in enumerate(others, 1)], "state_id long, other_id long, nth int")
        return [(r["state_id"], r["step"]) for r in coverage_gate(df, related).orderBy("pick").collect()]

    # Two direct hits, one of them an anchor; its kin in the record (9 is not); one statement a missing facet; no more match.
    rows = [(1, 2, 1, False, ["direct_facts"]), (2, 1, 0, False, []), (3, 0, 0, False, []), (4, 0, 1, False, ["sleep", "adherence"]), (5, 0, 1, False, ["sleep"]), (6, 0, 1, False, ["adherence"])]
    assert picks(rows, {1: [9, 3], 2: [5]}) == [(1, "direct"), (2, "direct"), (3, "related"), (4, "facet"), (6, "facet")]
    # What is related may cover a facet; a facet that only direct hits cover stays open.
    assert picks([*rows[:2], (3, 0, 0, False, ["sleep"]), (8, 0, 0, True, ["diagnosis"])], {1: [3]}, required=("sleep", "diagnosis")) == [(1, "direct"), (2, "direct"), (8, "direct"), (3, "related")]
    # Ten direct hits, then two of kin, then the rest that match up to twenty-four.
    many = [(i, 1, int(i == 1), False, ["direct_facts"] if i == 1 else []) for i in range(1, 41)]
    got = picks(many, {1: [30, 31, 32]}, required=("direct_facts",))
    assert got == [*((i, "direct") for i in range(1, 11)), (30, "related"), (31, "related"), *((i, "fill") for i in range(11, 23))]


def test_a_scorers_failures_are_rows(spark):
    import pandas as pd

    from threadline.operators.hooks import scored_by

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["id"] == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"score": batch["id"] * 0.5})

    got = {r["id"]: (r["score"], r["error"]) for r in scored_by(spark.range(6), scorer, "score double", "id").collect()}
    assert got == {i: (i * 0.5, None) if i != 3 else (None, "ValueError: three") for i in range(6)}


def test_answers_at_boundaries_across_stops(spark, tmp_path):
    shape = "subject_id long, session_no long, kind string, item_id long, family string"
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    batches = [
        [(1, 1, "fact", 11, "CS"), (1, 2, "question", 92, None), (1, 2, "fact", 12, "PE"), (2, 1, "question", 93, None)],
        [(1, 1, "commit", None, None), (1, 1, "question", 91, None), (1, 3, "fact", 15, "LO")],  # session 3 is open: not in the answers
        [(1, 2, "fact", 13, "CS"), (1, 2, "commit", None, None)],
        [(1, 1, "question", 94, None), (1, 1, "fact", 19, "BC"), (1, 3, "question", 95, None), (1, 3, "commit", None, None)],  # late question, late fact
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        streams.resumed(streams.answers_at_boundaries(spark.readStream.schema(shape).parquet(source)), out, log)
    got = {r["question_id"]: (r["session_no"], r["n_facts"], r["last_fact_id"], r["families"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert got == {91: (1, 1, 11, "CS", False), 92: (2, 3, 13, "CS,PE", False), 94: (1, None, None, None, True), 95: (3, 5, 19, "BC,CS,LO,PE", False)}


def test_facets_that_a_question_has_to_cover(spark):
    from threadline.functions import rules

    cases = {
        ("task_2", "how is it"): ["sleep", "direct_facts", "patient_appraisal", "goals", "patient_preference", "longitudinal_change", "care_plan"],
        ("BDI-II", "which score"): ["sleep", "direct_facts", "patient_appraisal", "symptoms_or_adverse_effects", "care_plan"],
        ("generic", "Why was it stopped?"): ["sleep", "direct_facts", "longitudinal_change", "clinical_context"],
        ("temporal_localization", "何时"): ["sleep", "direct_facts", "event_time"],
        ("state_update", "有什么变化"): ["sleep", "direct_facts", "current_status", "previous_state", "longitudinal_change", "clinical_context"],
        ("other", None): ["sleep", "direct_facts"],
    }
    df = spark.createDataFrame([(t, q, ["sleep"]) for t, q in cases], "task string, question string, facets array<string>")
    got = {(r["task"], r["question"]): r["x"] for r in df.withColumn("x", rules.coverage_facets(F.col("facets"), F.col("task"), F.col("question"))).collect()}
    assert got == cases
    many = spark.range(1).select(rules.coverage_facets(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string")), F.lit("x"), F.lit("why")).alias("x")).first()["x"]
    assert len(many) == 24
