import json

from threadline.sources import dialogues


def test_dialogues_and_queries(spark, tmp_path):
    eval_dir = tmp_path / "persona_7" / "eval"
    eval_dir.mkdir(parents=True)
    (eval_dir / "d.json").write_text(json.dumps({"sessions": [{"noise_id": "n1", "messages": [{"role": "user", "turn": 1, "content": "hi"}]}, {"session_id": "session-1", "event_info": {"date": "2025-01-01"}, "messages": [{"role": "user", "turn": 1, "content": "a"}, {"role": "doctor", "turn": 2, "content": "b"}]}]}))
    (eval_dir / "q.json").write_text(json.dumps({"queries": [{"query_id": "q1", "query_type": "fact", "session_id": "1", "question": "?", "answers": [{"content": "x", "is_correct": True}, {"content": "y", "is_correct": False}]}]}))
    turns = dialogues.read_dialogues(spark, f"{eval_dir}/d.json").orderBy("position", "turn").collect()
    assert [(r["subject_id"], r["episode_id"], r["is_noise"], r["text"]) for r in turns] == [("7", "n1", True, "hi"), ("7", "session-1", False, "a"), ("7", "session-1", False, "b")]
    case = dialogues.read_queries(spark, f"{eval_dir}/q.json").first()
    assert (case["subject_id"], case["query_id"], case["gold"]) == ("7", "q1", ["x"])


def test_tasks_take_their_folders_type(spark, tmp_path):
    for kind, own in (("recall", None), ("session", "given")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "t.json").write_text(json.dumps([{"task_id": kind, "task_type": own, "question": "?"}]))
    got = {r["task_id"]: r["task_type"] for r in dialogues.read_tasks(spark, {k: f"{tmp_path}/{k}" for k in ("recall", "session")}).collect()}
    assert got == {"recall": "recall", "session": "given"}
    (tmp_path / "rubric.md").write_text("one\ntwo")
    assert dialogues.read_texts(spark, f"{tmp_path}/rubric.md").first()["text"] == "one\ntwo"
