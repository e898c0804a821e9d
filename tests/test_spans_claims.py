"""Places of blocks, contexts of spans, and claims of stopped drugs, by hand and against a plain search."""

import random

from pyspark.sql import functions as F

from threadline.operators.claims import missing_claims, stop_claims
from threadline.operators.sessions import placed_blocks, span_contexts

TEXT = "before\n[Turn=1][Role=Patient]\nhello  \n\n[Turn=2][Role=Doctor][Time=2024-01-02]\n　\n[Turn=x][Role=Nurse]\nsee [Turn=3][Role=Patient]\nend\n[Turn=4][Role=Structured]\n"


def test_blocks_have_their_places(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no header")], "s long, t string")
    got = placed_blocks(rows, ["s"], "t").orderBy("block_no").collect()
    assert [(r["s"], r["turn"], r["role"], r["event_time"]) for r in got] == [(1, "1", "Patient", None), (1, "2", "Doctor", "2024-01-02"), (1, "4", "Structured", None)]
    assert [TEXT[r["content_start"] : r["content_end"]] for r in (got[0], got[2])] == ["hello", ""]
    assert TEXT[got[1]["content_start"] :].startswith("　\n[Turn=x]") and TEXT[: got[1]["content_end"]].endswith("end")
    assert all(TEXT[r["header_start"] :].startswith(f"[Turn={r['turn']}]") for r in got)


def test_contexts_equal_a_plain_search(spark):
    rng = random.Random(5)
    blocks, at = [], 10
    for n in range(40):
        end = at + 20 + rng.choice([0, 5, 300])
        blocks.append((1 if n < 35 else None, n, at, at + 20, end, "Patient", str(n), None))
        at = end + rng.choice([0, 2])
    shape = "k long, block_no long, header_start long, content_start long, content_end long, role string, turn string, event_time string"
    edges = [x for b in blocks for x in (b[2] - 1, b[2], b[3], b[4] - 1, b[4])]
    spans = [(rng.choice([1, None, 2]), x, x + rng.choice([0, 1, 30, 900]), "mine") for x in [*edges, -5, 0, 10_000_000, *edges[:20]]]
    got = span_contexts(spark.createDataFrame(spans, "k long, span_start long, span_end long, role string"), spark.createDataFrame(blocks, shape), ["k"], 16)
    want = []
    for k, a, z, _ in spans:
        b = next((b for b in blocks if b[0] == k and b[2] <= a < b[4]), None)
        want.append((k, a, z, b and b[1], b and z > b[4]))
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.select("k", "span_start", "span_end", "block_no", "crosses").collect()) == order(want)
    assert got.filter("role = 'mine'").count() == len(spans)
    assert span_contexts(spark.createDataFrame([(1, None, None)], "k long, span_start long, span_end long"), spark.createDataFrame(blocks, shape), ["k"]).first()["block_no"] is None


CASES = [
    ("我把二甲双胍停了", ["我把二甲双胍停了"]),
    ("今天还好。后来我昨天把胰岛素停掉了之后，头晕。", ["后来我昨天把胰岛素停掉了之后，"]),
    ("你好， 我把二甲双胍停了， 我把二甲双胍停了", ["我把二甲双胍停了"]),  # the shorter of two
    ("我们把二甲双胍停了", []), ("我没把二甲双胍停了", []), ("如果我把二甲双胍停了", []), ("我把二甲双胍停了？", []), ("医生建议我把二甲双胍停了", []),
    ("我把二甲双胍停了，胰岛素也不用", []),  # two drugs in the sentence
    ("我把二甲双胍停了。说错了。", []), ("我把二甲双胍停了。后来又重新吃上了", []), ("重新吃上了。我把二甲双胍停了", ["我把二甲双胍停了"]),
    ("我把二甲双胍停用了", []), ("我把感冒药停了", []), ("I stopped metformin", []), ("", []),
    ("！！我把布洛芬停了！", ["我把布洛芬停了！"]), ("我把布洛芬停了！\n我把青霉素停了\n", ["我把布洛芬停了！", "我把青霉素停了"]),
]


def test_claims(spark):
    told = spark.createDataFrame([(n, f"[Turn=7][Role=Patient]\n{text}\n\n[Turn=8][Role=Doctor]\n我把二甲双胍停了") for n, (text, _) in enumerate(CASES)], "s long, t string")
    got = stop_claims(placed_blocks(told, ["s"], "t"), ["s"])
    texts = {r["s"]: r["t"] for r in told.collect()}
    found = {}
    for r in got.orderBy("s", "claim_start").collect():
        assert r["turn"] == "7" and texts[r["s"]][r["claim_start"] : r["claim_end"]] == r["claim"]
        found.setdefault(r["s"], []).append(r["claim"])
    assert {n: found.get(n, []) for n in range(len(CASES))} == {n: claims for n, (_, claims) in enumerate(CASES)}
    evidence = spark.createDataFrame([(0, "患者二甲双胍停用后好转"), (1, "如果停用胰岛素"), (2, None), (17, "青霉素停了之后")], "s long, text string")
    left = {(r["s"], r["medication"]): (r["status"], r["record"]) for r in missing_claims(got, evidence, ["s"]).collect()}
    assert (0, "medication:metformin") not in left and (17, "medication:penicillin") not in left
    assert left[(1, "medication:insulin")] == ("stopped", "患者昨天把胰岛素停用之后") and left[(2, "medication:metformin")] == ("stopped", "患者把二甲双胍停用")
    assert left[(17, "medication:ibuprofen")][0] == "stopped" and missing_claims(got.filter(F.lit(False)), evidence, ["s"]).isEmpty()
