"""Late versions in a stream: ten batches against a plain list, and how much state each batch touches."""

import random
from bisect import bisect_right

from threadline.operators.versioning import backfill_versions
from threadline.streaming.ordered_state import VERSIONS, late_versions, store_of_keys

SHAPE = "subject_id long, family string, factor_key long, fact_id long, event_order long, ingest_seq long"
KEYS = ["subject_id", "family", "factor_key"]


def fed(spark, tmp_path, batches):
    """Each batch through a query of its own that goes on from the log; the rows out and the progress of each."""
    seen = []
    with store_of_keys(spark):
        for batch in batches:
            spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
            query = late_versions(source, KEYS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            query.awaitTermination()
            seen.append(sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]))
    rows = spark.read.schema(VERSIONS).parquet(f"{tmp_path}/out").collect()
    return {r["fact_id"]: (r["version"], r["predecessor_id"], r["successor_id"]) for r in rows}, seen


def plain(batches):
    out, lists = {}, {}
    for batch in batches:
        for *key, fact, order, _ in sorted(batch, key=lambda r: (r[5], r[3])):
            rows = lists.setdefault(tuple(key), [])
            order = -(1 << 63) if order is None else order
            at = bisect_right([o for o, _ in rows], order)
            out[fact] = (len(rows) + 1, rows[at - 1][1] if at else None, rows[at][1] if at < len(rows) else None)
            rows.insert(at, (order, fact))
    return out


def test_ten_batches_with_late_facts(spark, tmp_path):
    rng = random.Random(3)
    near = [-(1 << 63), -257, -256, -1, 0, 1, 255, 256, 65_535, 65_536, (1 << 63) - 1, None]
    facts, ingest = [], 0
    for fact in range(600):
        ingest += 1
        key = rng.choice([(1, "a", 0), (1, "a", 0), (1, "b", 0), (None, None, None), (2, "a", 3)])
        facts.append((*key, fact, rng.choice([rng.choice(near), rng.randrange(-500, 500), rng.randrange(-(1 << 62), 1 << 62)]), ingest))
    batches = [facts[n : n + 60] for n in range(0, 600, 60)]
    got, _ = fed(spark, tmp_path, batches)
    assert got == plain(batches)
    # As the batch form has them, which takes no null order.
    timed = [f for f in facts if f[4] is not None]
    batch = backfill_versions(spark.createDataFrame(timed, SHAPE)).collect()
    assert {r["fact_id"]: (r["version"], r["predecessor_id"], r["successor_id"]) for r in batch} == plain([timed])


def test_a_batch_touches_its_own_places(spark, tmp_path):
    history = [(1, "a", 0, n, n * 1000, n) for n in range(5000)]
    late = [(1, "a", 0, 10_000 + n, n * 911_000 + 500, 10_000 + n) for n in range(5)]
    got, touched = fed(spark, tmp_path, [history, late])
    # At most eight nodes and a leaf for each fact, and the count: nothing of the five thousand facts is written again.
    assert touched[1] <= 9 * len(late) + 1
    assert [got[10_000 + n][1:] for n in range(5)] == [(n * 911, n * 911 + 1) for n in range(5)]


def test_no_facts_and_facts_without_id(spark, tmp_path):
    got, touched = fed(spark, tmp_path, [[(1, "a", 0, None, 5, 1)], [(1, "a", 0, 7, 5, None), (1, "a", 0, 8, 5, 2)]])
    assert got == {7: (1, None, None), 8: (2, 7, None)} and touched[0] == 0


def test_a_page_is_written_once_for_its_keys(spark, tmp_path, monkeypatch):
    from threadline.streaming import ordered_state

    monkeypatch.setattr(ordered_state, "BUCKETS", 1)
    monkeypatch.setattr(ordered_state, "SHORT", 3)
    keys = [(None if n == 0 else n, '"a",null' if n % 2 else None, n % 3) for n in range(40)]
    batches = [[(*key, b * 1000 + k * 10 + i, (k * 7 + i * 5 + b * 3) % 11, i) for k, key in enumerate(keys) for i in range(2 if k else 5)] for b in range(3)]
    got, touched = fed(spark, tmp_path, batches)
    assert got == plain(batches)
    # All short keys are one row of the first batch; the long one adds its tree and its number.
    assert touched[0] <= 1 + 1 + 9 * 5
