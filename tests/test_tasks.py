"""Leases on tasks, and streams that write each batch once, over crashes."""

import datetime as dt
import threading

import pytest

from corpusloom.sources import snapshots
from corpusloom.streaming import tasks

NOW = dt.datetime(2024, 1, 1)
later = lambda s: NOW + dt.timedelta(seconds=s)
RESULT = "task_id string, lease string, status string, result string"


def ids(df):
    return sorted(r.task_id for r in df.collect())


def test_leases_run_out_and_stale_results_are_not_taken(spark, tmp_path):
    at = str(tmp_path / "t")
    plan = spark.createDataFrame([(f"t{i}",) for i in range(4)] + [("t0",), (None,)], "task_id string")
    tasks.plan(plan, at)
    first = tasks.claim(spark, at, NOW, 60, 3).collect()
    assert sorted(r.task_id for r in first) == ["t0", "t1", "t2"] and ids(tasks.claim(spark, at, later(10), 60, 3)) == ["t3"]
    assert tasks.claim(spark, at, later(20), 60, 3).collect() == []
    mine = {r.task_id: r.lease for r in first}
    assert tasks.finish(spark.createDataFrame([("t0", mine["t0"], "ok", "r0"), ("t0", mine["t0"], "ok", "r0"), ("t1", mine["t1"], "failed", None)], RESULT), at) == 2
    # t1 failed and t2's lease has run out: both are free again, and what t2's first worker brings is too late
    second = tasks.claim(spark, at, later(61), 60, 9).collect()
    assert sorted((r.task_id, r.attempts) for r in second) == [("t1", 2), ("t2", 2)]
    assert tasks.finish(spark.createDataFrame([("t2", mine["t2"], "ok", "stale"), ("t0", mine["t0"], "ok", "again")], RESULT), at) == 0
    assert tasks.finish(spark.createDataFrame([(r.task_id, r.lease, "ok", "new") for r in second], RESULT), at) == 2
    got = {r.task_id: (r.status, r.result) for r in snapshots.read(spark, at).collect()}
    assert got == {"t0": ("ok", "r0"), "t1": ("ok", "new"), "t2": ("ok", "new"), "t3": ("leased", None)}
    # the same plan again, and one more task
    tasks.plan(plan.union(spark.createDataFrame([("t9",)], "task_id string")), at)
    assert {r.task_id: r.status for r in snapshots.read(spark, at).collect()} == {"t0": "ok", "t1": "ok", "t2": "ok", "t3": "leased", "t9": "pending"}


def test_two_workers_claim_different_tasks(spark, tmp_path):
    at = str(tmp_path / "t")
    tasks.plan(spark.createDataFrame([(f"t{i}",) for i in range(6)], "task_id string"), at)
    both, met, got = threading.Barrier(2), set(), {}

    def put(spark_, path, text):
        if threading.get_ident() not in met:
            met.add(threading.get_ident())
            both.wait(60)  # both have chosen from the same version
        snapshots.put_if_absent(spark_, path, text)

    def work(k):
        got[k] = ids(tasks.claim(spark, at, NOW, 60, 3, put=put))

    workers = [threading.Thread(target=work, args=(k,)) for k in (1, 2)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert sorted(got[1] + got[2]) == [f"t{i}" for i in range(6)]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_neither_loses_nor_repeats_a_batch(spark, tmp_path, when):
    kind, at, checkpoint = "id long", str(tmp_path / "t"), str(tmp_path / "cp")
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{k}"))
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part-*"))
    calls = []

    def put(spark_, path, text):
        calls.append(path)
        if when == "after" or len(calls) == 1:
            snapshots.put_if_absent(spark_, path, text)
        if len(calls) == 2:
            raise OSError("crash")

    with pytest.raises(Exception, match="crash"):
        tasks.write_once(stream(), at, checkpoint, "numbers", put=put)
    tasks.write_once(stream(), at, checkpoint, "numbers")
    assert sorted(r.id for r in snapshots.read(spark, at).collect()) == list(range(20)) and snapshots.versions(spark, at) == [0, 1]
