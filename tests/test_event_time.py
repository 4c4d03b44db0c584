"""Event-time streams: the same result for any dealing of rows into batches within the watermark."""

import collections
import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ledger
from corpusloom.plans import state_queries
from corpusloom.streaming import state
from corpusloom.streaming.feed import deal

TURNS = "session_id string, ts timestamp, question string, answer string, ok boolean, reset boolean"
CALLS = "account string, ts timestamp, call_id long, amount double"
START = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def run(spark, make, batches, kind, tmp_path, name):
    """Feed each batch as one file and read what came out."""
    folder = deal(spark, [spark.createDataFrame(b, kind) for b in batches], "ts", str(tmp_path / name))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    return state.run_available(make(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))


def told(turns):
    """Histories by plain Python."""
    number, history, out = {}, {}, []
    for s, ts, q, a, ok, reset in sorted(turns, key=lambda r: (r[1], r[2])):
        if reset:
            number[s], history[s] = 0, []
            continue
        number[s] = number.get(s, 0) + 1
        out.append((s, number[s], "\n".join(history.setdefault(s, [])), q, ok, False))
        if ok:
            history[s] += [f"user: {q}", f"agent: {a}"]
    return sorted(out)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    return [(f"s{i % 4}", at(10 * i), f"q{i}", f"a{i}", rng.random() > 0.3, rng.random() > 0.9) for i in range(40)]


def test_histories_are_those_of_event_time(spark, tmp_path, turns):
    rng = random.Random(6)
    shuffled = sorted(turns, key=lambda r: r[1].timestamp() + rng.uniform(0, 60))
    for k, size in enumerate((9, 40)):
        batches = [shuffled[i : i + size] for i in range(0, len(turns), size)]
        got = run(spark, lambda s: state.session_turns(s, "2 minutes"), batches, TURNS, tmp_path, f"h{k}")
        assert sorted(map(tuple, got.collect())) == told(turns)


def test_late_turns_are_reported_and_change_nothing(spark, tmp_path, turns):
    late = ("s1", at(5), "too late", "x", True, False)
    got = run(spark, lambda s: state.session_turns(s, "1 minute"), [turns[:20], turns[20:], [late]], TURNS, tmp_path, "late").collect()
    assert [tuple(r) for r in got if r.late] == [("s1", None, None, "too late", True, True)]
    assert sorted(tuple(r) for r in got if not r.late) == told(turns)


def test_a_pause_ends_a_session(spark, tmp_path):
    rows = [("s", at(0), "a", "A", True, False), ("s", at(50), "b", "B", True, False), ("s", at(200), "c", "C", True, False)]
    for k, batches in enumerate(([rows], [rows[:2], rows[2:]])):
        got = run(spark, lambda s: state.session_turns(s, "10 seconds", idle_seconds=100), batches, TURNS, tmp_path, f"p{k}")
        assert sorted((r.question, r.turn_id, r.history) for r in got.collect()) == [("a", 1, ""), ("b", 2, "user: a\nagent: A"), ("c", 1, "")]


def test_admission_in_order_of_time(spark, tmp_path):
    rng = random.Random(7)
    calls = [(f"a{i % 3}", at(10 * i), i, float(rng.randint(1, 9))) for i in range(30)]
    spent, want = {}, []
    for account, _, i, amount in calls:
        fits = spent.get(account, 0.0) + amount <= 20 + 1e-12
        spent[account] = spent.get(account, 0.0) + (amount if fits else 0.0)
        want.append((account, i, fits, spent[account], False))
    shuffled = sorted(calls, key=lambda r: r[1].timestamp() + rng.uniform(0, 50))
    got = run(spark, lambda s: state.admitted_calls(s, 20.0, delay="1 minute"), [shuffled[:11], shuffled[11:17], shuffled[17:]], CALLS, tmp_path, "adm")
    assert sorted(map(tuple, got.collect())) == sorted(want)


RESERVED, SETTLED = "attempt_id long, ts timestamp, reserved double", "attempt_id long, ts timestamp, accounted double, usage_unknown boolean"


def test_settlements_meet_their_reservations_over_restarts(spark, tmp_path):
    reserved = [(i, at(60 * i), 1.0 + i) for i in range(12)]
    settled = [(i, at(60 * i + 20), 0.5 * i, False) for i in range(12) if i % 3] + [(4, at(60 * 4 + 30), 99.0, False)]
    settled.sort(key=lambda r: r[1])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    feeds = {name: str(tmp_path / name) for name in ("reserved", "settled")}
    cut = lambda rows, k: [r for r in rows if (r[1] - START).total_seconds() // 240 == k]
    for k in range(3):  # three starts of the query from one checkpoint
        deal(spark, [spark.createDataFrame(cut(reserved, k), RESERVED)], "ts", feeds["reserved"], first=2 * k, heartbeat=k == 2)
        deal(spark, [spark.createDataFrame(cut(settled, k), SETTLED)], "ts", feeds["settled"], first=2 * k, heartbeat=k == 2)
        left = spark.readStream.schema(RESERVED).parquet(f"{feeds['reserved']}/part-*")
        right = spark.readStream.schema(SETTLED).parquet(f"{feeds['settled']}/part-*")
        got = state.run_available(state.settled_attempts(left, right, "5 minutes", "2 minutes"), out, checkpoint)
    events = [{"event": "reserve", "attempt_id": i, "time_utc": t, "reserved": r} for i, t, r in reserved]
    events += [{"event": "settle", "attempt_id": i, "accounted": a, "usage_unknown": u} for i, _, a, u in settled if a != 99.0]
    kind = "event string, attempt_id long, time_utc timestamp, reserved double, accounted double, usage_unknown boolean, prompt_tokens long, completion_tokens long, cached_tokens long"
    want = ledger.receipts(spark.createDataFrame(events, kind)).select("attempt_id", "upper").collect()
    assert sorted(map(tuple, got.select("attempt_id", "upper").collect())) == sorted(map(tuple, want))
    assert {r.attempt_id for r in got.where("accounted IS NULL").collect()} == {0, 3, 6, 9}


def test_percentiles_of_windows_are_within_their_bound(spark, tmp_path):
    rng = random.Random(8)
    rows = [(at(rng.uniform(0, 3600 * 5)), rng.random() > 0.2, 10 ** rng.uniform(-2, 5)) for _ in range(600)]
    rows.sort(key=lambda r: r[0].timestamp() + rng.uniform(0, 600))
    kind = "ts timestamp, ok boolean, ms double"
    got = run(spark, lambda s: state.service_windows(s, "1 hour", "20 minutes"), [rows[i : i + 150] for i in range(0, 600, 150)], kind, tmp_path, "slo").collect()
    assert len(got) == 5 and sum(r.n for r in got) == 600
    for r in got:
        good = sorted(ms for ts, ok, ms in rows if ok and ts.replace(minute=0, second=0, microsecond=0) == r.day)
        for p, found in ((0.5, r.p50_ms), (0.9, r.p90_ms)):
            exact = good[-(-int(p * 1000) * len(good) // 1000) - 1]
            assert abs(found - exact) <= exact / 128 + 0.001


def test_counts_of_windows_have_few_states_whatever_the_shuffle_partitions(spark, tmp_path, monkeypatch):
    rows = [(i, at(600 * i), float(i % 50)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(state_queries, "shared_folder", lambda _, name: str(tmp_path / name))
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        got = state_queries.q43_stream_service_windows(spark, str(tmp_path)).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert {r.day.date(): r.n for r in got} == collections.Counter(ts.date() for _, ts, _ in rows) and len(got) == 5
    assert {len(glob.glob(f"{tmp_path}/stream/checkpoint/state/{k}/[0-9]*")) for k in (0, 1)} == {8}


def test_shards_have_a_bounded_number_of_partitions(spark, tmp_path, monkeypatch):
    rows = [(i, i % 13, at(60 * i), float(i % 50)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(state_queries, "shared_folder", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(state, "SHARD_PARTITIONS", 3)  # the session has 4
    got = state_queries.q44_stream_admission(spark, str(tmp_path)).collect()
    spent, want = {}, set()
    for i, user, _, value in rows:
        fits = spent.get(user, 0.0) + value <= 500 + 1e-12
        spent[user] = spent.get(user, 0.0) + (value if fits else 0.0)
        want.add((user, i, fits, spent[user]))
    assert set(map(tuple, got)) == want and len(got) == 400
    assert len(glob.glob(f"{tmp_path}/stream/checkpoint/state/0/[0-9]*")) == 3


def test_latency_buckets(spark):
    values = [0.0, 0.001, 0.127, 0.128, 1.0, 12.345, 99999.9, -3.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "ms double").select(state.latency_bucket(F.col("ms"))).collect()]
    for v, b in zip(values, got, strict=True):
        us = max(0, int(v * 1000 + 1e-6))
        assert b <= us and (us - b) * 64 <= us
