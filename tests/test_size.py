"""Steps that must not repeat work, or hold more, as tables grow."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators import evidence, retrieval, sections
from corpusloom.streaming import feed, state


def test_clean_tidies_each_text_once(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\\[x\\]\n\n\n\nb \\$ \n## 菜单中显示\nc\n# D\n"), (2, None), (3, "")], "doc_id int, text string")
    out = sections.clean(docs, normalise=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" ") <= 2  # of the heading and of the text
    got = {r.doc_id: (r.cleaned, r.sections_dropped) for r in out.collect()}
    assert got[1] == ("intro\n\n# A[x]\n\nb $\n\n# D\n", 1) and got[3] == ("", 0)


def test_blocks_are_found_in_slices_of_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else f"x{'ab' * i} ab", "en") for i in range(40)], "doc_id long, text string, lang string").coalesce(1)
    blocks = spark.createDataFrame([(1, "ab"), (2, " ab"), (3, "ab"), (4, "")], "block_id long, text string")
    monkeypatch.setattr(evidence, "SLICE", 7)
    got = sorted(map(tuple, evidence.find_verbatim(docs, blocks, ["lang"]).collect()))
    texts = [(r.doc_id, r.text) for r in docs.where(F.col("text").isNotNull()).collect()]
    want = [(d, b, t.index(x), t.index(x) + len(x), len(t), "en") for d, t in texts for b, x in [(1, "ab"), (2, " ab"), (3, "ab")] if x in t]
    assert got == sorted(want)


def test_blocks_are_located_in_one_pass_without_gathering(spark):
    docs = spark.createDataFrame([(1, "Ab cd. Ab ef. Gh"), (2, None), (4, "ｆｕｌｌ")], "doc_id long, text string")
    rows = [(1, 0, "Ab"), (1, 1, "ef."), (1, 2, "Ab"), (1, 3, "none"), (1, 4, ""), (1, 5, None), (1, 6, "Gh"), (2, 0, "x"), (3, 0, "y"), (4, 0, "full")]
    found = evidence.locate_blocks(docs, spark.createDataFrame([(d, i, i, t) for d, i, t in rows], "doc_id long, block_ix int, block_id int, text string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(1, "0", 0, 2, 2), (1, "1", 7, 10, 3), (1, "2", 0, 2, 2), (1, "3", None, None, 4), (1, "4", None, None, 0), (1, "5", None, None, None), (1, "6", 10, 12, 2), (2, "0", None, None, 1), (4, "0", 0, 4, 4)}
    assert set(map(tuple, found.collect())) == want


def test_keys_share_states_and_parts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHARDS", 2)
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    calls = [(f"a{i % 13}", start + dt.timedelta(seconds=i), i, None if i % 29 == 0 else float(rng.randint(1, 9))) for i in range(240)]
    spent, want = {}, []
    for account, _, i, amount in calls:
        fits = None if amount is None else spent.get(account, 0.0) + amount <= 40 + 1e-12
        spent[account] = spent.get(account, 0.0) + (amount if fits else 0.0)
        want.append((account, i, fits, spent[account], False))
    late = ("a1", start + dt.timedelta(seconds=5), 999, 1.0)
    kind = "account string, ts timestamp, call_id long, amount double"
    parts = [spark.createDataFrame(rows, kind) for rows in (calls[:100], calls[100:220], [*calls[220:], late])]
    at = feed.deal(spark, parts, "ts", str(tmp_path / "in"), files=3)
    assert [len(list((tmp_path / "in" / f"part-{k:05d}").glob("*.parquet"))) for k in range(4)] == [3, 3, 3, 1]
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(at)
    got = state.run_available(state.admitted_calls(stream, 40.0, delay="20 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert set(map(tuple, got.collect())) == {*want, ("a1", 999, False, None, True)}
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(str(tmp_path / "cp"))
    assert kept.count() == 2


def test_sessions_of_one_state_end_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SHARDS", 1)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("s", at(0), "a", "A", True, False), ("t", at(40), "x", "X", True, False), ("s", at(50), "b", "B", True, False), ("t", at(130), "y", "Y", True, False), ("s", at(200), "c", "C", True, False)]
    kind = "session_id string, ts timestamp, question string, answer string, ok boolean, reset boolean"
    folder = feed.deal(spark, [spark.createDataFrame(rows[:3], kind), spark.createDataFrame(rows[3:], kind)], "ts", str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    got = state.run_available(state.session_turns(stream, "10 seconds", idle_seconds=100), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.question, r.turn_id, r.history) for r in got.collect()) == [("a", 1, ""), ("b", 2, "user: a\nagent: A"), ("c", 1, ""), ("x", 1, ""), ("y", 2, "user: x\nagent: X")]


def test_bm25_splits_texts_where_they_lie(spark, monkeypatch):
    texts = ["a b c a", " a\tb ", "c d e\n", "", None, "a a　a f", "​c d"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tokens = docs.select("doc_id", words(F.col("text")).alias("tokens"))
    asked = spark.createDataFrame([("x", ["c", "c", "f"]), ("y", ["a"]), ("z", ["zz"])], "qid string, tokens array<string>")
    monkeypatch.setattr(retrieval, "CELLS", 6)  # slices of three passages
    by_shuffle = sorted(map(tuple, retrieval.bm25_top_k(asked, tokens, 4, asked_rows=0).collect()))
    for given in (docs, tokens):
        top = retrieval.bm25_top_k(asked, given, 4)
        assert "explode" not in top._jdf.queryExecution().optimizedPlan().toString().lower() and "Join" not in top._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, top.collect())) == by_shuffle
    assert len(by_shuffle) == 8
