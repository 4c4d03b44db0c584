import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import money
from corpusloom.functions import text as T
from corpusloom.operators import chunking, evalset, evidence, ledger, sampling
from corpusloom.sources import writers


def test_retrieval_summary_and_rank_quality(spark):
    scores = spark.createDataFrame([("a", 1, 1.0, 1, 0.5, 10, 2, 0.1), ("b", 1, 0.5, 0, 0.0, 20, 2, 0.3), ("c", 0, 0.0, 0, 0.0, 0, 0, 0.2)], "question_id string, any_hit int, block_recall double, all_hit int, precision double, context_tokens int, chunks_returned int, retrieval_seconds double")
    r = evidence.retrieval_summary(scores).first()
    assert (r.answer_n, r.any_full_block_hit, r.all_full_blocks_hit, r.mean_block_recall, r.mean_context_tokens, r.p50_retrieval_seconds) == (3, 2, 1, 0.5, 10.0, 0.2)
    assert evidence.retrieval_summary(scores.limit(0)).first().any_full_block_hit == 0
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 11), (1, 8, 3)], "qid int, id int, rank int")
    relevant = spark.createDataFrame([(1, 8), (1, 5), (1, 5), (2, 9), (3, 1)], "qid int, id int")
    q = evidence.ranking_quality(ranked, relevant).first()
    assert (q.questions, q.recall, q.mrr) == (3, 0.5 / 3, 0.5 / 3)


def test_acceptance_latencies_and_forecast(spark):
    turns = spark.createDataFrame([("s", 200, "ok"), ("s", 200, "failed"), ("t", 500, "ok")], "session_id string, http_status int, status string")
    load = spark.createDataFrame([(200, 1.0), (200, 12.0), (500, 2.0)], "http_status int, wall_seconds double")
    assert tuple(ledger.acceptance(turns, load).first()) == (3, 1, 2, 3, 2, 1, 12.0)
    t = datetime.datetime(2024, 1, 1)
    marks = spark.createDataFrame([(t, t + datetime.timedelta(milliseconds=250), t + datetime.timedelta(seconds=1))], "a timestamp, b timestamp, c timestamp")
    assert tuple(marks.select(*ledger.stage_latencies({"start": F.col("a"), "retrieval": F.col("b"), "generation": F.col("c")})).first()) == (250.0, 750.0, 1000.0)
    model = next(iter(money.TARIFF))
    cost = spark.createDataFrame([("é" * 10, 100)], "m string, n long").select(money.forecast(model, F.col("m"), F.col("n"), 3).alias("x")).first().x
    assert cost == pytest.approx(3 * (1044 * money.TARIFF[model][1] + 100 * money.TARIFF[model][2]) / 1e6)


def test_admission_in_order(spark):
    draw = random.Random(5)
    rows = [(k, i, draw.choice([0.5, 1.0, 4.0, None])) for k in (None, 1, 2) for i in range(300)]
    draw.shuffle(rows)
    got = {(r.k, r.ordinal): (r.admitted, r.spent) for r in ledger.admit(spark.createDataFrame(rows, "k int, ordinal int, amount double"), "k", 60.0).collect()}
    want = {}
    for k in (None, 1, 2):
        spent = 0.0
        for _, i, a in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            fits = None if a is None else spent + a <= 60.0 + ledger.TOLERANCE
            spent += a if fits else 0.0
            want[k, i] = (fits, spent)
    assert got == want
    assert ledger.admit(spark.createDataFrame([], "k int, ordinal int, amount double"), "k", 1.0).count() == 0


def test_release_rows(spark):
    docs = spark.createDataFrame([([("pdf",), ("md",)],), ([],), (None,)], "docs array<struct<format:string>>")
    assert [r.f for r in docs.select(evalset.document_format(F.col("docs")).alias("f")).collect()] == ["pdf", "unknown", "unknown"]
    inputs = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert tuple(evalset.distinct_inputs(inputs, "x", "y").first()) == (3, 2)
    before = spark.createDataFrame([("dev", 0, "x", 1), ("dev", 1, "y", 2), ("dev", 2, None, 3)], "split string, ordinal int, label string, n int")
    after = spark.createDataFrame([("dev", 0, "x", 1), ("dev", 1, "z", 2), ("dev", 2, None, 3), ("dev", 3, "w", 4)], "split string, ordinal int, label string, n int")
    got = {r.ordinal: (r.changed_fields, r.before_sha256 is None) for r in evalset.changed_rows(before, after, ["split", "ordinal"]).collect()}
    assert got == {1: (["label"], False), 3: (["label", "n"], True)}
    plan, done = spark.createDataFrame([(i,) for i in range(6)], "task int"), spark.createDataFrame([(0,), (2,)], "task int")
    assert [(r.task, r.planned) for r in sampling.next_tasks(plan, done, ["task"], "task", 2).orderBy("task").collect()] == [(1, 6), (3, 6)]


def test_nested_payloads(spark):
    kind = "p struct<note:string,`Api-Key`:string,inner:array<struct<password:int,who:string>>,head:map<string,string>,n:int>"
    df = spark.createDataFrame([(("mail a@b.co", "k", [(7, "call 555-123-4567")], {"AUTHORIZATION": "Bearer", "x": "a@b.co"}, 4),), (None,)], kind)
    got = df.select(T.redact_payload(F.col("p"), df.schema["p"].dataType).alias("p")).collect()
    p = got[0].p.asDict(True)
    assert p == {"note": "mail [EMAIL]", "Api-Key": "[REDACTED]", "inner": [{"password": None, "who": "call [PHONE]"}], "head": {"AUTHORIZATION": "[REDACTED]", "x": "[EMAIL]"}, "n": 4} and got[1].p is None


def test_interrupted_replacement(spark, tmp_path):
    path = tmp_path / "v"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    writers.replace_changed(df, str(path), "k", ["v"])
    path.rename(str(path) + ".before")  # as a call leaves it that ends between its two moves
    assert writers.replace_changed(df, str(path), "k", ["v"]) == 0 and spark.read.parquet(str(path)).count() == 1
    assert writers.replace_changed(df.withColumn("v", F.lit("b")), str(path), "k", ["v"]) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["v"]


def test_chunks_by_a_given_tokeniser():
    letters = lambda text: [i for i, c in enumerate(text) if not c.isspace()]
    pieces = chunking.split_to_size("abc def. ghi\n\njkl mno", 6, letters)
    assert "".join("".join(pieces).split()) == "abcdef.ghijklmno" and all(len(letters(p)) <= 6 for p in pieces)
    assert chunking.split_to_size("x" * 10, 4, letters) == ["xxxx", "xxxx", "xx"]
    assert chunking.split_to_size("a\n\n\nb c", 2) == ["a", "b c"]
    assert chunking.subtree_ends([0, 1, 2, 2, 1, 3]) == [6, 4, 3, 4, 6, 6]
    sections = [(0, None, "intro"), (1, "A", "a " * 30), (2, "B", "b " * 30), (3, "C", "c"), (2, "D", ""), (1, "E", "e")]
    got = list(chunking.section_chunks(sections, 20))
    assert {tuple(p) for p, _ in got[:-2]} == {("A", "B", "C")} and [p for p, _ in got[-2:]] == [["A", "D"], ["E"]] and got[-2][1] == "[A]\nD"
    words = " ".join(t for _, t in got).split()
    assert words.count("a") == 30 and words.count("b") == 30 and "intro" in words and "c" in words


def test_quality_by_label_is_that_of_its_pairs(spark):
    """A label of 30,000 ids and 1,500 questions has 45,000,000 pairs; without them a few thousand rows are joined."""
    rank = spark.range(0, 30_000, 20).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"))
    top = rank.select("qid", ((F.col("qid") + F.col("rank") * F.col("rank") - 1) % 30_100).alias("id"), "rank")  # the question itself too
    for kinds in (1, 7, 15_000):
        labels = spark.range(30_100).select("id", F.when(F.col("id") % 97 != 5, F.col("id") % kinds).alias("label"))
        asked = labels.where("id < 30000 AND id % 20 = 0").withColumnRenamed("id", "qid")
        got = evidence.ranking_quality_by_label(top, asked, labels, 3).first()
        if kinds > 1:
            pairs = asked.join(labels, "label").where("id <> qid").select("qid", "id")
            want = evidence.ranking_quality(top.where("id <> qid"), pairs, 3).first()
            assert (got.questions, round(got.recall, 12), round(got.mrr, 12)) == (want.questions, round(want.recall, 12), round(want.mrr, 12))
        else:
            assert got.questions == asked.where("label IS NOT NULL").count()
