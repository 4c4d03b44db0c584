import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.operators import evalset
from corpusloom.plans import jobs


def test_evidence_groups(spark):
    flat = spark.createDataFrame([("q", 0, "d2", "f2", "s0"), ("q", 1, "d1", "f1", "s1"), ("q", 2, "d2", "other", "s2")], "question_id string, pos int, doc_id string, file string, span_id string")
    got = evalset.group_evidence(flat, "question_id", ["file"], ["span_id"]).first().evidence
    assert [(e.doc_id, e.file, [s.span_id for s in e.spans]) for e in got] == [("d2", "f2", ["s0", "s2"]), ("d1", "f1", ["s1"])]


def test_reviews_and_items(spark):
    c = spark.createDataFrame([("a", "own", "x"), ("b", "own", "y")], "question_id string, gold string, note string")
    r = spark.createDataFrame([("a", "=SOURCE"), ("b", "new")], "question_id string, gold string")
    assert {x.question_id: x.gold for x in evalset.reviewed(c, r, "question_id", ["gold"]).collect()} == {"a": "own", "b": "new"}
    with pytest.raises(Exception, match="no review"):
        evalset.reviewed(c, r.limit(1), "question_id", ["gold"]).collect()
    v = spark.createDataFrame([("approved", "answer", "q"), ("pending", "maybe", " ")], "status string, label string, question string")
    bad = v.select(evalset.review_violations({"status": F.col("status"), "label": F.col("label"), "question": F.col("question")}, ["question"]).alias("x")).collect()
    assert [b.x for b in bad] == [[], ["not_approved", "unknown_label", "empty_question"]]


def test_release_rules(spark):
    kind = "question_id string, dialogue_id string, label string"
    dev, holdout = spark.createDataFrame([("1", "a", "answer"), ("2", "b", "refuse")], kind), spark.createDataFrame([("3", "c", "answer"), ("4", "d", "refuse")], kind)
    run = lambda d, h, s, e: {r.rule for r in evalset.release_rules(d, h, s, e, {"answer": 1, "refuse": 1}).where("violations > 0").collect()}
    none = dev.select("dialogue_id").limit(0)
    assert run(dev, holdout, dev.limit(1), none) == set()
    assert run(dev, holdout, dev.withColumn("label", F.lit("x")), none) == {"smoke_not_in_dev"}
    assert run(dev, holdout, dev, spark.createDataFrame([("c",)], "dialogue_id string")) == {"exposed_holdout"}
    assert run(dev, spark.createDataFrame([("1", "a", "answer"), ("4", "d", "refuse")], kind), dev, none) == {"repeated_question", "repeated_dialogue", "shared_dialogue"}
    assert run(dev, holdout.limit(1), dev, none) <= {"quota_holdout_answer", "quota_holdout_refuse"} and run(dev, holdout.limit(1), dev, none)


def test_bundles_and_reuse(spark):
    cases = spark.createDataFrame([("m", "q1", "ok", "r", [("c1",), ("c1",)]), ("m", "q3", "failed", "r", [])], "candidate string, question_id string, status string, response string, contexts array<struct<chunk_id:string>>")
    q = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    assert {r.rule: r.violations for r in evalset.bundle_rules(cases.select("candidate"), q, cases).collect()} == {"missing": 1, "unplanned": 1, "repeated": 0, "repeated_context": 1, "response_without_ok": 1}
    before = spark.createDataFrame([("q1", "m", "h"), ("q2", "m", "h")], "question_id string, messages string, request_hash string")
    after = spark.createDataFrame([("q1", "m", "h"), ("q2", "changed", "h")], "question_id string, messages string, request_hash string")
    assert [r.question_id for r in evalset.reusable(before, after).collect()] == ["q1"]


def fake():
    return lambda texts: [[float(len(t)), float(sum(map(ord, t)) % 1000)] for t in texts]


def test_index_job(spark):
    docs = spark.createDataFrame([("d", "# A\nfirst text here\n\n# B\nsecond text here\n")], "doc_id string, text string")
    blocks = spark.createDataFrame([("d", 0, "b0", "first text here"), ("d", 1, "b1", "not there")], "doc_id string, block_ix int, block_id string, text string")
    stored = spark.createDataFrame([("[B]\nsecond text here", 0, "v0", [9.0, 9.0])], "text string, position int, vector_id string, v array<float>")
    out = jobs.build_index(docs, blocks, models.embedder(fake), stored, budget=4)
    chunks = {r.chunk_id: r.text for r in out["chunks"].collect()}
    assert chunks == {"d::c0000": "[A]\nfirst text here", "d::c0001": "[B]\nsecond text here"}
    vectors = {r.chunk_id: (r.reused, list(r.v)) for r in out["vectors"].collect()}
    assert vectors["d::c0001"] == (True, [9.0, 9.0]) and vectors["d::c0000"] == (False, fake()([chunks["d::c0000"]])[0])
    assert {r.rule: r.violations for r in jobs.check_vectors(out["vectors"], out["chunks"], 2).collect()} == {"dimension": 0, "finite": 0, "unique_key": 0, "without_vector": 0, "without_chunk": 0}
    assert [(r.chunk_id, r.block_id, r.end - r.start == r.length) for r in out["spans"].collect()] == [("d::c0000", "b0", True)]


def test_models(spark):
    df = spark.createDataFrame([("a b", "b c"), ("x", "y")], "q string, p string")
    score = models.pair_scorer(lambda: lambda pairs: [len(set(a.split()) & set(b.split())) for a, b in pairs])
    assert [r.s for r in df.select(score("q", "p").alias("s")).collect()] == [1.0, 0.0]

    def make():
        def call(m):
            if m == "x":
                raise RuntimeError
            return json.dumps({"got": m})

        return call

    assert [r.g for r in df.select(models.generator(make)("q").alias("g")).collect()] == ['{"got": "a b"}', None]
    models.register("metric", "one", len)
    with pytest.raises(ValueError):
        models.register("metric", "one", len)


def test_report(spark):
    cases = spark.createDataFrame([("m", "a", "ok", "answer"), ("m", "b", "ok", "refuse")], "candidate string, question_id string, status string, label string")
    verdicts = spark.createDataFrame([("m", "a", "correctness", "ok", 1.0)], "candidate string, question_id string, metric string, status string, score double")
    got = {r.group: (r.n, r.correctness_lo, r.target_status) for r in jobs.report(cases, verdicts, 0.5).collect()}
    assert got == {"(all)": (2, 0.5, "met"), "answer": (1, 1.0, "met"), "refuse": (1, 0.0, "indeterminate_due_to_unknown_scores")}
    table = jobs.report(cases, verdicts, 0.5)
    assert jobs.differs(table, table).count() == 0
