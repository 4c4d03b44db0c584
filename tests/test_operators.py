import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, chunking, evidence, integrity, judging, layout, ledger, retrieval, sampling, selection


def test_splitting_loses_nothing():
    for text, budgets in (("驾驶员必须联系当地法院处理罚款。" * 20, (1, 7, 64)), ("支付罚款。不要忽略法院通知！联系当地法院？" * 10, (20,)), ("one two three, four. " * 30, (3, 10))):
        for b in budgets:
            pieces = chunking.split_to_size(text, b)
            assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
            assert all(chunking.count_words(p) <= b for p in pieces)
    with pytest.raises(ValueError):
        chunking.split_to_size("x", 0)


def test_bare_headings():
    sections = [(1, "Required good-cause condition", ""), (1, "Other", "Other details. " * 100)]
    new = list(chunking.section_chunks(sections, 32))
    old = list(chunking.section_chunks(sections, 32, keep_bare_headings=False))
    assert new[0] == (["Required good-cause condition"], "Required good-cause condition") and len(new) == len(old) + 1
    lead = list(chunking.section_chunks([(1, "A", "lead text " * 20), (2, "B", "b"), (2, "C", "c " * 40)], 20))
    assert lead[0][0] == ["A", "B"] and "lead text" in lead[0][1] and "lead text" not in lead[-1][1]


def test_packing():
    assert chunking.pack(["a b", "c d", " ", "e"], 3) == ["a b", "c d\n\ne"]
    assert chunking.pack(["a b c", "d e f"], 4, overlap=1) == ["a b c", "c\n\nd e f"]
    assert chunking.with_overlap(["a b", "c"], 1) == ["a b", "b\n\nc"]


def spans(spark, rows):
    return spark.createDataFrame(rows, "k int, start int, end int")


def test_interval_union(spark):
    got = {r.k: r.covered for r in evidence.union_length(spans(spark, [(1, 0, 5), (1, 5, 9), (1, 2, 3), (2, 0, 4), (2, 6, 8), (2, 6, 6), (3, 1, 9), (3, 2, 4), (3, 3, 10)]), ["k"]).collect()}
    assert got == {1: 9, 2: 6, 3: 9}
    merged = spark.sql("SELECT array(named_struct('start', 5, 'end', 9), named_struct('start', 0, 'end', 5), named_struct('start', 20, 'end', 20), named_struct('start', 11, 'end', 12)) AS s").select(evidence.merged_intervals(F.col("s")).alias("m")).first().m
    assert [tuple(x) for x in merged] == [(0, 9), (11, 12)]


def test_blocks_and_coverage(spark):
    text = "First condition applies. Second condition also applies. The fee is 200 dollars and it is due at once."
    docs = spark.createDataFrame([("d", f"# H\n- {text[:24]}\n- {text[25:]}")], "doc_id string, text string")
    blocks = spark.createDataFrame([("d", 0, "b0", text[:24]), ("d", 1, "b1", text[25:]), ("d", 2, "b2", "The fee is 500 dollars")], "doc_id string, block_ix int, block_id string, text string")
    found = {r.block_id: r for r in evidence.locate_blocks(docs, blocks).collect()}
    assert found["b0"].start is not None and found["b1"].start >= found["b0"].end and found["b2"].start is None
    chunks = spark.createDataFrame([("d", "c1", text[25:60]), ("d", "c2", text[60:]), ("d", "c3", text[:24])], "doc_id string, chunk_id string, text string")
    runs = evidence.chunk_runs(docs, chunks)
    over = evidence.overlaps(runs, evidence.locate_blocks(docs, blocks).where("start IS NOT NULL"))
    targets = spark.createDataFrame([("q", "d", "b1"), ("r", "d", "b1"), ("s", "d", "b1")], "question_id string, doc_id string, block_id string")
    returned = spark.createDataFrame([("q", "d", "c1", 5), ("r", "d", "c1", 5), ("r", "d", "c2", 7)], "question_id string, doc_id string, chunk_id string, token_count int")
    got = {r.question_id: (r.any_hit, r.block_recall, r.all_hit, r.precision, r.context_tokens, r.chunks_returned) for r in evidence.window_scores(returned, over, targets).collect()}
    assert got == {"q": (0, 0.0, 0, 0.0, 5, 1), "r": (1, 1.0, 1, 0.0, 12, 2), "s": (0, 0.0, 0, 0.0, 0, 0)}


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float((i * j) % 7 + 1) for j in range(1, 4)]) for i in range(40)], "id long, v array<float>")
    q = v.where("id % 4 = 0").select(F.col("id").alias("qid"), "v")
    want = sorted(retrieval.dense_top_k(q, v, 3).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(retrieval.dense_top_k(q, v, 3).collect()) == want and len(want) == 30


def test_bm25(spark):
    import math

    texts = {0: "a b c a", 1: "a b", 2: "c d e", 3: "", 4: "a a a f"}
    docs = spark.createDataFrame([(i, t.split()) for i, t in texts.items()] + [(5, [None, "a"]), (6, None)], "doc_id long, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(1, ["c", "c", "f"]), (2, ["a"]), (3, ["zz"]), (4, [])], "qid long, tokens array<string>")
    words = {**{i: t.split() for i, t in texts.items()}, 5: [None, "a"]}
    n, mean = 7, sum(map(len, words.values())) / 6
    df = {t: sum(t in w for w in words.values()) for t in "abcdef"}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(idf.values()) / len(idf) for t, x in idf.items()}
    want = {}
    for qid, terms in ((1, ["c", "c", "f"]), (2, ["a"])):
        for d, w in words.items():
            score = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
            if score > 0:
                want[qid, d] = round(score, 6)
    for asked_rows in (0, 1000):
        got = {(r.qid, r.doc_id): r.score for r in retrieval.bm25_top_k(asked, docs, 10, asked_rows=asked_rows).collect()}
        assert got == pytest.approx(want)
    assert retrieval.bm25_top_k(asked, docs.where("doc_id < 0"), 10).isEmpty()


def test_ranking(spark):
    v = spark.createDataFrame([(i, [float(x) for x in xs]) for i, xs in enumerate([(1, 0), (0, 1), (2, 0), (1, 1)])], "id long, v array<float>")
    q = v.where("id = 0").select(F.col("id").alias("qid"), "v")
    assert [(r.id, r.rank) for r in retrieval.dense_top_k(q, v, 3).orderBy("rank").collect()] == [(0, 1), (2, 2), (3, 3)]
    lists = [spark.createDataFrame([(1, i, r) for r, i in enumerate(ids, 1)], "qid int, id int, rank int") for ids in ((7, 8, 9), (9, 8, 5))]
    fused = [(r.id, round(r.score, 9)) for r in retrieval.fuse([(x, 1.0) for x in lists], 4).orderBy("rank").collect()]
    assert [i for i, _ in fused] == [9, 8, 7, 5] and fused[0][1] == round(1 / 63 + 1 / 61, 9)
    pairs = spark.createDataFrame([(1, 10, 1, ["a", "b"], ["x"] * 400 + ["a", "b"]), (1, 11, 2, ["a", "b"], ["a"]), (1, 12, 3, ["a", "b"], ["a", "b"])], "qid int, id int, rank int, query array<string>, tokens array<string>")
    assert [r.id for r in retrieval.window_rerank(pairs, 3).orderBy("new_rank").collect()] == [10, 12, 11]
    assert [r.id for r in retrieval.window_rerank(pairs, 3, windowed=False).orderBy("new_rank").collect()] == [12, 11, 10]


def test_vector_reuse(spark):
    stored = spark.createDataFrame([("old text", 0, "v0"), ("same", 1, "v1"), ("same", 2, "v2")], "text string, position int, vector_id string")
    chunks = spark.createDataFrame([("c1", "new text"), ("c2", "same")], "chunk_id string, text string")
    assert {r.chunk_id: r.reused_id for r in retrieval.reuse_by_text(chunks, stored).collect()} == {"c1": None, "c2": "v2"}


def test_gate_citations_and_traces(spark):
    row = lambda q, chunks, score, raw: (q, [], chunks, score, raw)
    good = lambda ids, action="answer": json.dumps({"answer": "yes", "citations": ids, "action": action})
    c = [("c1", "text")]
    rows = [row("q", c, 0.9, good(["c1"])), row("q", c, 0.9, good([])), row("q", c, 0.9, good(["c1", "made"])), row("q", c, 0.9, good([], "clarify")), row("q", [], 0.0, ""), row("问", c, 0.1, ""), row(" ", c, 0.9, good(["c1"])), row("q", c, 0.9, '{"answer": 1}')]
    df = spark.createDataFrame(rows, "question string, history array<struct<role:string,utterance:string>>, chunks array<struct<chunk_id:string,text:string>>, top_dense double, recorded string")
    got = answers.answer(df, lambda m: F.when(m.isNotNull(), F.col("recorded"))).collect()
    assert [(r.status, r.error_type, r.refusal_reason, r.citation_check) for r in got] == [
        ("ok", None, None, "ok"), ("failed", "citation_failed", None, "failed"), ("failed", "citation_failed", None, "failed"), ("ok", None, None, "ok"),
        ("ok", None, "no_retrieval_results", "not_applicable"), ("ok", None, "low_retrieval_confidence", "not_applicable"), ("failed", "invalid_input", None, "not_evaluated"), ("failed", "generation_failed", None, "not_evaluated"),
    ]
    assert got[5].response.answer == answers.REFUSAL_ZH and got[5].contexts == [] and len(got[5].retrieval_contexts) == 1
    with pytest.raises(ValueError):
        answers.Limits(question_characters=0)


def test_judging(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 1), (2, 2, None), (3, 1, 0)], "q int, rank int, verdict int")
    assert {r.q: r.score for r in judging.average_precision(v, ["q"]).collect()} == {1: (1 + 2 / 3) / 2, 2: None, 3: 0.0}
    raws = ['{"verdict": 1, "reason": "r"}', '{"reason": "r", "verdict": 0}', '{"verdict": true, "reason": "r"}', '{"verdict": 2, "reason": "r"}', '{"verdict": "1", "reason": "r"}', '{"verdict": 1, "reason": " "}', '{"verdict": 1}']
    assert [r.x for r in spark.createDataFrame([(x,) for x in raws], "t string").select(judging.relevance_verdict(F.col("t")).alias("x")).collect()] == [1, 0, None, None, None, None, None]
    cases = spark.createDataFrame([("m", "a", "ok", "answer"), ("m", "b", "failed", "answer"), ("m", "c", "ok", "clarify")], "candidate string, question_id string, status string, label string")
    verdicts = spark.createDataFrame([("m", "a", "correctness", "ok", 1.0), ("m", "a", "faithfulness", "ok", None), ("m", "c", "faithfulness", "ok", 0.5), ("m", "c", "correctness", "failed", 1.0)], "candidate string, question_id string, metric string, status string, score double")
    r = judging.summary(cases, verdicts, ["candidate"]).first()
    assert (r.n, r.failures, r.unknown, r.correctness_lo, r.correctness_hi) == (3, 1, 1, 1 / 3, 2 / 3)
    assert (r.no_fact, r.faith_n, r.faith_unknown, r.faithfulness_lo, r.cp_unknown, r.context_precision_lo, r.context_precision_hi) == (1, 1, 0, 0.5, 2, 0.0, 1.0)
    none = judging.summary(cases.where("status = 'ok'"), verdicts.limit(0), ["candidate"]).first()
    assert (none.unknown, none.correctness_lo, none.correctness_hi, none.faithfulness_lo, none.faithfulness_hi) == (2, 0.0, 1.0, 0.0, 1.0)


def test_scoped_claims(spark):
    kind = "array<struct<text:string,scope:string,supported:boolean,ids:array<string>,reason:string>>"
    unit = lambda text="fee is 5", scope="external_fact", supported=True, ids=("c1",), reason="r": (text, scope, supported, list(ids), reason)
    cases = [([unit(), unit("ok", "non_assertion", None, ())], True), ([unit("not there")], False), ([unit(), unit()], False), ([unit(supported=False)], False), ([unit(ids=("zz",))], False), ([unit(scope="non_assertion")], False), ([unit(reason=" ")], False), ([], True)]
    df = spark.createDataFrame([(u,) for u, _ in cases], f"u {kind}")
    got = df.select(judging.units_valid(F.col("u"), F.lit("the fee is 5, ok"), F.array(F.lit("c1"))).alias("v"), judging.faithfulness(F.col("u")).alias("f"), judging.excluded_scopes(F.col("u")).alias("e")).collect()
    assert [r.v for r in got] == [v for _, v in cases] and got[0].f == 1.0 and got[-1].f is None and got[0].e == {"non_assertion": 1}


def test_condition_checks(spark):
    kind = "struct<correct:boolean,observed_action:string,behavior_ok:boolean,extra_claims_supported:boolean,checks:array<struct<requirement:string,coverage:string,response_quote:string,reason:string>>,reason:string>"
    check = lambda req="fee", cov="covered", quote="is 5", why="r": (req, cov, quote, why)
    cases = [((True, "answer", True, True, [check()], "r"), True), ((True, "answer", True, True, [check(cov="missing", quote="")], "r"), False), ((False, "answer", True, True, [check(cov="missing", quote="")], "r"), True), ((False, "answer", True, True, [check(cov="missing", quote="is 5")], "r"), False), ((True, "answer", True, True, [check(quote="is 6")], "r"), False), ((True, "answer", True, True, [], "r"), False), ((True, "answer", True, True, [check(), check()], "r"), False), ((True, "shrug", True, True, [check()], "r"), False)]
    df = spark.createDataFrame([(v,) for v, _ in cases], f"v {kind}")
    assert [r.x for r in df.select(judging.checks_valid(F.col("v"), F.lit("answer"), F.lit("the fee is 5")).alias("x")).collect()] == [w for _, w in cases]


def test_ledger(spark):
    e = spark.createDataFrame([("reserve", "a", "1", 2.0, None, None, None, None, None), ("reserve", "b", "2", 3.0, None, None, None, None, None), ("settle", "a", None, None, 0.5, False, 10, 2, 1), ("reserve", "c", "3", 4.0, None, None, None, None, None), ("settle", "c", None, None, 4.0, True, None, None, None)], "event string, attempt_id string, time_utc string, reserved double, accounted double, usage_unknown boolean, prompt_tokens int, completion_tokens int, cached_tokens int")
    r = ledger.spending(ledger.receipts(e)).first()
    assert (r.attempts, r.accounted, r.unknown_usage, r.prompt_tokens, r.first_utc, r.last_utc) == (3, 7.5, 2, 10, "1", "3")
    calls = spark.createDataFrame([(1, i, a) for i, a in enumerate([3.0, 4.0, 5.0, 2.0, 1.0])], "k int, ordinal int, amount double")
    assert [r.admitted for r in ledger.admit(calls, "k", 10.0).orderBy("ordinal").collect()] == [True, True, False, True, True]
    s = ledger.service_level(spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 4.0), (False, 9.0)], "ok boolean, ms double"), F.lit(5), [], 3).first()
    assert (s.p90, s.p50, s.max_ms, s.within) == (3.6, 2.0, 9.0, 0.4)


def test_sampling(spark):
    pool = spark.createDataFrame([(f"i{n}", f"d{n % 7}", ["unanswerable", "clarification", "answer"][n % 3], f"dom{n % 2}", "en", "same", "none", "md") for n in range(30)], "item_id string, dialogue_id string, category string, domain string, language string, relation string, history string, format string")
    quotas = {"unanswerable": 1, "clarification": 2, "answer": 3}
    picked = [r.item_id for r in selection.greedy_quotas(pool, quotas, {"domain": {"dom0": 3, "dom1": 3}}, 1, "dev").orderBy("ordinal").collect()]
    rows = {r.item_id: r for r in pool.collect()}
    assert [rows[i].category for i in picked] == [c for c, n in quotas.items() for _ in range(n)] and len({rows[i].dialogue_id for i in picked}) == 6
    assert sorted(rows[i].domain for i in picked) == ["dom0"] * 3 + ["dom1"] * 3
    with pytest.raises(Exception, match="no item is left for answer"):
        selection.greedy_quotas(pool, {"answer": 8}, {}, 1, "dev").collect()
    items = spark.createDataFrame([(f"q{n}", ["refuse", "clarify", "answer"][n % 3], "out_of_domain" if n == 3 else f"dom{n % 2}") for n in range(12)], "question_id string, label string, domain string")
    smoke = [r.question_id for r in selection.smoke_set(items, {"refuse": 2, "clarify": 1, "answer": 1}, 1, ["domain"]).orderBy("ordinal").collect()]
    assert smoke[0] == "q3" and len(set(smoke)) == 4
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r.k: r.v for r in sampling.overlay(base, spark.createDataFrame([(2, "z")], "k int, v string"), "k", ["v"]).collect()} == {1: "a", 2: "z"}
    with pytest.raises(ValueError):
        sampling.overlay(base, spark.createDataFrame([(9, "z")], "k int, v string"), "k", ["v"])
    b = sampling.bootstrap_interval(spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "key int, delta double"), draws=400).first()
    assert 0.35 < b.lo < 0.47 < b["mean"] < 0.53 < b.hi < 0.65


def test_integrity(spark, tmp_path):
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [float("nan"), 1.0]), (3, [1.0])], "id int, v array<double>")
    found = {r.rule: r.violations for r in integrity.vector_rules(good, "id", "v", 2).collect()}
    assert {k: found[k] for k in ("dimension", "finite", "unique_key")} == {"dimension": 1, "finite": 1, "unique_key": 1}
    assert integrity.multiset_difference(good.select("id"), good.select("id").distinct()).count() == 1
    with pytest.raises(ValueError):
        integrity.enforce(integrity.rules({"x": good}))
    with pytest.raises(ValueError):
        integrity.contained(str(tmp_path), "../x")
    a = integrity.table_fingerprint(good.select("id"), "id", "id").first()
    assert a == integrity.table_fingerprint(good.select("id").repartition(3), "id", "id").first() != integrity.table_fingerprint(good.select((F.col("id") + 1).alias("id")), "id", "id").first()
    import hashlib

    right = spark.createDataFrame([("p", hashlib.sha256(b"p").hexdigest())], "payload string, sha256 string")
    assert integrity.verified(right).count() == 1
    with pytest.raises(Exception, match="hash is wrong"):
        integrity.verified(right.withColumn("payload", F.lit("q"))).collect()


def test_layout(spark):
    words = [(1, 0, 0, 0, 0, "Big", 0, 0, 30, 40), (1, 0, 0, 0, 1, "Title", 40, 0, 30, 40), (1, 0, 0, 1, 0, "goes", 0, 45, 30, 38), (1, 1, 0, 0, 0, "Body", 0, 120, 30, 20), (1, 1, 0, 0, 1, "text", 40, 120, 30, 20), (1, 1, 0, 1, 0, "more", 0, 145, 30, 20), (1, 1, 0, 2, 0, "apart", 0, 220, 30, 20), (1, 1, 0, 3, 0, "- item", 0, 242, 30, 20), (1, 1, 0, 4, 0, " ", 0, 262, 30, 20)]
    df = spark.createDataFrame([(*w, [0.0, 0.0, 0.0]) for w in words], "page int, block int, par int, line int, ix int, text string, left int, top int, width int, height int, color array<double>")
    assert layout.lines_to_markdown(layout.word_lines(df)).first().markdown == "# Big Title goes\n\nBody text more\n\napart\n\n- item"
    r = lambda t, b=False, i=False: (t, b, i)
    paras = [("d", 0, "Title", [r("T")], None), ("d", 1, "Heading 1", [r("H")], None), ("d", 2, "List Number", [r("a")], None), ("d", 3, "List Number 2", [r("in")], None), ("d", 4, "List Number", [r("b")], None), ("d", 5, "List Bullet 2", [r("c", True)], None), ("d", 6, "List Number", [r("d")], None), ("d", 7, None, None, [["x", "y\nz"], ["", ""], ["1", "2"]]), ("d", 8, "Normal", [r("e", True, True), r(" f", False, True)], None)]
    md = layout.paragraphs_to_markdown(spark.createDataFrame(paras, "doc_id string, ix int, style string, runs array<struct<text:string,bold:boolean,italic:boolean>>, cells array<array<string>>")).first().markdown
    assert md == "# T\n\n## H\n\n1. a\n\n  1. in\n\n2. b\n\n  - **c**\n\n1. d\n\n| x | y z |\n| --- | --- |\n| 1 | 2 |\n\n***e**** f*\n"
