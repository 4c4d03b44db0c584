"""Candidates, runtime items and the import of an older bundle."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import items as I

KIND = """eval_item_id string, dialogue_id string, question_turn_id int, answer_turn_id int, agent_dialogue_act string, evaluation_category string, domain string, dialogue_language string, language_relation string,
 question string, source_question_en string, conversation_history array<struct<role:string,utterance:string,turn_id:int>>, gold_answer string, source_gold_answer_en string, required_doc_ids array<string>, gold_doc_ids array<string>,
 required_documents array<struct<doc_id:string,format:string>>, evidence array<struct<doc_id:string,source_turn:string,source_block_id:string,text:string>>"""
EVIDENCE = [("d2", "answer", "b9", "x"), ("d1", "question", "b1", "y"), ("d2", "answer", "b3", "z"), ("d2", "answer", "b9", "x"), ("d3", "answer", "", "w")]


@pytest.fixture(scope="module")
def found(spark):
    one = lambda i, **k: {"eval_item_id": f"q{i}", "dialogue_id": f"g{i}", "question_turn_id": 3, "answer_turn_id": 4, "agent_dialogue_act": "respond", "evaluation_category": "answer", "domain": "dmv", "dialogue_language": "en", "language_relation": "same", "question": "How can I appeal this?", "source_question_en": None, "conversation_history": [("user", "hello", 1), ("agent", "hi", 2)], "gold_answer": "Write to the office.", "source_gold_answer_en": None, "required_doc_ids": ["d1", "d2"], "gold_doc_ids": ["d2"], "required_documents": [("d1", "pdf"), ("d2", "md")], "evidence": EVIDENCE} | k
    names = [c.strip().split()[0] for c in KIND.replace("\n", " ").split(", ")]
    rows = [one(2), one(0, evaluation_category="unanswerable", evidence=None, conversation_history=None, required_documents=None, required_doc_ids=None, gold_doc_ids=None), one(1, question="short?", gold_answer="ok")]
    return I.candidates(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], KIND).repartition(3), "dev", ["eval_item_id"])


def test_candidates(found):
    got = {r.question_id: r for r in found.collect()}
    assert [got[q].sequence for q in ("q0", "q1", "q2")] == [0, 1, 2]
    q2, q0 = got["q2"], got["q0"]
    assert q2.review.evidence_ids == ["b3", "b9"] and q2.review.status == "pending" and q2.review.quality_flags == [] and q2.document_format == "pdf" and q2.history_bucket == "short" and q2.source.dialogue_id == "g2"
    assert q0.evidence == [] and q0.document_format == "unknown" and q0.history_bucket == "none" and "source_label_requires_review" in q0.review.quality_flags
    assert {"very_short_question", "very_short_reference"} <= set(got["q1"].review.quality_flags)


def test_runtime_items(spark, found):
    kind = "question_id string, task_label string, reviewed_reference string, label_reason string, reviewer_notes string"
    reviews = spark.createDataFrame([("q0", "refuse", "We can't say.", "none", ""), ("q1", "clarify", "Which one?", "vague", "n"), ("q2", "answer", "=SOURCE", "clear", None)], kind)
    got = {r.question_id: r for r in I.runtime_items(found, reviews).collect()}
    q2, q0 = got["q2"], got["q0"]
    assert q2.answerable and q2.gold_answer == "Write to the office." and q2.answer_evidence_ids == ["b3", "b9"] and q2.answer_doc_ids == ["d2", "d3"] and q2.candidate_doc_ids == [] and q2.required_doc_ids == ["d1", "d2"]
    assert [(e.doc_id, [s.source_block_id for s in e.spans]) for e in q2.evidence] == [("d2", ["b9", "b3", "b9"]), ("d1", ["b1"]), ("d3", [""])]
    assert q2.conversation_history[0].asDict() == {"role": "user", "utterance": "hello"}
    assert not q0.answerable and q0.gold_answer == "We can't say." and q0.required_doc_ids == q0.evidence == q0.answer_doc_ids == [] and q0.review.reviewer_notes is None and got["q1"].review.reviewer_notes == "n"
    with pytest.raises(Exception, match="no review"):
        I.runtime_items(found, reviews.where("question_id <> 'q1'")).collect()


def test_imported_bundle(spark, found):
    kind = "candidate string, question_id string, status string, response string, contexts array<string>, gate string, retrieval string"
    old = spark.createDataFrame([("a", "q0", "ok", "r", ["c1"], None, "x"), ("a", "q1", "failed", None, ["c2"], "low", "x"), ("b", "q0", "ok", "s", ["c3"], None, None)], kind)
    reuse = spark.createDataFrame([("a", "q0"), ("a", "q1"), ("a", "q1")], "candidate string, question_id string")
    items = found.select("question_id", "question")
    cases = I.imported_bundle(old, items, reuse, "older run")
    got = {r.question_id: r for r in cases.collect()}
    assert got["q0"].retrieval_contexts == ["c1"] and got["q1"].retrieval_contexts is None and len(got["q0"].item_sha256) == 64 and got["q0"].item_sha256 != got["q1"].item_sha256
    assert tuple(I.import_summary(cases).first()) == (2, 1)
    with pytest.raises(Exception, match="no generation"):
        I.imported_bundle(old, items, reuse.unionByName(reuse.withColumn("candidate", F.lit("z"))), "older run").collect()
