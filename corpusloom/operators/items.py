"""Evaluation items: candidates for review, items as they are evaluated, and generations of an older release as a bundle of this one.

Everything is a projection of rows, so no row leaves its task but for the joins with reviews and generations by their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import answers, sampling
from .evalset import SOURCE, document_format
from .integrity import row_fingerprint

#: Labels that have an answer, and the version of candidates.
ANSWERABLE, SCHEMA_VERSION = ("answer", "clarify"), 1
_IDS = ("dialogue_id", "question_turn_id", "answer_turn_id", "agent_dialogue_act", "evaluation_category")


def _answer_side(evidence: Column, field: str) -> Column:
    """Sorted distinct values of a field of the evidence for the answer; null and empty ones do not count."""
    own = F.filter(evidence, lambda e: (e["source_turn"] == "answer") & e[field].isNotNull() & (e[field] != ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(own, lambda e: e[field]))), F.array().cast("array<string>"))


def candidates(items: DataFrame, split: str, order: list[str]) -> DataFrame:
    """One candidate for each item, pending review: its source, question, evidence and flags. ``sequence`` counts from 0 in ``order``.

    The sequence comes from counts by partition of the sorted rows, so no task holds all items. Missing history, documents and evidence are empty arrays.
    """
    array = lambda c: F.coalesce(F.col(c), F.array().cast(items.schema[c].dataType))
    flags = sampling.quality_flags({
        "category": F.col("evaluation_category"), "language": F.col("dialogue_language"), "question": F.col("question"), "reference": F.col("gold_answer"),
        "has_evidence": F.exists(array("evidence"), lambda e: e["source_turn"] == "answer"),
    })
    review = F.struct(
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("task_label"), F.lit(None).cast("string").alias("reviewed_reference"), F.lit(None).cast("string").alias("label_reason"),
        _answer_side(array("evidence"), "source_block_id").alias("evidence_ids"), F.lit(None).cast("string").alias("reviewer_notes"), flags.alias("quality_flags"),
    )
    rows = items.select(
        F.lit(SCHEMA_VERSION).alias("candidate_schema_version"), F.lit(split).alias("split"), F.col("eval_item_id").alias("question_id"), F.struct(*_IDS).alias("source"), "domain", F.col("dialogue_language").alias("question_language"),
        "language_relation", document_format(array("required_documents")).alias("document_format"), answers.history_bucket(F.size(array("conversation_history"))).alias("history_bucket"), "question", "source_question_en",
        array("conversation_history").alias("conversation_history"), F.col("gold_answer").alias("source_gold_answer"), "source_gold_answer_en", array("required_doc_ids").alias("required_doc_ids"), array("gold_doc_ids").alias("gold_doc_ids"),
        array("required_documents").alias("required_documents"), array("evidence").alias("evidence"), review.alias("review"), F.struct(*order).alias("_order"),
    )
    # the place among all: rows of the partitions before, and before the row in its own
    sorted_ = rows.repartitionByRange("_order", "question_id").sortWithinPartitions("_order", "question_id").withColumn("_at", F.monotonically_increasing_id())
    placed = written(sorted_.withColumn("_part", F.shiftright("_at", 33)), "candidates")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, "_part")
    return numbered.withColumn("sequence", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_start", "_order")


def grouped_evidence(evidence: Column) -> Column:
    """Evidence gathered by document, in the order of first mention."""
    return F.transform(F.array_distinct(F.transform(evidence, lambda e: e["doc_id"])), lambda d: F.struct(d.alias("doc_id"), F.filter(evidence, lambda e: e["doc_id"].eqNullSafe(d)).alias("spans")))


def runtime_items(found: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items as they are evaluated, from candidates and ``reviews(question_id, task_label, reviewed_reference, label_reason, reviewer_notes)``.

    A reference of '=SOURCE' is the source's answer. Documents and evidence of an item that can't be answered are no answers: its documents
    become candidate documents. A candidate without a review stops the query.
    """
    marks = reviews.select("question_id", *[F.col(c).alias(f"_{c}") for c in ("task_label", "reviewed_reference", "label_reason", "reviewer_notes")], F.lit(True).alias("_seen"))
    joined = found.join(marks, "question_id", "left").where(F.when(F.col("_seen").isNull(), F.raise_error("a candidate has no review").cast("boolean")).otherwise(True))
    can = F.coalesce(F.col("_task_label").isin(*ANSWERABLE), F.lit(False))
    only = lambda c, ok=can: F.when(ok, c).otherwise(F.slice(c, 1, 0))  # noqa: E731  else an empty array of its kind
    return joined.select(
        "question_id", "domain", F.col("_task_label").alias("question_type"), F.col("_task_label").alias("task_label"), can.alias("answerable"), "source", "question", "source_question_en",
        F.transform("conversation_history", lambda t: F.struct(t["role"].alias("role"), t["utterance"].alias("utterance"))).alias("conversation_history"),
        F.when(F.col("_reviewed_reference") == SOURCE, F.col("source_gold_answer")).otherwise(F.col("_reviewed_reference")).alias("gold_answer"), "source_gold_answer", "source_gold_answer_en",
        "question_language", F.col("question_language").alias("answer_language"), "language_relation", "document_format", "history_bucket",
        only(_answer_side(F.col("evidence"), "source_block_id")).alias("answer_evidence_ids"), only(_answer_side(F.col("evidence"), "doc_id")).alias("answer_doc_ids"),
        only(F.col("required_doc_ids")).alias("required_doc_ids"), only(F.col("required_documents")).alias("required_documents"),
        only(F.col("required_doc_ids"), ~can).alias("candidate_doc_ids"), only(F.col("required_documents"), ~can).alias("candidate_documents"), only(grouped_evidence(F.col("evidence"))).alias("evidence"),
        F.struct(F.col("_label_reason").alias("label_reason"), F.col("review.evidence_ids").alias("evidence_ids"), F.when(F.col("_reviewer_notes") != "", F.col("_reviewer_notes")).alias("reviewer_notes")).alias("review"),
    )


def imported_bundle(generations: DataFrame, items: DataFrame, reuse: DataFrame, origin: str) -> DataFrame:
    """Cases of a bundle from an older release's ``generations(candidate, question_id, status, response, contexts, gate, retrieval)``.

    ``reuse(candidate, question_id)`` names those whose input is unchanged; only they come over, with the hash of their item in this release and of the generation
    that they come from. Contexts count as retrieved where there was a retrieval and no gate refused. A named case without a generation or an item stops the query.
    """
    whole = row_fingerprint(*generations.columns)
    old = generations.select("candidate", "question_id", "status", "response", "contexts", F.when(F.col("gate").isNull() & F.col("retrieval").isNotNull(), F.col("contexts")).alias("retrieval_contexts"), whole.alias("source_generation_sha256"))
    now = items.select("question_id", row_fingerprint(*items.columns).alias("item_sha256"))
    named = reuse.select("candidate", "question_id").distinct().join(old, ["candidate", "question_id"], "left").join(now, "question_id", "left")
    lost = F.col("source_generation_sha256").isNull() | F.col("item_sha256").isNull()
    checked = named.where(F.when(lost, F.raise_error("a reused case has no generation or no item").cast("boolean")).otherwise(True))
    return checked.select("candidate", "question_id", "item_sha256", "status", "response", "contexts", "retrieval_contexts", "source_generation_sha256", F.lit(origin).alias("latency_origin"))


def import_summary(cases: DataFrame) -> DataFrame:
    """One row: cases that were imported, and those among them that had failed."""
    return cases.agg(F.count("*").alias("imported"), F.count_if(~F.col("status").eqNullSafe(F.lit("ok"))).alias("failed"))
