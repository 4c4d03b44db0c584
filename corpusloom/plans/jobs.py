"""Whole jobs: an index from documents, answers from questions, a report from judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, evidence, integrity, judging, retrieval, sections


def build_index(docs: DataFrame, blocks: DataFrame, encode, stored: DataFrame, budget: int = 1024, overlap: int = 0) -> dict[str, DataFrame]:
    """``docs(doc_id, text)`` in Markdown to cleaned texts, chunks, their source spans, and vectors.

    Chunks whose text has a stored vector (``stored(text, position, vector_id, v)``) keep it; only the others are encoded by
    the Column function ``encode``.
    """
    cleaned = sections.clean(docs).select("doc_id", F.col("cleaned").alias("text"), "sections_dropped", "escapes_fixed")
    chunks = chunking.chunk_documents(cleaned, budget, overlap)
    placed = evidence.locate_blocks(cleaned, blocks)
    spans = evidence.overlaps(evidence.chunk_runs(cleaned, chunks), placed.where("start IS NOT NULL"))
    matched = retrieval.reuse_by_text(chunks.select("chunk_id", "text"), stored)
    kept = matched.where("reused_id IS NOT NULL").join(stored.select(F.col("vector_id").alias("reused_id"), "v"), "reused_id").select("chunk_id", "v", F.lit(True).alias("reused"))
    new = matched.where("reused_id IS NULL").select("chunk_id", encode("text").alias("v"), F.lit(False).alias("reused"))
    return {"cleaned": cleaned, "chunks": chunks, "blocks": placed, "spans": spans, "vectors": kept.unionByName(new)}


def check_vectors(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """(rule, violations): dimension, finite values, unique ids, and the same ids as the chunks."""
    own = integrity.vector_rules(vectors, "chunk_id", "v", dim).where("rule <> 'unit_norm'")
    ids = integrity.rules({"without_vector": chunks.join(vectors, "chunk_id", "left_anti"), "without_chunk": vectors.join(chunks, "chunk_id", "left_anti")})
    return own.unionByName(ids)


def report(cases: DataFrame, judgments: DataFrame, target: float) -> DataFrame:
    """Metrics overall and by label of each candidate, with the state of the target for correctness."""
    each = cases.select("*", F.explode(F.array(F.lit("(all)"), F.col("label"))).alias("group"))
    out = judging.summary(each, judgments, ["candidate", "group"])
    return out.withColumn("target_status", judging.threshold_status(F.col("correctness_lo"), F.col("correctness_hi"), target))


def differs(computed: DataFrame, published: DataFrame) -> DataFrame:
    """Rows in which a recomputed report and the published one differ."""
    return integrity.multiset_difference(computed, published)
