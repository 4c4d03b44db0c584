"""Integrity: fingerprints, duplicates, multiset equality, and rules that report their violations as rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import dot, is_valid


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in sorted order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def table_fingerprint(df: DataFrame, key: str, *columns: str, fingerprint: Column | None = None) -> DataFrame:
    """One row with the SHA-256 of all rows' fingerprints in order of ``key``.

    Fingerprints are first combined by their leading byte, so no task holds more than a 256th of them as text.
    """
    marked = df.select(F.col(key).alias("k"), (row_fingerprint(*columns) if fingerprint is None else fingerprint).alias("f")).withColumn("b", F.substring("f", 1, 2))
    parts = marked.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]), "\n").cast("binary"), 256).alias("part"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "part"))), lambda x: x["part"]), "\n").cast("binary"), 256).alias("fingerprint"), F.sum("n").alias("n"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their side that one of two tables has more often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def vector_rules(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(rule, violations) for a table of vectors: dimension, finite values, unit norm, unique keys."""
    v = F.col(vector)
    one = vectors.agg(
        F.count_if(F.size(v) != dim).alias("dimension"),
        F.count_if((F.size(v) == dim) & ~is_valid(v, dim)).alias("finite"),
        F.count_if(F.abs(F.sqrt(dot(v, v)) - 1) > 1e-3).alias("unit_norm"),
        (F.count("*") - F.count_distinct(key)).alias("unique_key"),
    )
    return one.select(F.expr("stack(4, 'dimension', dimension, 'finite', finite, 'unit_norm', unit_norm, 'unique_key', unique_key) AS (rule, violations)"))


def rules(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) from tables of violations."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def enforce(report: DataFrame) -> None:
    bad = report.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in bad))


def verified(envelopes: DataFrame) -> DataFrame:
    """``envelopes(payload, sha256)`` whose hash is right; a wrong one stops the query when it is read."""
    right = F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256")
    return envelopes.where(F.when(right, F.lit(True)).otherwise(F.raise_error("a checkpoint's hash is wrong").cast("boolean")))


def contained(root: str, path: str) -> str:
    """The path inside ``root``; a path that leads out of it is an error."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} leads out of {root}")
    return str(full)
