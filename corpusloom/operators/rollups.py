"""Counts over a stated set of categories: those without rows are there with zeros."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Combinations of stated categories at most.
COMBINATIONS = 100_000


def zero_filled(counts: DataFrame, expected: dict[str, list], zeros: list[str] | None = None) -> DataFrame:
    """``counts`` with a row for every combination of the ``expected`` values of its key columns; what had no row has 0 in ``zeros`` (all numbers by default) and null elsewhere.

    Rows of values that were not expected stay: they are not lost in a report for having an unknown name. The combinations are a stated set, bounded by COMBINATIONS.
    """
    keys = list(expected)
    n = 1
    for values in expected.values():
        n *= len(values)
    if n > COMBINATIONS:
        raise ValueError(f"{n} combinations of categories")
    kinds = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    stated = counts.sparkSession.createDataFrame(list(product(*expected.values())), kinds)
    a, b = stated.alias("a"), counts.alias("b")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    rest = [c for c in counts.columns if c not in keys]
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    fill = set(zeros if zeros is not None else [c for c in rest if counts.schema[c].dataType.simpleString().startswith(numbers)])
    own = b.withColumn("_own", F.lit(True)).alias("b")
    joined = a.withColumn("_stated", F.lit(True)).alias("a").join(own, same, "full")
    named = [F.when(F.col("_stated"), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    return joined.select(*named, *[F.when(F.col("_own").isNull(), F.lit(0).cast(counts.schema[c].dataType)).otherwise(F.col(f"b.{c}")).alias(c) if c in fill else F.col(f"b.{c}") for c in rest])
