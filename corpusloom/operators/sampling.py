"""Evaluation sets: quota sampling, distributions, split pools, completeness of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

def quota_sample(items: DataFrame, group: str, n: int, seed: int, split: str, key: str) -> DataFrame:
    """``n`` items of each group by stable jitter: repeatable, whatever the partitions."""
    j = items.withColumn("jitter", T.jitter(seed, split, F.col(key)))
    w = Window.partitionBy(group).orderBy("jitter", key)
    return j.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def shuffled(items: DataFrame, seed: int, split: str, key: str) -> DataFrame:
    return items.orderBy(F.sha2(F.concat(F.lit(f"{seed}:{split}:"), F.col(key).cast("string")).cast("binary"), 256))


def distributions(items: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return items.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def quality_flags(item: dict[str, Column]) -> Column:
    """Names of the six review flags that hold for an item's category, language, question, reference and evidence."""
    suspect = r"(?i)(lorem ipsum|\bTODO\b|\bplaceholder\b|�|\?{3,})"
    category, q, ref = item["category"], item["question"], item["reference"]
    flag = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(
        flag(category.isin("clarification", "unanswerable"), "source_label_requires_review"),
        flag(~item["language"].eqNullSafe(F.lit("en")), "translated_text_review"),
        flag(q.rlike(suspect) | ref.rlike(suspect), "suspect_placeholder_or_garbled_text"),
        flag(F.length(T.strip(q)) < 8, "very_short_question"),
        flag(F.length(T.strip(ref)) < 12, "very_short_reference"),
        flag(category.isin("answer", "clarification") & ~item["has_evidence"], "missing_answer_evidence"),
    ))


def completeness(plan: DataFrame, done: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Planned but not done, and done but not planned."""
    return {"pending": plan.join(done, keys, "left_anti"), "unplanned": done.join(plan, keys, "left_anti")}


def next_tasks(plan: DataFrame, done: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """The first ``limit`` planned tasks in ``order`` that are not done, each with ``planned``, the number of all: reports divide by that."""
    total = plan.agg(F.count("*").alias("planned"))
    return plan.join(done.select(*keys), keys, "left_anti").orderBy(order, *keys).limit(limit).join(F.broadcast(total))  # one row


def export(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every planned case, with status 'not_submitted' where there is no result."""
    return plan.join(results, keys, "left").withColumn("status", F.coalesce("status", F.lit("not_submitted")))


def overlay(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overrides win where they have a value; an override of an unknown key is an error."""
    unknown = overrides.join(rows, key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"override of unknown {key}: {unknown[0][key]}")
    new = overrides.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def paired_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: pairs, gained and lost between two runs."""
    both = old.select(key, F.col(value).alias("a")).join(new.select(key, F.col(value).alias("b")), key)
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("b") > F.col("a")).alias("gained"), F.count_if(F.col("b") < F.col("a")).alias("lost"))


#: Distinct deltas that a draw may choose from at most; outcomes of paired cases have three.
DELTAS = 100_000


def bootstrap_interval(deltas: DataFrame, draws: int = 20_000, seed: int = 20260906, level: float = 0.95) -> DataFrame:
    """(mean, lo, hi) of ``deltas(key, delta)`` under resampling with replacement.

    A draw of all pairs is a multinomial number of each distinct delta, so a draw costs as many steps as there are distinct deltas,
    whatever the number of pairs. Each draw has a generator of its own, seeded by its number: the result is the same for all partitionings. Null deltas
    are left out; without any the row is null.
    """
    import pandas as pd

    known = deltas.where("delta IS NOT NULL").groupBy(F.col("delta").cast("double").alias("delta")).agg(F.count("*").alias("n")).orderBy("delta").limit(DELTAS + 1).collect()
    if len(known) > DELTAS:
        raise ValueError(f"more than {DELTAS} distinct deltas: round them first")
    values, counts = [r.delta for r in known], [r.n for r in known]

    def run(batches):
        import numpy as np

        n, v = sum(counts), np.array(values)
        share = np.array(counts, float) / max(n, 1)
        for batch in batches:
            yield pd.DataFrame({"m": [float(np.random.default_rng((seed, int(d))).multinomial(n, share) @ v / n) for d in batch.id] if n else []}, dtype=float)

    means = deltas.sparkSession.range(draws).mapInPandas(run, "m double")
    tail = (1 - level) / 2
    mean = sum(v * c for v, c in zip(values, counts, strict=True)) / sum(counts) if counts else None
    return means.agg(F.lit(mean).cast("double").alias("mean"), F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))
