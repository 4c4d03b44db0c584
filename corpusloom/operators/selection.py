"""Picks that depend on all picks before them, from one job: quotas with balanced dimensions, and sets that cover dimensions.

What a pick is worth depends on its profile only: the values that are balanced or covered. So of each profile no more rows can ever be picked than
there are picks, and those are its first ones. They are ranked where they lie and cut before the shuffle, whatever share of the table a profile holds;
the picks are then folded in one task over profiles x picks rows at most. Profiles of a quota are bounded by its targets (a value without a
target is worth nothing), those of a cover by the combinations of its categorical dimensions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Weights of the dimensions that a greedy pick balances.
WEIGHTS = {"domain": 3.0, "language": 2.0, "relation": 1.0, "history": 1.0, "format": 1.0}
LABELS = ("refuse", "clarify", "answer")


def nominees(pool: DataFrame, profile: list[str], apart: str, first: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each profile by ``first``, an ascending struct, with one row for each value of ``apart``; rows where it is null go."""
    best = pool.where(F.col(apart).isNotNull()).groupBy(*profile, apart).agg(F.min(first).alias("first"))
    return best.withColumn("at", F.row_number().over(Window.partitionBy(*profile).orderBy("first", apart))).where(F.col("at") <= n)


def fold(found: DataFrame, choose: Callable[[list[dict]], Iterator[tuple[int, object]]], schema: str) -> DataFrame:
    """``choose`` over all rows of ``found``, which is bounded, in one task; it is called for an empty table too."""
    blank = found.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema])

    def run(table: pd.DataFrame) -> pd.DataFrame:
        rows = table[table["at"].notna()].to_dict("records")
        return pd.DataFrame(list(choose(rows)), columns=[part.split()[0] for part in schema.split(", ")])

    return found.unionByName(blank).groupBy(F.lit("all")).applyInPandas(run, schema)


def heads(rows: list[dict], profile: list[str]) -> dict[tuple, list[dict]]:
    """Rows of each profile, best last."""
    lists: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: -r["at"]):
        lists.setdefault(tuple(r[c] for c in profile), []).append(r)
    return lists


def pick(lists: dict[tuple, list[dict]], apart: str, used: set, worth: Callable[[tuple], tuple]) -> tuple[tuple, dict] | None:
    """Profile and row of the greatest worth, then of the first rank; rows whose ``apart`` is used are dropped on the way."""
    best = None
    for profile, waiting in lists.items():
        while waiting and waiting[-1][apart] in used:
            waiting.pop()
        if waiting:
            value, order = worth(profile), tuple(waiting[-1]["first"].values())
            if best is None or value > best[0] or (value == best[0] and order < best[1]):
                best = (value, order, profile, waiting[-1])
    return best and best[2:]


def greedy_quotas(pool: DataFrame, quotas: dict[str, int], targets: dict[str, dict[str, int]], seed: int, split: str) -> DataFrame:
    """(ordinal, item_id): category by category in the order of ``quotas``, one item of each dialogue, each the one that best fills what is missing.

    ``pool(item_id, dialogue_id, category, domain, language, relation, history, format)``. An item is worth, over its dimensions, the weighted share of
    its value's target that is still missing; then the greater jitter, then the smaller id counts. Rows without a dialogue are never picked; a null
    value has no target. The job fails if a category has too few dialogues left.
    """
    dims = [d for d in WEIGHTS if any(t > 0 for t in targets.get(d, {}).values())]
    aimed = [F.when(F.col(d).isin([v for v, t in targets[d].items() if t > 0]), F.col(d)).alias(d) for d in dims]
    j = -T.jitter(seed, split, F.col("item_id"))
    wanted = pool.where(F.col("category").isin(list(quotas))).select("category", *aimed, "dialogue_id", F.struct(j.alias("jitter"), F.col("item_id").cast("string").alias("id")).alias("order"))
    found = nominees(wanted, ["category", *dims], "dialogue_id", F.col("order"), sum(quotas.values()))

    def choose(rows: list[dict]) -> Iterator[tuple[int, str]]:
        counts = {d: Counter() for d in dims}
        used: set = set()

        def worth(profile: tuple) -> tuple:
            return (sum((WEIGHTS[d] * (targets[d][v] - counts[d][v]) / targets[d][v] for d, v in zip(dims, profile, strict=True) if v is not None), 0.0),)

        for category, n in quotas.items():
            lists = heads([r for r in rows if r["category"] == category], dims)
            for _ in range(n):
                got = pick(lists, "dialogue_id", used, worth)
                if got is None:
                    raise ValueError(f"no item is left for {category}")
                profile, row = got
                yield len(used), row["first"]["id"]
                used.add(row["dialogue_id"])
                for d, v in zip(dims, profile, strict=True):
                    counts[d][v] += 1

    return fold(found, choose, "ordinal int, item_id string")


def smoke_set(items: DataFrame, targets: dict[str, int], seed: int, dimensions: list[str]) -> DataFrame:
    """(ordinal, question_id) for coverage, label by label: a question is worth the sum over dimensions of 1 / (1 + times its value was picked); ties by the greatest hash.

    ``items(question_id, label, domain, *dimensions)``. Of several refusals the first is outside the domain and the second inside, where there are such.
    A null value is a value; a repeated question counts once; questions without id are never picked. The job fails if a label has too few questions.
    """
    tie = F.sha2(F.concat(F.lit(f"{seed}:smoke:"), F.col("question_id").cast("string")).cast("binary"), 256)
    # digits turned about, so that the greatest hash comes first in ascending order
    order = F.struct(F.translate(tie, "0123456789abcdef", "fedcba9876543210").alias("hash"))
    names = [f"_{i}" for i in range(len(dimensions))]
    outside = F.coalesce(F.col("domain") == "out_of_domain", F.lit(False))
    listed = items.select(F.col("label").alias("_label"), outside.alias("_outside"), *[F.col(d).cast("string").alias(c) for d, c in zip(dimensions, names, strict=True)], "question_id", order.alias("order"))
    found = nominees(listed.where(F.col("_label").isin(list(LABELS))), ["_label", "_outside", *names], "question_id", F.col("order"), sum(targets.get(x, 0) for x in LABELS))
    kind = items.schema["question_id"].dataType.simpleString()

    def choose(rows: list[dict]) -> Iterator[tuple[int, object]]:
        counts = [Counter() for _ in dimensions]
        used: set = set()
        for label in LABELS:
            lists = heads([r for r in rows if r["_label"] == label], ["_outside", *names])
            for slot in range(targets.get(label, 0)):
                split = label == "refuse" and targets[label] >= 2 and slot < 2
                got = pick(lists, "question_id", used, lambda p: (split and p[0] == (slot == 0), sum(1 / (1 + c[v]) for c, v in zip(counts, p[1:], strict=True))))  # noqa: B023
                if got is None:
                    raise ValueError(f"no item is left for {label}")
                profile, row = got
                yield len(used), row["question_id"]
                used.add(row["question_id"])
                for c, v in zip(counts, profile[1:], strict=True):
                    c[v] += 1

    return fold(found, choose, f"ordinal int, question_id {kind}")
