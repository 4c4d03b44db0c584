"""Exact nearest passages by pivots: blocks of passages that a query's best can't be in are skipped.

Passages lie with the nearest of a few pivots, in blocks of a bounded number. The angle between vectors obeys the triangle inequality, so the
passages of a pivot are no nearer to a query than the query's angle to the pivot less the pivot's widest angle. Each query is first held against the
pivots nearest to it until these have k passages; then against every other pivot whose bound reaches its k-th best. Queries and passages are both dealt
by block and meet in tiles, so a task holds one tile of each, and nothing but pivots and their statistics goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .retrieval import TILE, best_of

#: Passages whose vectors become pivots (those with the least hash of their id), and passages of a block.
PIVOTS, BLOCK = 64, 4096
#: What arithmetic may add to a bound.
SLACK = 1e-9


def _units(column):
    import numpy as np

    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _angles(units, pivots):
    import numpy as np

    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def top_k(queries: DataFrame, passages: DataFrame, k: int, places: int = 12, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score, rank) of the k passages nearest to each query, ties by id, and one row (pairs, compared): how many pairs there are and how many were compared.

    ``queries(qid, v)``, ``passages(id, v)``, vectors of one length without nulls; a vector of zeros has score 0 with all. Without passages there are no rows.
    """
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    passages = passages.select(F.col("id").cast("long").alias("id"), "v").where("v IS NOT NULL")
    queries = queries.select(F.col("qid").cast("long").alias("qid"), "v").where("v IS NOT NULL")
    chosen = passages.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toPandas()
    if not len(chosen):
        return spark.createDataFrame([], "qid long, id long, score double, rank int"), queries.agg(F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("compared"))
    centres = _units(chosen.v)

    def place(batches):
        for batch in batches:
            if len(batch):
                angles = _angles(_units(batch.v), centres)
                yield pd.DataFrame({"id": batch.id, "v": batch.v, "pivot": angles.argmin(axis=1).astype("int32"), "angle": angles.min(axis=1)})

    placed = written(passages.mapInPandas(place, "id long, v array<double>, pivot int, angle double"), "placed")
    stats = {r.pivot: (r.n, r.widest) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}
    sizes, widest = (np.array([stats.get(p, (0, 0.0))[i] for p in range(len(centres))]) for i in (0, 1))
    slots = np.maximum(1, -(-sizes.astype(int) // block))

    def bounds(batches):
        for batch in batches:
            if not len(batch):
                continue
            nearest = np.cos(np.maximum(0.0, _angles(_units(batch.v), centres) - widest))  # the best score that a pivot's passages can have
            order = np.argsort(-nearest, axis=1, kind="stable")
            before = np.take_along_axis(np.broadcast_to(sizes, nearest.shape), order, 1).cumsum(axis=1)
            first = np.zeros(nearest.shape, bool)
            np.put_along_axis(first, order, np.c_[np.ones(len(batch), bool), before[:, :-1] < k], 1)
            first |= sizes == 0
            yield pd.DataFrame({"qid": batch.qid, "v": batch.v, "bounds": list(nearest), "first": list(first & (sizes > 0)), "rest": list(~first)})

    asked = written(queries.mapInPandas(bounds, "qid long, v array<double>, bounds array<double>, first array<boolean>, rest array<boolean>"), "asked")
    at = spark.createDataFrame([(p, int(s)) for p, s in enumerate(slots)], "pivot int, slots int")
    dealt = placed.join(F.broadcast(at), "pivot").select("pivot", F.pmod(F.xxhash64("id"), "slots").cast("int").alias("slot"), "id", "v")  # one row a pivot

    def meet(pairs: DataFrame, name: str) -> DataFrame:
        """Best k of each query in each block that ``pairs(qid, v, pivot)`` sends it to."""
        tiles = pairs.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / TILE)).cast("int").alias("tiles"))
        sent = pairs.join(F.broadcast(tiles), "pivot").join(F.broadcast(at), "pivot")  # a row a pivot in both
        sent = sent.select("qid", F.col("v").alias("qv"), "pivot", F.pmod(F.xxhash64("qid"), "tiles").cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        blocks = dealt.join(F.broadcast(tiles), "pivot").select("pivot", "slot", "id", "v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))

        def score(held: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(held) and len(come):
                x, ids = _units(held.v), held.id.to_numpy()
                for start in range(0, len(come), TILE):
                    part = come.iloc[start : start + TILE]
                    s, i = best_of(np.round(_units(part.qv) @ x.T, places), ids, np.zeros((len(part), 0)), np.zeros((len(part), 0), np.int64), k)
                    out.append(pd.DataFrame({"qid": np.repeat(part.qid.to_numpy(), s.shape[1]), "id": i.ravel(), "score": s.ravel()}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "score": []})

        keys = ["pivot", "slot", "tile"]
        found = blocks.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(score, "qid long, id long, score double")
        return written(found, name)

    to = lambda which: asked.select("qid", "v", "bounds", F.posexplode(which).alias("pivot", "go")).where("go")
    near = meet(to("first").select("qid", "v", "pivot"), "near")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    kth = near.withColumn("place", F.row_number().over(w)).where(F.col("place") == k).select("qid", F.col("score").alias("least"))
    more = to("rest").join(kth, "qid", "left").where(F.col("least").isNull() | (F.element_at("bounds", F.col("pivot") + 1) + SLACK + 10.0**-places >= F.col("least")))
    far = meet(more.select("qid", "v", "pivot"), "far")
    best = near.unionByName(far).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "id", "score", "rank")
    sizes_of = spark.createDataFrame([(p, int(n)) for p, n in enumerate(sizes)], "pivot int, n long")
    compared = to("first").select("pivot").unionByName(more.select("pivot")).join(F.broadcast(sizes_of), "pivot").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return best, compared.select((F.lit(queries.count()) * F.lit(int(sizes.sum()))).alias("pairs"), "compared")
