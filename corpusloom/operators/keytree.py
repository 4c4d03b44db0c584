"""Merkle tree of a table over ranges of its hashed keys: one digest for the table, and differences found by descending only where digests differ.

Rows lie under the leading hexadecimal digits of the SHA-256 of their key. A leaf has ``depth`` digits, as many as keep about ``LEAF`` rows under it, so leaves
stay small at any size; every node above has up to 16 children. Equal rows are one entry with their number, so a repeated row makes no leaf large.
The tree depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written
from .integrity import row_fingerprint

#: Rows of a leaf, on average, at most. Digits that name a folder of a stored tree's rows.
LEAF, FOLDER = 256, 2


@dataclass
class KeyTree:
    """``rows(key, hash, fingerprint, n, folder)`` and ``nodes(level, prefix, digest, n)``, level 0 the root."""

    rows: DataFrame
    nodes: DataFrame
    depth: int

    def root(self) -> DataFrame:
        """One row: the table's fingerprint and number of rows."""
        return self.nodes.where("level = 0").select(F.col("digest").alias("fingerprint"), "n")


def depth_of(n: int, leaf: int = LEAF) -> int:
    depth = 0
    while leaf * 16**depth < n:
        depth += 1
    return depth


def build(df: DataFrame, key: str, columns: list[str] | None = None, fingerprint: Column | None = None, depth: int | None = None, leaf: int = LEAF) -> KeyTree:
    """The tree of ``df`` by ``key``; a row's fingerprint is that of ``columns``, all but the key by default, or the one given. Null keys are one key; an empty table has the digest of nothing."""
    mark = row_fingerprint(*(columns or [c for c in df.columns if c != key])) if fingerprint is None else fingerprint
    each = df.select(F.col(key).alias("key"), mark.alias("fingerprint")).groupBy("key", "fingerprint").agg(F.count("*").alias("n"))
    hashed = each.withColumn("hash", F.sha2(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")), 256))
    rows = written(hashed.withColumn("folder", F.substring("hash", 1, FOLDER)), "keytree-rows")
    if depth is None:
        depth = depth_of(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], leaf)
    level = _digest(rows.select(F.substring("hash", 1, depth).alias("prefix"), F.concat_ws(":", "hash", F.coalesce("fingerprint", F.lit("")), "n").alias("part"), "n"))
    levels = [level.select(F.lit(depth).alias("level"), "prefix", "digest", "n")]
    for d in range(depth - 1, -1, -1):
        level = _digest(level.select(F.substring("prefix", 1, d).alias("prefix"), F.concat_ws(":", "prefix", "digest").alias("part"), "n"))
        levels.append(level.select(F.lit(d).alias("level"), "prefix", "digest", "n"))
    nodes = levels[0]
    for one in levels[1:]:
        nodes = nodes.unionByName(one)
    return KeyTree(rows, written(nodes, "keytree-nodes"), depth)


def _digest(parts: DataFrame) -> DataFrame:
    """(prefix, digest, n) of the sorted parts of each prefix; the root is there even without parts."""
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "\n").cast("binary"), 256).alias("digest")
    total = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    return parts.groupBy("prefix").agg(joined, total)


def store(tree: KeyTree, path: str) -> None:
    """Write a tree; its rows lie in folders by the first digits of their hash."""
    tree.rows.repartition("folder").write.partitionBy("folder").parquet(f"{path}/rows")
    tree.nodes.coalesce(1).write.parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str) -> KeyTree:
    nodes = spark.read.parquet(f"{path}/nodes")
    rows = spark.read.option("basePath", f"{path}/rows").schema(f"{_kinds(spark, path)}, folder string").parquet(f"{path}/rows")
    return KeyTree(rows, nodes, nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])


def _kinds(spark: SparkSession, path: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema.fields if f.name != "folder")


def differing(old: KeyTree, new: KeyTree) -> tuple[DataFrame, int]:
    """(prefix) of the deepest nodes that both trees have levels for and that differ, and their level; only children of differing nodes are compared."""
    depth = min(old.depth, new.depth)
    at = None
    for d in range(depth + 1):
        sides = []
        for tree, name in ((old, "a"), (new, "b")):
            nodes = tree.nodes.where(F.col("level") == d).select("prefix", F.col("digest").alias(name))
            sides.append(nodes if at is None else nodes.join(at.select(F.col("prefix").alias("above")), F.substring("prefix", 1, d - 1) == F.col("above"), "left_semi"))
        at = written(sides[0].join(sides[1], "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"), "differing")
        if at.isEmpty():
            break
    return at, depth


def diff(old: KeyTree, new: KeyTree) -> DataFrame:
    """(key, change): keys whose rows were added, removed or changed. Reads the rows of differing folders (at most 16 ** FOLDER names) and leaves only."""
    at, depth = differing(old, new)
    folders = [r[0] for r in at.select(F.substring("prefix", 1, FOLDER).alias("f")).distinct().collect()]
    inside = F.lit(False) if not folders else F.lit(True) if depth < FOLDER and "" in folders else F.substring("folder", 1, min(depth, FOLDER)).isin(folders) if depth < FOLDER else F.col("folder").isin(folders)
    sides = []
    for tree, name in ((old, "a"), (new, "b")):
        of = tree.rows.where(inside).withColumn("prefix", F.substring("hash", 1, depth)).join(at, "prefix", "left_semi")
        sides.append(of.groupBy("hash", "key").agg(F.sort_array(F.collect_list(F.struct("fingerprint", "n"))).alias(name)))
    both = sides[0].withColumnRenamed("key", "old_key").join(sides[1].withColumnRenamed("key", "new_key"), "hash", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("new_key", "old_key").alias("key"), change.alias("change"))
