"""What the operators share: input, tables that cut lineage, Arrow rows, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in Java's, Python's and RE2's syntax. ``bytes.split()`` splits at the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Without one, a local session uses its own; a cluster has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"file://{tempfile.gettempdir()}/corpusloom-shared"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def rows(batches: Iterable, *names: str, size: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, a few at a time."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield from zip(*(part.column(i).to_pylist() for i in at), strict=True)


def record_batches(tuples: Iterable[tuple], schema, size: int = 4096):
    """Arrow batches of ``size`` rows from tuples."""
    import pyarrow as pa

    held: list[tuple] = []
    for t in tuples:
        held.append(t)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


#: Rows and bytes of the Arrow batches that a task gets at once, where the session does not say otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Long texts make batches of the default number of rows large; a session's own setting stays."""
    for key, ours in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, ours)


def map_rows(df: DataFrame, make, out: str, size: int = 4096) -> DataFrame:
    """``make``: an iterator of Arrow batches to an iterator of tuples; ``out``: the schema in DDL."""
    small_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(out)
    schema = to_arrow_schema(kind)

    def run(batches):
        return record_batches(make(batches), schema, size)

    return df.mapInArrow(run, kind)


def numbered(df: DataFrame, within: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``idx``, each row's place from 0 in ``order`` among those of equal ``within``, and ``n``, their number.

    Rows are dealt by ranges of ``within`` and ``order`` (equal rows too), numbered where they lie, and moved by what the ranges
    before them hold: a count for each range and value of ``within``. ``df`` is read twice and should be a written table.
    """
    keys = [within, *order]
    spread = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt")
    placed = materialise(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), name)
    w = Window.partitionBy(within)
    spans = placed.groupBy("_part", within).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("_part", within, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    return placed.join(starts, ["_part", within]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def row_key() -> Column:
    """128 bits that stand for a row's ``doc_id`` and ``text``, so that what is found in a text finds its row again; missing and empty text are one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")))


def in_fold(column: str, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; a missing id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the least node of each component.

    Alternating large-star and small-star steps; the links stay distributed and each round is written to the
    shared folder. Nodes without an edge do not appear.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join's large side can be split where one node has many links
        least = materialise(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        joined = e.join(least, "a")
        out = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = out.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        edges = materialise(star(star(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
