"""Tables as files that a stream reads one after the other."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days by which a heartbeat is later than any row.
FAR = 3650


def deal(spark: SparkSession, parts: list[DataFrame], ts: str, folder: str, first: int = 0, heartbeat: bool = True, files: int = 1) -> str:
    """Write each part as ``files`` files below ``folder``, in order, and last a heartbeat: a row with a time long after all others, and nulls. Returns a pattern of the files.

    A file source takes files by the time of their last change, so a part is written only after the one before is there. The files of one part are written at once, by a task each, and have no order.
    """
    names = [f"{folder}/part-{k:05d}" for k in range(first, first + len(parts) + heartbeat)]
    for part, name in zip(parts, names):
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(name)
        time.sleep(0.02)  # changed later than the one before
    if heartbeat:
        fields = parts[0].schema.fields
        whole = spark.read.schema(parts[0].schema).parquet(*names[:-1])
        last = whole.agg((F.max(ts) + F.expr(f"INTERVAL {FAR} DAYS")).cast(whole.schema[ts].dataType).alias(ts))
        last.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).coalesce(1).write.parquet(names[-1])
    return f"{folder}/part-*"


def by_time(df: DataFrame, bucket, jitter, n: int) -> list[DataFrame]:
    """``n`` parts of ``df``: by ``bucket``, numbers from 0 that grow with time, moved on by ``jitter``, so rows of one part come up to that many parts out of order."""
    at = F.least(bucket + jitter, F.lit(n - 1))
    return [df.where(at == k) for k in range(n)]
