"""Sinks: review sheets, releases that are never overwritten, guarded table replacement, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.retrieval import table_diff


def review_sheet(items: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON and string lists joined by semicolons."""
    cells = []
    for f in items.schema.fields:
        kind = f.dataType.simpleString()
        cells.append(F.array_join(f.name, ";").alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f.name))
    items.select(*cells).write.csv(path, header=True, mode="errorifexists", escape='"')


def release(df: DataFrame, path: str) -> None:
    """A table that must not exist yet; the committer makes it visible whole or not at all."""
    df.write.mode("errorifexists").parquet(path)


def replace_changed(new: DataFrame, path: str, key: str, payload: list[str]) -> int:
    """Write ``new`` beside the stored table only where it differs; returns the number of differing rows.

    The stored table is moved aside before the new one takes its place and goes last, so at any moment one of them is whole; a call
    that finds a table aside and none in place puts it back first.
    """
    spark = new.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    jpath, staged, aside = at(path), at(path + ".next"), at(path + ".before")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        if not fs.exists(aside):
            new.write.parquet(path)
            return new.count()
        fs.rename(aside, jpath)
    old = spark.read.parquet(path)
    changed = new.count() if old.schema != new.schema else table_diff(old, new, key, payload).count()
    if changed:
        new.write.mode("overwrite").parquet(path + ".next")
        fs.delete(aside, True)
        fs.rename(jpath, aside)
        fs.rename(staged, jpath)
        fs.delete(aside, True)
    return changed


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, redacted on the way: no string leaves with personal data."""
    safe = [T.redact(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else T.redact_map(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "map<string,string>" else F.col(f.name) for f in events.schema.fields]
    events.select(*safe).write.mode("append").json(path)
