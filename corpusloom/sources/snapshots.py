"""Tables as versions: data is written aside, and one small file that must not exist yet makes it a version.

    <path>/data/<id>/       Parquet files of one write, never changed
    <path>/inventory/<id>/  their names, bytes, rows and SHA-256
    <path>/log/<version>    JSON: the writes that make up the version, its schema and number of rows

A reader takes the last version and sees all of it or none. A writer that finds its version taken reads the new last one and tries again, so of two
writers at once both succeed, one after the other. A crash before the file in the log is there leaves files that no version names, and nothing else.
The log's file appears whole: on a local path by a hard link, elsewhere by a rename that fails if the target exists, which HDFS guarantees. For a
store without such a rename, pass a ``put`` that writes if absent.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import keytree

#: How often a writer tries when others are faster.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has taken the version."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """A file with ``text`` at ``path``, whole, or Conflict if there is one already."""
    jpath = _path(spark, path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    local = fs.getScheme() == "file"
    if local:
        target = unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        aside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(aside, target)
        except FileExistsError as taken:
            raise Conflict(path) from taken
        finally:
            os.unlink(aside)
        return
    aside = _path(spark, f"{jpath.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, jpath, options)
    except Exception as failed:
        if fs.exists(jpath):
            raise Conflict(path) from failed
        raise
    finally:
        fs.delete(aside, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    log = _path(spark, f"{path}/log")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(log):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit())


def entry(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What the log says of a version, the last one by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {'' if version is None else version}".rstrip())
    version = known[-1] if version is None else version
    name = _path(spark, f"{path}/log/{version:020d}")
    stream = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name)
    try:
        return {"version": version, **json.loads(bytes(stream.readAllBytes()).decode())}
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of a version, the last one by default."""
    at = entry(spark, path, version)
    schema = StructType.fromJson(at["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/data/{w}" for w in at["writes"]]) if at["writes"] else spark.createDataFrame([], schema)


def _stage(df: DataFrame, path: str) -> tuple[str, int]:
    """Write data and its inventory; nothing names them yet."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/{name}")
    counted = written.groupBy(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file")).agg(F.count("*").alias("rows"))
    hashed(spark, path, name).join(counted, "file", "left").fillna(0, ["rows"]).coalesce(1).write.parquet(f"{path}/inventory/{name}")
    return name, written.count()


def hashed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, bytes, sha256) of the files of one write, as they are now."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/data/{name}")
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame | None], append: bool = False, tries: int = TRIES, put=put_if_absent, batch: tuple[str, int] | None = None) -> int:
    """Make the table ``change(last version)`` the next version, or with ``append`` add its rows to it; returns the version.

    ``batch``, a writer's name and the number of its batch, makes the write happen once: numbers of a writer only grow, each version keeps the last of every
    writer, and a batch that is in the table already changes nothing.

    ``change`` gets None for a table that does not exist, and may return None to leave the table as it is. Where another writer was faster it is called
    again with that writer's version. Rows to append do not depend on the last version and are written once.
    """
    staged = None
    for _ in range(tries):
        known = versions(spark, path)
        last = entry(spark, path, known[-1]) if known else None
        batches = last.get("batches", {}) if last else {}
        if batch and batches.get(batch[0], -1) >= batch[1]:
            return last["version"]
        if staged is None or not append:
            df = change(read(spark, path, last["version"]) if last else None)
            if df is None:
                return last["version"] if last else -1
            if append and last and df.schema.simpleString() != StructType.fromJson(last["schema"]).simpleString():
                raise ValueError("rows to append must have the table's columns")
            staged = (*_stage(df, path), df.schema)
        name, n, schema = staged
        keep = last if append and last else {"writes": [], "rows": 0}
        version = known[-1] + 1 if known else 0
        row = {"writes": [*keep["writes"], name], "rows": keep["rows"] + n, "schema": schema.jsonValue(), "after": known[-1] if known else None, "batches": batches | ({batch[0]: batch[1]} if batch else {})}
        try:
            put(spark, f"{path}/log/{version:020d}", json.dumps(row))
            return version
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} tries")


def replace(df: DataFrame, path: str, put=put_if_absent) -> int:
    return update(df.sparkSession, path, lambda _: df, put=put)


def append(df: DataFrame, path: str, put=put_if_absent, batch: tuple[str, int] | None = None) -> int:
    return update(df.sparkSession, path, lambda _: df, append=True, put=put, batch=batch)


def replace_changed(df: DataFrame, path: str, key: str, payload: list[str] | None = None, put=put_if_absent) -> tuple[int, int]:
    """The next version from ``df`` if it differs from the last one: (version, number of keys that differ). Trees of both tell where they differ."""
    found = 0

    def change(last):
        nonlocal found
        if last is None or last.schema.simpleString() != df.schema.simpleString():
            found = df.select(key).distinct().count()
            return df
        depth = keytree.depth_of(max(last.count(), df.count()))
        found = keytree.diff(keytree.build(last, key, payload, depth=depth), keytree.build(df, key, payload, depth=depth)).count()
        return df if found else None

    return update(df.sparkSession, path, change, put=put), found


def verify(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, problem): files of a version that are missing, were changed, or are in its folders without being in the inventory; none if all is well."""
    out = None
    for name in entry(spark, path, version)["writes"]:
        said = spark.read.parquet(f"{path}/inventory/{name}").select("file", F.col("bytes").alias("said_bytes"), F.col("sha256").alias("said"))
        both = said.join(hashed(spark, path, name), "file", "full")
        problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("said").isNull(), "not_in_inventory").when((F.col("said") != F.col("sha256")) | (F.col("said_bytes") != F.col("bytes")), "changed")
        one = both.select("file", problem.alias("problem")).where("problem IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "file string, problem string")
