"""Readers with fixed schemas: manifests, Markdown and text folders, chunk and log lines, review sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sections import plain_to_markdown

#: Formats of the files that are exchanged.
MANIFEST = "documents array<struct<doc_id:string,domain:string,title:string,language:string,format:string,file:string>>"
CHUNK = "chunk_id string, doc_id string, domain string, language string, source_file string, strategy string, chunk_size_config int, overlap_config int, heading_path array<string>, text string, token_count int, source_spans array<struct<source_block_id:string,start:int,end:int,block_length:int,location:map<string,string>>>"
LEDGER = "event string, attempt_id string, role string, model string, request_hash string, time_utc string, reserved_rmb double, input_token_upper_bound bigint, max_output_tokens int, outcome string, usage struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,reasoning_tokens:bigint>, usage_cost_estimate_rmb double, accounted_rmb double, usage_unknown boolean, seconds double"
#: Keys of a front matter block, in order; others follow.
FRONT_KEYS = ("doc_id", "domain", "title", "language", "format", "source_file", "conversion_method")


def manifest(spark: SparkSession, path: str, formats: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Documents of a JSON manifest; a missing field is an error."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("documents"))
    missing = F.exists(F.array(*rows.columns), lambda c: c.isNull())
    rows = rows.where(F.when(missing, F.raise_error("a manifest field is missing").cast("boolean")).otherwise(True))
    rows = rows.where(F.col("format").isin(formats)) if formats else rows
    return rows.where(F.col("doc_id").isin(ids)) if ids else rows


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path).select("file", T.strip_front_matter(F.col("text")).alias("text"))


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    return whole_texts(spark, path).select("file", plain_to_markdown(F.col("text")).alias("text"))


def front_matter(files: DataFrame) -> DataFrame:
    """(file, meta map, body) of texts with a front matter block; others are left out."""
    pattern = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    lines = F.filter(F.split(F.regexp_extract("text", pattern, 1), "\n"), lambda x: x.rlike(r"^[^\s:][^:]*:"))
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^:]*:\s*", ""), r"^(['\"])(.*)\1$", "$2")
    meta = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):", 1).alias("k"), value(x).alias("v"))))
    return files.where(F.col("text").rlike(pattern)).select("file", meta.alias("meta"), F.regexp_extract("text", pattern, 2).alias("body"))


def with_front_matter(docs: DataFrame, body: str = "text") -> DataFrame:
    """Adds ``rendered``: a block of the known keys in their order, then others; nulls are left out."""
    keys = [k for k in FRONT_KEYS if k in docs.columns] + [c for c in docs.columns if c not in FRONT_KEYS and c != body]
    quoted = lambda c: F.when(c.rlike(r"^[A-Za-z一-鿿][^:#'\"\n]*$") & ~F.lower(c).isin("true", "false", "null", "yes", "no", "on", "off"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), quoted(F.col(k).cast("string"))) for k in keys])
    return docs.withColumn("rendered", F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.col(body)))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines; a line that is no such record fails the read."""
    return spark.read.schema(CHUNK).json(path, mode="FAILFAST")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path, mode="FAILFAST")


def reviews(spark: SparkSession, path: str, expected: DataFrame, required: list[str], key: str = "question_id") -> DataFrame:
    """A review sheet with all columns, each expected id once and trimmed fields; anything else is an error."""
    got = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if lost := [c for c in required if c not in got.columns]:
        raise ValueError(f"missing columns: {lost}")
    got = got.select(*[T.strip(F.col(c)).alias(c) for c in got.columns])
    counts = got.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key, F.lit(1).alias("want")), key, "full")
    bad = counts.where("n IS NULL OR want IS NULL OR n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"ids missing, unknown or repeated: {[r[key] for r in bad]}")
    return got


def convert(files: DataFrame, converters: dict[str, Callable[[bytes, str], str]]) -> DataFrame:
    """(doc_id, status, text, error) from files (doc_id, format, language, content): a converter for each format.

    A document that fails becomes a row of status 'failed'; the others go on. Converters for formats that need optional
    libraries (PDF, DOCX, scans) are given by the caller.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, kind, language, content in zip(batch.doc_id, batch.format, batch.language, batch.content, strict=True):
                try:
                    out.append((doc_id, "ok", converters[kind](bytes(content), language), None))
                except Exception as e:  # noqa: BLE001  one document's failure is a row of the report
                    out.append((doc_id, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "status", "text", "error"])

    return files.select("doc_id", "format", "language", "content").mapInPandas(run, "doc_id string, status string, text string, error string")
