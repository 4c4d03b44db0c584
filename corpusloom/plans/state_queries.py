"""Queries of event-time streams, trees of tables, versions and text runs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keytree, textruns
from ..sources import snapshots
from ..sources.tables import shared_folder
from ..streaming import feed, state, tasks
from . import evaluation_queries

#: Parts that a table is dealt into as a stream, and by how many parts a row may be out of order.
FILES, OUT_OF_ORDER = 4, 1
#: When conversations begin whose turns have no time. A watermark begins at 1970, so what is not after that is late.
BEGUN = 1_700_000_000


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark, df: DataFrame, key) -> tuple[DataFrame, str]:
    """``df`` as a stream of several parts, rows of which are out of order by up to a part, and the delay that covers it."""
    lo, hi = df.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))), F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()
    width = max(1, ((hi or 0) - (lo or 0)) // FILES + 1)
    bucket = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(lo or 0)) / width).cast("int")
    parts = feed.by_time(df, bucket, F.pmod(F.xxhash64(key, F.col("ts")), F.lit(OUT_OF_ORDER + 1)).cast("int"), FILES)
    files = df.rdd.getNumPartitions() or 1  # a part is written, and read as a batch, by as many tasks as the table
    at = feed.deal(spark, parts, "ts", shared_folder(spark, "feed"), files=files)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(at)
    return stream, f"{(OUT_OF_ORDER + 1) * width} seconds"


def ran(stream: DataFrame, partitions: int | None = None) -> DataFrame:
    at = shared_folder(stream.sparkSession, "stream")
    return state.run_available(stream, f"{at}/table", f"{at}/checkpoint", partitions=partitions)


def q43_stream_service_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", (F.col("event_id") % 9 != 0).alias("ok"), (F.col("value") * 100).alias("ms"))
    stream, delay = streamed(spark, e, F.col("ms"))
    return ran(state.service_windows(stream, delay=delay), state.FEW).select("day", "n", "within", "total_ms", F.round("p50_ms", 6).alias("p50_ms"), F.round("p90_ms", 6).alias("p90_ms"))


Q43 = """WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_id % 9 <> 0 AS ok, value * 100 AS ms, CAST(floor(value * 100 * 1000) AS BIGINT) AS us FROM events),
b AS (SELECT *, greatest(length(bin(us)) - 7, 0) AS x FROM e), m AS (SELECT *, (((us >> x) << x) + (1::BIGINT << x) / 2) / 1000 AS mid FROM b),
g AS (SELECT day, count(*) AS n, count(*) FILTER (ok AND ms <= 10000) AS within, round(sum(ms), 6) AS total_ms, list_sort(list(mid) FILTER (ok)) AS mids FROM m GROUP BY 1)
SELECT day, n, within, total_ms, round(mids[CAST(ceil(len(mids) * 0.5::DOUBLE) AS BIGINT)], 6) AS p50_ms, round(mids[CAST(ceil(len(mids) * 0.9::DOUBLE) AS BIGINT)], 6) AS p90_ms FROM g"""


def q44_stream_admission(spark, sf_dir):
    c = read(spark, sf_dir, "events").select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("call_id"), F.col("value").alias("amount"))
    stream, delay = streamed(spark, c, F.col("call_id"))
    return ran(state.admitted_calls(stream, 500.0, delay=delay), state.SHARD_PARTITIONS).select("account", "call_id", "admitted", F.round("spent", 6).alias("spent"))


Q44 = evaluation_queries.Q27.replace("SELECT user_id, event_id AS ordinal, admitted", "SELECT user_id AS account, event_id AS call_id, admitted").replace("ORDER BY event_id) AS k", "ORDER BY ts, event_id) AS k")


def q45_stream_sessions(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").where("role = 'user'")
    s = t.select(F.col("conv_id").alias("session_id"), F.timestamp_seconds(F.lit(BEGUN) + F.col("turn") * 60).alias("ts"), F.col("text").alias("question"), F.lit("ok").alias("answer"), (F.col("turn") % 3 != 2).alias("ok"), F.lit(False).alias("reset"))
    stream, delay = streamed(spark, s, F.col("session_id"))
    return ran(state.session_turns(stream, delay), state.SHARD_PARTITIONS).select("session_id", "turn_id", "ok", F.sha2(F.col("history").cast("binary"), 256).alias("history_sha256"))


Q45 = """WITH t AS (SELECT conv_id, turn, text, turn % 3 <> 2 AS ok FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id, ok, string_agg(CASE WHEN ok THEN 'user: ' || text || chr(10) || 'agent: ok' END, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history FROM t)
SELECT conv_id AS session_id, CAST(turn_id AS INTEGER) AS turn_id, ok, sha256(coalesce(history, '')) AS history_sha256 FROM h"""


def q47_stream_settlements(spark, sf_dir):
    """Paid events as reservations; two of three are settled within their time, and one of eleven settlements comes too late."""
    e = read(spark, sf_dir, "events")
    reserved, delay = streamed(spark, e.select(F.col("event_id").alias("attempt_id"), "ts", "event_type", (F.col("value") * 2).alias("reserved")), F.col("attempt_id"))
    wait = F.when(F.col("event_id") % 11 == 0, 7200).otherwise(F.col("event_id") % 3000)
    late = (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=wait)).cast("timestamp_ntz").alias("ts")
    settled, other = streamed(spark, e.where("event_id % 3 <> 0").select(F.col("event_id").alias("attempt_id"), late, F.col("value").alias("accounted")), F.col("attempt_id"))
    longest = max(int(d.split()[0]) for d in (delay, other))
    stamp = lambda s: s.withColumn("ts", F.col("ts").cast("timestamp"))
    done = ran(state.settled_attempts(stamp(reserved), stamp(settled), "1 hour", f"{longest} seconds"))
    return done.groupBy("event_type").agg(F.count("*").alias("attempts"), F.count("accounted").alias("settled"), F.round(F.sum("upper"), 4).alias("upper"))


Q47 = """WITH e AS (SELECT event_type, value, event_id % 3 <> 0 AND event_id % 11 <> 0 AS settled FROM events)
SELECT event_type, count(*) AS attempts, count(*) FILTER (settled) AS settled, round(sum(CASE WHEN settled THEN value ELSE value * 2 END), 4) AS upper FROM e GROUP BY 1"""


def q34_fingerprints(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("f"))
    return keytree.build(docs, "doc_id", fingerprint=F.col("f")).root()


Q34 = """WITH RECURSIVE e AS (SELECT sha256('=' || doc_id) AS h, coalesce(sha256(text), '') AS f, count(*) AS n FROM documents GROUP BY 1, 2),
d AS (SELECT CAST(greatest(0, ceil(log(greatest(1, sum(n)) / 256.0) / log(16) - 1e-12)) AS INTEGER) AS depth FROM e),
t AS (SELECT depth AS level, substr(h, 1, depth) AS p, sha256(string_agg(h || ':' || f || ':' || n, chr(10) ORDER BY h || ':' || f || ':' || n)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM e, d GROUP BY depth, p
  UNION ALL SELECT level - 1, substr(p, 1, level - 1), sha256(string_agg(p || ':' || digest, chr(10) ORDER BY p || ':' || digest)), CAST(sum(n) AS BIGINT) FROM t WHERE level > 0 GROUP BY level, substr(p, 1, level - 1))
SELECT digest AS fingerprint, n FROM t WHERE level = 0"""


def changed_labels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Labels of vectors before and after a revision: some go, some change, some are new."""
    old = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    kept = old.where("vec_id % 10 <> 3").withColumn("label", F.when(F.col("vec_id") % 10 == 5, F.col("label") + 1).otherwise(F.col("label")))
    return old, kept.unionByName(old.where("vec_id % 10 = 7").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))


def q33_vector_diff(spark, sf_dir):
    old, new = changed_labels(spark, sf_dir)
    return keytree.diff(keytree.build(old, "vec_id"), keytree.build(new, "vec_id")).select(F.col("key").alias("vec_id"), "change")


_REVISED = """a AS (SELECT vec_id, label FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 10 = 5 THEN label + 1 ELSE label END AS label FROM a WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id + 1000000000, label FROM a WHERE vec_id % 10 = 7)"""
Q33 = f"""WITH {_REVISED} SELECT coalesce(b.vec_id, a.vec_id) AS vec_id, CASE WHEN a.vec_id IS NULL THEN 'added' WHEN b.vec_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.vec_id = b.vec_id WHERE a.vec_id IS NULL OR b.vec_id IS NULL OR a.label IS DISTINCT FROM b.label"""


def q48_versions(spark, sf_dir):
    """Three versions of a table: first rows, a revision, more rows; what each holds, and whether its files are those of its inventory."""
    old, new = changed_labels(spark, sf_dir)
    at = shared_folder(spark, "versions")
    snapshots.replace(old, at)
    snapshots.replace_changed(new, at, "vec_id")
    snapshots.append(old.where("vec_id % 10 = 3"), at)
    out = None
    for v in snapshots.versions(spark, at):
        one = snapshots.read(spark, at, v).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("labels"))
        bad = snapshots.verify(spark, at, v).agg(F.count("*").alias("problems"))
        row = one.join(bad).select(F.lit(v).cast("long").alias("version"), "n", "labels", "problems")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


Q48 = f"""WITH {_REVISED}, c AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE vec_id % 10 = 3)
SELECT 0::BIGINT AS version, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, 0::BIGINT AS problems FROM a UNION ALL SELECT 1, count(*), CAST(sum(label) AS BIGINT), 0 FROM b UNION ALL SELECT 2, count(*), CAST(sum(label) AS BIGINT), 0 FROM c"""


def q49_text_runs(spark, sf_dir):
    """Pieces of documents, one whole and one of two places with a break between them, found in their documents again."""
    docs = read(spark, sf_dir, "documents").where("length(text) >= 200").select("doc_id", "text")
    piece = lambda at, n: F.substring("text", at, n)
    chunks = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("whole").alias("chunk_id"), piece(51, 80).alias("text")), F.struct(F.lit("two").alias("chunk_id"), F.concat(piece(1, 60), F.lit("\x01"), piece(101, 60)).alias("text")))).alias("c")).select("doc_id", "c.*")
    found = textruns.chunk_runs(docs, chunks, normalise=None)
    return found.select("doc_id", "chunk_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


Q49 = """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
p AS (SELECT doc_id, text, 'whole' AS chunk_id, substr(text, 51, 80) AS piece FROM d UNION ALL SELECT doc_id, text, 'two', substr(text, 1, 60) FROM d UNION ALL SELECT doc_id, text, 'two', substr(text, 101, 60) FROM d)
SELECT doc_id, chunk_id, strpos(text, piece) - 1 AS start, strpos(text, piece) - 1 + length(piece) AS "end" FROM p"""



def q63_leased_tasks(spark, sf_dir):
    """Documents as tasks: a worker claims 100, fails at some of them, and the next one claims 50 more; where the tasks stand then."""
    at = shared_folder(spark, "tasks")
    tasks.plan(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id")), at)
    now = datetime.datetime(2024, 1, 1)
    mine = tasks.claim(spark, at, now, 3600, 100)
    tasks.finish(mine.select("task_id", "lease", F.when(F.col("task_id").cast("long") % 3 == 0, "failed").otherwise("ok").alias("status"), F.concat(F.lit("r"), "task_id").alias("result")), at)
    tasks.claim(spark, at, now, 3600, 50)
    return snapshots.read(spark, at).groupBy("status", "attempts").agg(F.count("*").alias("n"), F.min("task_id").alias("first"), F.max("result").alias("last_result"))


Q63 = """WITH t AS (SELECT DISTINCT doc_id::VARCHAR AS id FROM documents), a AS (SELECT id, row_number() OVER (ORDER BY id) <= 100 AS claimed FROM t), b AS (SELECT id, claimed, claimed AND CAST(id AS BIGINT) % 3 <> 0 AS ok FROM a),
c AS (SELECT *, NOT ok AND row_number() OVER (PARTITION BY ok ORDER BY id) <= 50 AS again FROM b)
SELECT CASE WHEN ok THEN 'ok' WHEN again THEN 'leased' ELSE 'pending' END AS status, CAST(claimed AS INTEGER) + CAST(again AS INTEGER) AS attempts, count(*) AS n, min(id) AS first, max(CASE WHEN ok THEN 'r' || id END) AS last_result FROM c GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (q33_vector_diff, q34_fingerprints, q43_stream_service_windows, q44_stream_admission, q45_stream_sessions, q47_stream_settlements, q48_versions, q49_text_runs, q63_leased_tasks)}
ORACLES = {"q33_vector_diff": Q33, "q34_fingerprints": Q34, "q43_stream_service_windows": Q43, "q44_stream_admission": Q44, "q45_stream_sessions": Q45, "q47_stream_settlements": Q47, "q48_versions": Q48, "q49_text_runs": Q49, "q63_leased_tasks": Q63}
