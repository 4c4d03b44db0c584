"""Tasks that survive their workers: leases on pending tasks, and streams that write each batch once.

Tasks are a table in versions. A worker claims tasks for a time and finishes them under the claim; claims and results are versions of the table, so of two
workers that want the same task one gets it, and the other, called again on the newer version, gets others. A task whose lease has run out may be claimed again; what its
first worker brings afterwards is not taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.tables import written

TASKS = "task_id string, status string, lease string, until timestamp, attempts int, result string"


def plan(tasks: DataFrame, path: str) -> int:
    """The table of ``tasks(task_id)``, all pending, as a first version; tasks that are there already stay as they are, so a plan may be given again and may grow."""
    fresh = tasks.select(F.col("task_id").cast("string").alias("task_id")).where("task_id IS NOT NULL").distinct()
    pending = fresh.select("task_id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("lease"), F.lit(None).cast("timestamp").alias("until"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("result"))

    def change(last):
        if last is None:
            return pending
        more = written(pending.join(last, "task_id", "left_anti"), "tasks")
        return None if more.isEmpty() else last.unionByName(more)

    return snapshots.update(tasks.sparkSession, path, change)


def claim(spark: SparkSession, path: str, now, seconds: int, limit: int, put=snapshots.put_if_absent) -> DataFrame:
    """(task_id, lease, attempts) of the first ``limit`` tasks by id that are pending or whose lease has run out at ``now``, leased for ``seconds``. Empty if there are none."""
    lease = uuid.uuid4().hex

    def change(last):
        free = last.where((F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("until") <= F.lit(now))))
        taken = written(free.orderBy("task_id").limit(limit).select("task_id", F.lit(True).alias("mine")), "claimed")
        if taken.isEmpty():
            return None
        mine = F.coalesce("mine", F.lit(False))
        new = {"status": F.lit("leased"), "lease": F.lit(lease), "until": F.lit(now) + F.make_dt_interval(secs=F.lit(seconds)), "attempts": F.col("attempts") + 1}
        return last.join(taken, "task_id", "left").select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in last.columns])

    snapshots.update(spark, path, change, put=put)
    return snapshots.read(spark, path).where(F.col("lease") == lease).where("status = 'leased'").select("task_id", "lease", "attempts")


def finish(results: DataFrame, path: str, put=snapshots.put_if_absent) -> int:
    """Take ``results(task_id, lease, status, result)`` with status 'ok' or 'failed', of leases that still hold; returns how many were taken. Given twice, they count once.

    A failed task is pending again.
    """
    given = written(results.select("task_id", "lease", F.col("status").alias("_status"), F.col("result").alias("_result")).dropDuplicates(["task_id", "lease"]), "results")
    taken = 0

    def change(last):
        nonlocal taken
        held = last.where("status = 'leased'").select("task_id", "lease").join(given, ["task_id", "lease"])
        done = written(held.select("task_id", "_status", "_result"), "finished")
        taken = done.count()
        if not taken:
            return None
        ok, mine = F.col("_status") == "ok", F.col("_status").isNotNull()
        new = {"status": F.when(ok, "ok").otherwise("pending"), "lease": F.lit(None).cast("string"), "until": F.lit(None).cast("timestamp"), "result": F.when(ok, F.col("_result"))}
        return last.join(done, "task_id", "left").select(*[F.when(mine, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in last.columns])

    snapshots.update(results.sparkSession, path, change, put=put)
    return taken


def write_once(stream: DataFrame, path: str, checkpoint: str, name: str, put=snapshots.put_if_absent) -> None:
    """Append what is there of a stream to a table in versions, each batch as one version; a batch that is run again after a crash is not repeated. ``name`` says whose batches they are."""

    def one(df: DataFrame, batch: int) -> None:
        snapshots.append(df, path, put=put, batch=(name, batch))

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
