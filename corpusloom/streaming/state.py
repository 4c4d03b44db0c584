"""Streams in event time: session histories, budget admission, reservations with their settlements, request deduplication, service levels.

Operators that depend on order (sessions, budgets) hold a row until the watermark has passed it and then take rows in the order of their time, so
the result is the same however the rows are dealt into files and batches, as long as none comes later than ``delay``. Rows that do
come later are returned as such and change nothing; so are times up to 1970, where a watermark begins. What is held for a key: its pending rows, and what the operator needs of those before; keys are dealt into SHARDS states.

A source that has ended advances the watermark by a heartbeat: a row whose key is null, with a later time. It goes no further.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions import text as T

#: States of keys are kept in RocksDB, outside the JVM's heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys that share a state. A call to Python for each key and batch takes milliseconds, whatever its rows are.
SHARDS = 512
#: Partitions for these: 8 groups each, as every partition opens a store in every batch.
SHARD_PARTITIONS = SHARDS // 8


class InOrder(StatefulProcessor):
    """Rows of each ``key`` of a shard in the order of their time, once the watermark has passed them; ``step`` and ``late`` say what they become.

    ``columns`` of a row are kept while it waits; the first is its time in microseconds, and rows of one time are taken in the order of the
    other columns. The state of a shard is one value: its timer, and pickled the tuple of each key (``start`` at first) with the time of its last row, and the waiting rows, each with its
    key at the end. If ``idle`` is not None, a key whose last row is longer ago is forgotten.
    """

    def __init__(self, key: str, columns: dict[str, str], start: tuple, out: list[str], step, late, idle: int | None = None):
        self.key, self.columns, self.start, self.out, self.step, self.late, self.idle = key, columns, start, out, step, late, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", StructType().add("timer_ms", "long").add("held", "binary"))

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        fresh, late = [], []
        for batch in rows:
            for r in zip(*[_values(batch[c], kind) for c, kind in self.columns.items()], batch[self.key].tolist()):
                (late if r[0] <= passed else fresh).append(r)
        if fresh:
            timer, memory, waiting = self._held()
            self._hold(timer, memory, waiting + fresh, min(r[0] for r in fresh))
        if late:
            yield self._frame([self.late((r[-1],), r[:-1]) for r in _in_turn(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        timer, memory, waiting = self._held()
        out, rest = [], [r for r in waiting if r[0] > passed]
        for r in _in_turn([r for r in waiting if r[0] <= passed]):
            kept, last = memory.get(r[-1], (self.start, None))
            if self.idle is not None and last is not None and r[0] - last > self.idle:
                kept = self.start
            kept, row = self.step((r[-1],), kept, r[:-1])
            memory[r[-1]] = kept, r[0]
            if row is not None:
                out.append(row)
        ends = []
        if self.idle is not None:
            memory = {k: m for k, m in memory.items() if m[1] + self.idle >= passed}
            ends = [last + self.idle + 1 for _, last in memory.values()]
        if timer is not None and timer * 1000 <= passed:
            timer = None  # it is this one, or came before
        if rest or memory:
            self._hold(timer, memory, rest, min([r[0] for r in rest] + ends, default=None))
        else:
            self.kept.clear()
        if out:
            yield self._frame(out)

    def _held(self) -> tuple:
        import pickle

        kept = self.kept.get()
        return (kept[0], *pickle.loads(kept[1])) if kept else (None, {}, [])

    def _hold(self, timer: int | None, memory: dict, waiting: list, next_us: int | None) -> None:
        """With a timer for when the watermark, in whole milliseconds, has passed ``next_us``, if none comes before."""
        import pickle

        at = None if next_us is None else -(-next_us // 1000)
        if at is not None and (timer is None or at < timer):
            self.handle.registerTimer(at)
            timer = at
        self.kept.update((timer, pickle.dumps((memory, waiting), 5)))

    def _frame(self, rows):
        import pandas as pd

        return pd.DataFrame(rows, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def _values(column, kind: str) -> list:
    """Of a column of a frame, with None for what is null; whole numbers among nulls, which come as fractions, are whole again."""
    if column.dtype.kind in "iub":
        return column.tolist()
    whole = int if kind == "long" else (lambda v: v)
    return [None if v is None or v != v else whole(v) for v in column.tolist()]


def _in_turn(rows: list[tuple]) -> list[tuple]:
    try:
        return sorted(rows)
    except TypeError:  # nulls come first
        return sorted(rows, key=lambda row: tuple((v is not None, v) for v in row))


def _real(row: Column) -> Column:
    """Rows that are no heartbeat. The condition reads the time, so it is not moved to before the watermark, which heartbeats must reach."""
    return F.when(F.col("ts").isNull(), F.lit(False)).otherwise(row)


def _in_order(stream: DataFrame, delay: str, processor: InOrder, out: str) -> DataFrame:
    spark, key = stream.sparkSession, processor.key
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    held = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where(_real(F.col(key).isNotNull()))
    # the time as a number, so that late rows come to the operator instead of being dropped before it
    timed = held.withColumn("at_us", F.unix_micros("ts")).select(F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("shard"), key, *processor.columns)
    return timed.groupBy("shard").transformWithStateInPandas(processor, out, "Append", "EventTime")


def session_turns(turns: DataFrame, delay: str = "0 seconds", idle_seconds: int | None = None) -> DataFrame:
    """Numbered turns with the history before them, from ``turns(session_id, ts, question, answer, ok, reset)``.

    Failed turns are numbered but not remembered; a reset starts a new history, and so does a pause of more than ``idle_seconds`` of event time,
    after which the session's state is dropped. ``late`` marks turns that came after the watermark: they have no number and no history.
    """

    def step(key, memory, row):
        number, history = memory
        _, question, answer, ok, reset = row
        if reset:
            return (0, ""), None
        number += 1
        told = f"user: {question}\nagent: {answer}"
        after = history if not ok else told if not history else f"{history}\n{told}"
        return (number, after), (key[0], number, history, question, bool(ok), False)

    def late(key, row):
        return key[0], None, None, row[1], bool(row[3]), True

    columns = {"at_us": "long", "question": "string", "answer": "string", "ok": "boolean", "reset": "boolean"}
    names = ["session_id", "turn_id", "history", "question", "ok", "late"]
    run = InOrder("session_id", columns, (0, ""), names, step, late, None if idle_seconds is None else idle_seconds * 1_000_000)
    kind = turns.schema["session_id"].dataType.simpleString()
    return _in_order(turns, delay, run, f"session_id {kind}, turn_id int, history string, question string, ok boolean, late boolean")


def admitted_calls(calls: DataFrame, cap: float, tolerance: float = 1e-12, delay: str = "0 seconds") -> DataFrame:
    """Calls ``(account, ts, call_id, amount)`` admitted while an account's reservations fit its cap, in the order of time and id.

    State is what is reserved. A call that comes after the watermark is ``late`` and not admitted; its ``spent`` is null.
    """

    def step(key, memory, row):
        (spent,), (_, call_id, amount) = memory, row
        if amount is None:
            return memory, (key[0], call_id, None, spent, False)
        fits = spent + amount <= cap + tolerance
        spent += amount if fits else 0.0
        return (spent,), (key[0], call_id, fits, spent, False)

    def late(key, row):
        return key[0], row[1], False, None, True

    run = InOrder("account", {"at_us": "long", "call_id": "long", "amount": "double"}, (0.0,), ["account", "call_id", "admitted", "spent", "late"], step, late)
    kind = calls.schema["account"].dataType.simpleString()
    return _in_order(calls, delay, run, f"account {kind}, call_id long, admitted boolean, spent double, late boolean")


def settled_attempts(reserved: DataFrame, settled: DataFrame, open_for: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Reservations ``(attempt_id, ts, reserved, ...)`` with their settlement ``(attempt_id, ts, accounted, ...)`` and ``upper``, what they may have cost.

    A settlement counts if it comes within ``open_for`` of its reservation; a reservation without one comes out at its own amount
    when the watermark says that its time is over, and is dropped from the state. The first settlement of an attempt counts. Both streams must go on (or send heartbeats) for the watermark to advance.
    """
    key = F.coalesce(F.col("attempt_id").cast("string"), F.lit(""))  # a heartbeat has a key that no reservation has
    left = reserved.withWatermark("ts", delay).where(_real(F.col("attempt_id").isNotNull())).withColumn("reserved_id", key).withColumnRenamed("ts", "reserved_at")
    once = settled.withWatermark("ts", delay).withColumn("settled_id", key).dropDuplicatesWithinWatermark(["settled_id"])
    right = once.withColumnRenamed("ts", "settled_at").drop("attempt_id")
    same = (F.col("reserved_id") == F.col("settled_id")) & (F.col("settled_at") >= F.col("reserved_at")) & (F.col("settled_at") <= F.col("reserved_at") + F.expr(f"INTERVAL {open_for}"))
    return left.join(right, same, "left_outer").drop("reserved_id", "settled_id").withColumn("upper", F.coalesce("accounted", "reserved"))


def first_requests(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests whose exact input has not been answered before within the watermark; failures are not cached, so each of them passes."""
    hashed = requests.withColumn("request_hash", F.sha2(F.col("messages").cast("binary"), 256)).withWatermark("ts", delay)
    good = F.coalesce(F.col("status") == "ok", F.lit(False))
    return hashed.where(good).dropDuplicatesWithinWatermark(["request_hash"]).unionByName(hashed.where(~good))


#: Bits of a latency that its bucket keeps: a bucket's middle is off by at most a 2 ** SKETCH_BITS th of the value.
SKETCH_BITS = 7


def latency_bucket(ms: Column) -> Column:
    """First microsecond of a latency's bucket: its leading bits, the others 0. Negative latencies count as 0."""
    us = F.greatest(F.floor(ms * 1000).cast("long"), F.lit(0).cast("long"))
    return F.call_function("shiftleft", F.call_function("shiftright", us, _exponent(us)), _exponent(us))


def _exponent(us: Column) -> Column:
    return F.greatest(F.length(F.bin(us)) - SKETCH_BITS, F.lit(0)).cast("int")


def sketch_quantile(buckets: Column, p: float) -> Column:
    """Milliseconds of the ``p`` quantile (nearest rank) of an array of ``(bucket, n)``: the middle of its bucket; null if there is none."""
    sorted_ = F.array_sort(F.filter(buckets, lambda b: b["n"] > 0))
    total = F.aggregate(sorted_, F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
    rank = F.ceil(total * p).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
    step = lambda acc, b: F.struct((acc["seen"] + b["n"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + b["n"] >= rank), b["bucket"]).otherwise(acc["at"]).alias("at"))
    at = F.aggregate(sorted_, start, step)["at"]
    return (at + F.call_function("shiftleft", F.lit(1).cast("long"), _exponent(at)) / 2) / 1000


def service_windows(requests: DataFrame, width: str = "1 day", delay: str = "1 hour", limit_ms: float = 10_000) -> DataFrame:
    """``requests(ts, ok, ms)`` by tumbling event-time window: requests, successes within the limit, latency in all, and p50 and p90 of the successes.

    Percentiles come from counts by latency bucket, which add up over partitions, batches and windows: a window has a few thousand at most, and a percentile is
    within 1 / 128 of the exact one (nearest rank). Windows come out once, when the watermark has passed them, and their counts are dropped.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where(_real(F.col("ok").isNotNull() & F.col("ms").isNotNull()))
    by_bucket = timed.groupBy(F.window("ts", width).alias("w"), latency_bucket(F.col("ms")).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if("ok").alias("good"), F.count_if(F.col("ok") & (F.col("ms") <= limit_ms)).alias("within"), F.sum("ms").alias("ms")
    )
    whole = by_bucket.groupBy(F.window("w", width).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("within").alias("within"), F.round(F.sum("ms"), 6).alias("total_ms"), F.collect_list(F.struct("bucket", F.col("good").alias("n"))).alias("sketch")
    )
    return whole.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "within", "total_ms", sketch_quantile(F.col("sketch"), 0.5).alias("p50_ms"), sketch_quantile(F.col("sketch"), 0.9).alias("p90_ms"))


def redacted(events: DataFrame) -> DataFrame:
    """A stream's string columns without personal data."""
    return events.select(*[T.redact(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in events.schema.fields])


#: Partitions of a state that does not grow with the rows of its stream, as the counts of ``service_windows``. Each partition of a state writes files in every batch, with rows or without.
FEW = 8


@contextlib.contextmanager
def _at_most(spark: SparkSession, partitions: int | None):
    """Queries that start inside have so many partitions of a state at most. A query copies the session's settings when it starts, so the session has its own again when that is done."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    if partitions is not None and partitions < int(own):
        spark.conf.set(name, partitions)
    try:
        yield
    finally:
        spark.conf.set(name, own)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Process what is there, into a table at ``path``, and read it. Other modes than append keep each batch's last whole result.

    States have the session's shuffle partitions, or ``partitions`` if those are fewer; a query that goes on from its checkpoint keeps the number it began with.
    """
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    with _at_most(spark, partitions):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
