"""Cost ledger: receipts of reservations and settlements, spending, admission under a budget, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a sum of money may pass a cap.
TOLERANCE = 1e-12


def receipts(events: DataFrame) -> DataFrame:
    """One row for each attempt: its reservation, overlaid by its settlement where there is one."""
    reserve = events.where("event = 'reserve'").select("attempt_id", "time_utc", "reserved")
    settle = events.where("event = 'settle'").select("attempt_id", "accounted", "usage_unknown", "prompt_tokens", "completion_tokens", "cached_tokens", F.lit(True).alias("settled"))
    return reserve.join(settle, "attempt_id", "left").withColumn("upper", F.coalesce("accounted", "reserved"))


def spending(got: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attempts, upper bound of what was spent, attempts of unknown usage, tokens of the known ones, first and last time."""
    unknown = F.coalesce("usage_unknown", F.lit(True))
    known = lambda c: F.coalesce(F.sum(F.when(~unknown, F.col(c))), F.lit(0)).alias(c)
    return got.groupBy(*(by or [])).agg(F.count("*").alias("attempts"), F.round(F.sum("upper"), 6).alias("accounted"), F.count_if(unknown).alias("unknown_usage"), known("prompt_tokens"), known("completion_tokens"), known("cached_tokens"), F.min("time_utc").alias("first_utc"), F.max("time_utc").alias("last_utc"))


def admit(calls: DataFrame, key: str, cap: float) -> DataFrame:
    """``calls(key, ordinal, amount)`` in order with ``admitted`` and the spending after each; rejected calls cost nothing.

    Later decisions depend on earlier ones, so a key's calls are sorted within its partition and folded as they stream by: what
    is held is one sum, whatever the length of a key's history. A call without an amount is neither admitted nor rejected.
    """
    kind = calls.schema[key].dataType.simpleString()
    ordered = calls.select(F.col(key), F.col("ordinal").cast("long").alias("ordinal"), F.col("amount").cast("double").alias("amount")).repartition(key).sortWithinPartitions(key, "ordinal", F.col("amount").asc_nulls_last())

    def run(batches):
        import pyarrow as pa

        owner, spent = None, 0.0
        for batch in batches:
            keys, amounts = batch.column(0), batch.column(2).to_pylist()
            fits, sums = [], []
            for k, amount in zip(keys.to_pylist(), amounts, strict=True):
                if (k,) != owner:
                    owner, spent = (k,), 0.0
                fit = None if amount is None else spent + amount <= cap + TOLERANCE
                spent += amount if fit else 0.0
                fits.append(fit)
                sums.append(spent)
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), batch.column(2), pa.array(fits, pa.bool_()), pa.array(sums, pa.float64())], names=[key, "ordinal", "amount", "admitted", "spent"])

    return ordered.mapInArrow(run, f"`{key}` {kind}, ordinal long, amount double, admitted boolean, spent double")


def stage_latencies(marks: dict[str, Column]) -> list[Column]:
    """Milliseconds from each mark to the next, named after the later one, and ``total_ms``; marks are timestamps in order."""
    names = list(marks)
    ms = lambda a, b: F.unix_micros(marks[b].cast("timestamp")) / 1000 - F.unix_micros(marks[a].cast("timestamp")) / 1000
    return [*(ms(a, b).alias(f"{b}_ms") for a, b in zip(names, names[1:], strict=False)), ms(names[0], names[-1]).alias("total_ms")]


def acceptance(turns: DataFrame, load: DataFrame, limit_s: float = 10) -> DataFrame:
    """One row over ``turns(session_id, http_status, status)`` and ``load(http_status, wall_seconds)``: what succeeded, and how fast."""
    good = F.col("http_status") == 200
    spoken = turns.agg(F.count("*").alias("turns"), F.count_if(good & (F.col("status") == "ok")).alias("turns_ok"), F.count_distinct("session_id").alias("sessions"))
    served = load.agg(F.count("*").alias("requests"), F.count_if(good).alias("http_200"), F.count_if(good & (F.col("wall_seconds") <= limit_s)).alias("within_limit"), F.max("wall_seconds").alias("max_seconds"))
    return spoken.join(served)  # one row each


def service_level(requests: DataFrame, planned: Column, by: list[str], limit_ms: float = 10_000) -> DataFrame:
    """Latency percentiles of ``requests(ok, ms)``, and successes within the limit over all planned requests."""
    good = F.when(F.col("ok"), F.col("ms"))
    return requests.groupBy(*by).agg(
        F.count("*").alias("submitted"),
        F.count_if("ok").alias("succeeded"),
        F.round(F.percentile(good, 0.5), 6).alias("p50"),
        F.round(F.percentile(good, 0.9), 6).alias("p90"),
        F.max("ms").alias("max_ms"),
        F.round(F.try_divide(F.count_if(F.col("ok") & (F.col("ms") <= limit_ms)), planned), 6).alias("within"),
    )


def per_thousand(cost: Column, n: Column) -> Column:
    return F.try_divide(cost * 1000, n)
