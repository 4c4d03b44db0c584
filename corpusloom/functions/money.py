"""Tariffs: peak hours, prices, usage records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of a million cached input, uncached input and output tokens at peak; times 0.5 off peak.
TARIFF = {"deepseek-v4-flash": (0.10, 3.0, 9.0), "deepseek-v4-pro": (0.30, 9.0, 27.0)}
ZONE = "Asia/Shanghai"


def is_peak(utc: Column) -> Column:
    """Whether a UTC time is on a weekday from 9 to 12 or 14 to 18 o'clock in the tariff's zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc.cast("timestamp_ntz"))
    hour = F.hour(local)
    return (F.weekday(local) < 5) & (((hour >= 9) & (hour < 12)) | ((hour >= 14) & (hour < 18)))


def interval_multiplier(start: Column, end: Column) -> Column:
    """1 if the start, the end or a full hour between them is at peak, else 0.5."""
    start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    first = F.date_trunc("hour", start).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    hours = F.when(first < end, F.sequence(first, end, F.expr("INTERVAL 1 HOUR"))).otherwise(F.array().cast("array<timestamp_ntz>"))
    return F.when(is_peak(start) | is_peak(end) | F.exists(F.filter(hours, lambda h: h < end), is_peak), 1.0).otherwise(0.5)


def price(model: str, prompt: Column, completion: Column, cached: Column, multiplier: Column | float = 1.0) -> Column:
    """Price of a call; null for counts that cannot be (more cached than sent, or less than none)."""
    per_cached, per_new, per_out = TARIFF[model]
    valid = (cached >= 0) & (cached <= prompt) & (completion >= 0)
    cost = ((prompt - cached) * per_new + cached * per_cached + completion * per_out) / 1e6 * (multiplier if isinstance(multiplier, Column) else F.lit(multiplier))
    return F.when(valid, cost)


def usage(raw: Column) -> Column:
    """Usage counts from a provider's JSON: cache hits by either name; null if a count is missing, no integer or impossible."""
    got = lambda path: F.get_json_object(raw, path)
    whole = lambda c: F.when(c.rlike(r"^-?\d+$"), c.cast("long"))
    hits = F.coalesce(got("$.prompt_cache_hit_tokens"), got("$.prompt_tokens_details.cached_tokens"), F.lit("0"))
    prompt, completion, cached = whole(got("$.prompt_tokens")), whole(got("$.completion_tokens")), whole(hits)
    reasoning = F.coalesce(whole(got("$.completion_tokens_details.reasoning_tokens")), F.lit(0))
    valid = (cached >= 0) & (cached <= prompt) & (completion >= 0)
    return F.when(valid, F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), cached.alias("cached_tokens"), reasoning.alias("reasoning_tokens")))


def input_upper_bound(messages_json: Column) -> Column:
    """Bytes of the messages and a margin for their framing: no tokeniser makes more tokens."""
    return F.octet_length(messages_json) + 1024


def forecast(model: str, messages_json: Column, max_tokens: Column, attempts: Column | int = 1) -> Column:
    """Upper bound of what a call can cost: nothing cached, every token of the limit, at peak, as often as it may be tried. Sum it over the calls."""
    return price(model, input_upper_bound(messages_json).cast("long"), max_tokens, F.lit(0)) * (attempts if isinstance(attempts, Column) else F.lit(attempts))


def retry_class(status: Column, finish: Column) -> Column:
    """What a call's outcome leads to: by HTTP status (null: none came) and finish reason."""
    return (
        F.when(status.isin(401, 403), "authentication_failed")
        .when(status.isNull() | (status == 429) | (status >= 500), "retry")
        .when(status >= 400, "failed")
        .when(F.coalesce(finish, F.lit("")) != "stop", "failed")
        .otherwise("ok")
    )
