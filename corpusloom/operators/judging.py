"""Judging: validation of verdicts, and summaries that keep unknowns and failures in the denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values.
SCOPES = ("external_fact", "context_availability", "assistant_capability", "non_assertion")
COVERAGE = ("covered", "missing", "contradicted")


def _blank(c: Column) -> Column:
    return c.isNull() | (T.strip(c) == "")


def units_valid(units: Column, answer: Column, valid_ids: Column) -> Column:
    """Whether claims (text, scope, supported, ids, reason) quote the answer, each once, with consistent support."""
    texts = F.transform(units, lambda u: u["text"])

    def one(u: Column) -> Column:
        external = u["scope"] == "external_fact"
        ids_ok = (F.size(F.array_except(u["ids"], valid_ids)) == 0) & (F.size(F.array_distinct(u["ids"])) == F.size(u["ids"]))
        support = F.when(external, u["supported"].isNotNull() & (u["supported"] == (F.size(u["ids"]) > 0))).otherwise(u["supported"].isNull() & (F.size(u["ids"]) == 0))
        return ~_blank(u["text"]) & F.contains(answer, u["text"]) & u["scope"].isin(*SCOPES) & ~_blank(u["reason"]) & ids_ok & support

    return (F.size(F.array_distinct(texts)) == F.size(texts)) & F.forall(units, lambda u: F.coalesce(one(u), F.lit(False)))


def faithfulness(units: Column) -> Column:
    """Mean support of external facts; null where there is none."""
    facts = F.filter(units, lambda u: u["scope"] == "external_fact")
    return F.when(F.size(facts) > 0, F.aggregate(facts, F.lit(0.0), lambda a, u: a + u["supported"].cast("double")) / F.size(facts))


def excluded_scopes(units: Column) -> Column:
    """Number of other claims by scope, as a map without zeros."""
    pairs = F.array(*[F.struct(F.lit(s).alias("k"), F.size(F.filter(units, _in_scope(s))).alias("v")) for s in SCOPES[1:]])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def _in_scope(name: str):
    return lambda u: u["scope"] == name


def checks_valid(verdict: Column, label: Column, answer: Column) -> Column:
    """Whether a correctness verdict (correct, observed_action, behavior_ok, extra_claims_supported, checks, reason) is sound.

    Each check (requirement, coverage, response_quote, reason) has its own requirement; a missing one quotes nothing, any
    other quotes the answer; the decision follows from its parts.
    """
    checks = verdict["checks"]
    names = F.transform(checks, lambda c: c["requirement"])

    def one(c: Column) -> Column:
        quote = F.when(c["coverage"] == "missing", c["response_quote"] == "").otherwise(~_blank(c["response_quote"]) & F.contains(answer, c["response_quote"]))
        return ~_blank(c["requirement"]) & c["coverage"].isin(*COVERAGE) & quote & ~_blank(c["reason"])

    decided = verdict["behavior_ok"] & verdict["extra_claims_supported"] & F.forall(checks, lambda c: c["coverage"] == "covered")
    sound = (
        verdict["observed_action"].isin("answer", "clarify", "refuse") & ~_blank(verdict["reason"]) & ((label != "answer") | (F.size(checks) > 0))
        & (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(checks, lambda c: F.coalesce(one(c), F.lit(False))) & (verdict["correct"] == decided)
    )
    return F.coalesce(sound, F.lit(False))


def relevance_verdict(raw: Column) -> Column:
    """0 or 1 from a JSON text with exactly an integer ``verdict`` and a ``reason``; null for anything else, booleans and strings too."""
    keys = F.array_sort(F.json_object_keys(raw)) == F.array(F.lit("reason"), F.lit("verdict"))
    whole = F.regexp_extract(raw, r'"verdict"\s*:\s*([01])\s*[,}]', 1)
    return F.when(keys & (whole != "") & ~_blank(F.get_json_object(raw, "$.reason")) & raw.rlike(r'"reason"\s*:\s*"'), whole.cast("int"))


def average_precision(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean precision at the relevant ranks of ``verdicts(rank, verdict)``; null as soon as one verdict is missing, 0 if none is relevant."""
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = verdicts.withColumn("_p", F.sum("verdict").over(w) / F.count("*").over(w))
    total = F.sum("verdict")
    score = F.when(F.count_if(F.col("verdict").isNull()) > 0, F.lit(None).cast("double")).when(total == 0, 0.0).otherwise(F.sum(F.col("_p") * F.col("verdict")) / total)
    return running.groupBy(*keys).agg(score.alias("score"))


def bounds(total: Column, missing: Column, n: Column) -> tuple[Column, Column]:
    """The least and the greatest mean, if all missing scores were 0 or 1; null for nothing."""
    return F.try_divide(total.cast("double"), n), F.try_divide((total + missing).cast("double"), n)


def summary(cases: DataFrame, judgments: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of ``cases(candidate, question_id, status, label)`` with ``judgments(candidate, question_id, metric, status, score)``.

    Correctness: over all planned cases; a failed generation is wrong, one not submitted or not judged is unknown. Faithfulness: over
    cases with facts, unknown ones between 0 and 1. Context precision: over answer cases, also where generation failed.
    """
    ok = judgments.where("status = 'ok'")
    one = lambda m: ok.where(F.col("metric") == m).select("candidate", "question_id", F.col("score").alias(m), F.lit(True).alias(f"has_{m}"))
    j = cases
    for m in ("correctness", "faithfulness", "context_precision"):
        j = j.join(one(m), ["candidate", "question_id"], "left")
    generated, waiting = F.col("status") == "ok", F.col("status") == "not_submitted"
    has = lambda m: F.coalesce(F.col(f"has_{m}"), F.lit(False))
    answerable = F.col("label") == "answer"
    out = j.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(~generated & ~waiting).alias("failures"),
        F.coalesce(F.sum(F.when(generated & has("correctness"), F.col("correctness"))), F.lit(0.0)).alias("correct"),
        F.count_if(waiting | (generated & ~has("correctness"))).alias("unknown"),
        F.count_if(generated & has("faithfulness") & F.col("faithfulness").isNotNull()).alias("faith_n"),
        F.coalesce(F.sum(F.when(generated, F.col("faithfulness"))), F.lit(0.0)).alias("faith_sum"),
        F.count_if(generated & has("faithfulness") & F.col("faithfulness").isNull()).alias("no_fact"),
        F.count_if(generated & ~has("faithfulness")).alias("faith_unknown"),
        F.count_if(answerable & has("context_precision")).alias("cp_n"),
        F.coalesce(F.sum(F.when(answerable, F.col("context_precision"))), F.lit(0.0)).alias("cp_sum"),
        F.count_if(answerable & ~has("context_precision")).alias("cp_unknown"),
    )
    sides = {"correctness": ("correct", "unknown", F.col("n")), "faithfulness": ("faith_sum", "faith_unknown", F.col("faith_n") + F.col("faith_unknown")), "context_precision": ("cp_sum", "cp_unknown", F.col("cp_n") + F.col("cp_unknown"))}
    for m, (total, missing, n) in sides.items():
        lo, hi = bounds(F.col(total), F.col(missing), n)
        out = out.withColumn(f"{m}_lo", lo).withColumn(f"{m}_hi", hi)
    return out


def threshold_status(lo: Column, hi: Column, target: float) -> Column:
    return F.when(lo >= target, "met").when(hi < target, "not_met").when(lo.isNotNull(), "indeterminate_due_to_unknown_scores")
