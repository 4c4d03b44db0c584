"""Evaluation releases: evidence groups, reviewed items, and the rules that a release, a bundle and a reuse must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .integrity import duplicates, rules

#: Fixed value: a reviewer's mark for 'as in the source'.
SOURCE = "=SOURCE"


def group_evidence(flat: DataFrame, key: str, attributes: list[str], span: list[str]) -> DataFrame:
    """(key, evidence): spans (``pos`` orders them) gathered by document, documents in order of first mention with their first attributes."""
    docs = flat.groupBy(key, "doc_id").agg(F.min("pos").alias("_first"), *[F.min_by(a, "pos").alias(a) for a in attributes], F.array_sort(F.collect_list(F.struct("pos", F.struct(*span).alias("span")))).alias("_spans"))
    one = F.struct("_first", F.struct("doc_id", *attributes, F.transform("_spans", lambda x: x["span"]).alias("spans")).alias("d"))
    return docs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("evidence"))


def reviewed(candidates: DataFrame, reviews: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Candidates with the reviewers' columns; '=SOURCE' keeps the candidate's own value. A candidate without a review is an error."""
    marks = reviews.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_seen"))
    joined = candidates.join(marks, key, "left")
    checked = joined.where(F.when(F.col("_seen").isNull(), F.raise_error("a candidate has no review").cast("boolean")).otherwise(True))
    return checked.select(*[F.when(F.col(f"_r_{c}") == SOURCE, F.col(c)).otherwise(F.col(f"_r_{c}")).alias(c) if c in columns else F.col(c) for c in candidates.columns])


def runtime_item(answerable: Column, item: dict[str, Column]) -> list[Column]:
    """Columns of an item as it is evaluated: answers and evidence only where it is answerable."""
    empty = F.array().cast("array<string>")
    return [
        F.when(answerable, item["gold_answer"]).alias("gold_answer"),
        F.when(answerable, F.array_sort(F.array_distinct(item["answer_doc_ids"]))).otherwise(empty).alias("answer_doc_ids"),
        F.when(answerable, F.array_sort(F.array_distinct(item["answer_evidence_ids"]))).otherwise(empty).alias("answer_evidence_ids"),
    ]


def review_violations(review: dict[str, Column], required: list[str]) -> Column:
    """Names of what is wrong with a review: not approved, an unknown label, required fields left empty."""
    blank = lambda c: c.isNull() | (T.strip(c) == "")
    return F.array_compact(F.array(
        F.when(~review["status"].eqNullSafe(F.lit("approved")), F.lit("not_approved")),
        F.when(~F.coalesce(review["label"].isin("answer", "clarify", "refuse"), F.lit(False)), F.lit("unknown_label")),
        *[F.when(blank(review[c]), F.lit(f"empty_{c}")) for c in required],
    ))


def release_rules(dev: DataFrame, holdout: DataFrame, smoke: DataFrame, exposed: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(rule, violations) of a release: unique questions and dialogues, no overlap, nothing exposed in the holdout, smoke inside dev unchanged, quotas met."""
    both = dev.unionByName(holdout)
    found = {"repeated_question": duplicates(both, "question_id"), "repeated_dialogue": duplicates(both, "dialogue_id"), "shared_dialogue": dev.join(holdout, "dialogue_id", "left_semi"), "exposed_holdout": holdout.join(exposed, "dialogue_id", "left_semi"), "smoke_not_in_dev": smoke.exceptAll(dev.select(smoke.columns))}
    for label, n in quotas.items():
        for name, split in (("dev", dev), ("holdout", holdout)):
            found[f"quota_{name}_{label}"] = split.agg(F.count_if(F.col("label") == label).alias("n")).where(F.col("n") != n)
    return rules(found)


def bundle_rules(candidates: DataFrame, questions: DataFrame, cases: DataFrame) -> DataFrame:
    """(rule, violations) of a bundle: each candidate answers each question once, with unique contexts, and responses only where it is ok."""
    plan = candidates.select("candidate").distinct().join(questions.select("question_id").distinct(), F.lit(True))
    keys = ["candidate", "question_id"]
    repeated = F.size(F.array_distinct(F.transform("contexts", lambda c: c["chunk_id"]))) < F.size("contexts")
    return rules({"missing": plan.join(cases, keys, "left_anti"), "unplanned": cases.join(plan, keys, "left_anti"), "repeated": duplicates(cases, *keys), "repeated_context": cases.where(repeated), "response_without_ok": cases.where((F.col("status") != "ok") & F.col("response").isNotNull())})


def reusable(before: DataFrame, after: DataFrame, key: str = "question_id") -> DataFrame:
    """Generations that hold for a later release: the same messages and the same request hash."""
    now = after.select(key, F.sha2(F.col("messages").cast("binary"), 256).alias("_m"), F.col("request_hash").alias("_h"))
    return before.join(now, key).where((F.sha2(F.col("messages").cast("binary"), 256) == F.col("_m")) & (F.col("request_hash") == F.col("_h"))).select(*before.columns)


def document_format(docs: Column) -> Column:
    """Format of the first of an item's documents."""
    return F.coalesce(F.get(docs, 0)["format"], F.lit("unknown"))


def distinct_inputs(verdicts: DataFrame, *columns: str, by: list[str] | None = None) -> DataFrame:
    """Exact number of different inputs: a hash of the columns, length and null of each kept apart, is counted once."""
    whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return verdicts.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_distinct(whole).alias("distinct_inputs"))


def changed_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two versions side by side by their place (such as split and ordinal): (key, before_sha256, after_sha256, changed_fields).

    Only rows that differ are returned; a place that one version lacks differs in all fields and has a null hash there.
    """
    fields = sorted((set(before.columns) | set(after.columns)) - set(key))

    def side(df: DataFrame, name: str) -> DataFrame:
        values = [F.to_json(F.struct(F.col(c).alias("v"))) if c in df.columns else F.lit(None).cast("string") for c in fields]
        whole = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(set(df.columns) - set(key))]), {"ignoreNullFields": "false"}).cast("binary"), 256)
        return df.select(*key, F.array(*values).alias(f"_{name}"), whole.alias(f"{name}_sha256"))

    both = side(before, "before").join(side(after, "after"), key, "full")
    value = lambda name, i: F.get(F.col(f"_{name}"), i)
    missing = F.col("before_sha256").isNull() | F.col("after_sha256").isNull()
    named = F.array_compact(F.array(*[F.when(missing | ~value("before", i).eqNullSafe(value("after", i)), F.lit(c)) for i, c in enumerate(fields)]))
    return both.select(*key, "before_sha256", "after_sha256", named.alias("changed_fields")).where(F.size("changed_fields") > 0)
