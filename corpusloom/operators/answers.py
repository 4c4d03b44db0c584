"""Answering: input limits, the confidence gate, prompts, schema and citation checks, history, request traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Limits:
    """Bounds of a service; checked when made."""

    question_characters: int = 8000
    history_messages: int = 40
    history_characters: int = 40_000
    confidence: float = 0.55
    latency_ms: float = 10_000

    def __post_init__(self):
        if min(self.question_characters, self.history_messages, self.history_characters) <= 0 or not 0 <= self.confidence <= 1:
            raise ValueError("limits out of range")


#: The answer of a refusal.
REFUSAL_EN = "I don't have enough relevant information in this knowledge base. Please clarify the question or ask about the covered services."
REFUSAL_ZH = "知识库中没有足够的相关信息。请补充问题细节，或询问知识库覆盖的服务。"
ACTIONS = ("answer", "clarify", "refuse")
GENERATION = "answer string, citations array<string>, action string"


def refusal_reason(n_chunks: Column, top_dense: Column, limits: Limits = Limits()) -> Column:
    """Why to refuse before anything is generated, by the best dense score (not the re-ranked one); null to go on."""
    return F.when(n_chunks == 0, "no_retrieval_results").when(top_dense < limits.confidence, "low_retrieval_confidence")


def input_error(question: Column, history: Column, limits: Limits = Limits()) -> Column:
    """The first limit that a question or its history (role, utterance) breaks; null if none."""
    total = F.aggregate(history, F.lit(0), lambda a, t: a + F.length(t["utterance"]))
    bad = F.exists(history, lambda t: t["role"].isNull() | ~t["role"].isin("user", "agent") | t["utterance"].isNull())
    return (
        F.when(question.isNull() | (T.strip(question) == "") | (F.length(question) > limits.question_characters), "question")
        .when(F.size(history) > limits.history_messages, "history_messages")
        .when(bad, "history_role")
        .when(total > limits.history_characters, "history_characters")
    )


def history_bucket(turns: Column) -> Column:
    return F.when(turns == 0, "none").when(turns <= 4, "short").when(turns <= 8, "medium").otherwise("long")


def with_history(turns: DataFrame, session: str = "conv_id", order: str = "turn", ok: Column | None = None) -> DataFrame:
    """Adds ``history``: the earlier turns (role, utterance) of the session, failed ones left out."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.struct("role", "utterance")
    return turns.withColumn("history", F.collect_list(turn if ok is None else F.when(ok, turn)).over(w))


def retrieval_query(history: Column, question: Column) -> Column:
    lines = F.transform(history, lambda t: F.concat(t["role"], F.lit(": "), t["utterance"]))
    return F.array_join(F.concat(lines, F.array(F.concat(F.lit("user: "), question))), "\n")


def context_text(chunks: Column) -> Column:
    """Chunks (chunk_id, text) as a prompt shows them."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit('[chunk_id: "'), c["chunk_id"], F.lit('"]\n'), c["text"])), "\n\n---\n\n")


def messages(system: str, question: Column, chunks: Column) -> Column:
    """The messages of a call as JSON: rules, then the context and the language to answer in."""
    user = F.concat(context_text(chunks), F.lit("\n\nQuestion: "), question, F.lit("\nRespond in "), T.language_hint(question))
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def parsed_generation(raw: Column) -> Column:
    """The response (answer, citations, action) of a JSON text with exactly these fields and sound values; null otherwise."""
    keys = F.array_sort(F.json_object_keys(raw))
    got = F.from_json(raw, GENERATION)
    # a JSON string begins with a quotation mark; numbers and lists would be cast
    typed = F.get_json_object(raw, "$.answer").isNotNull() & raw.rlike(r'"answer"\s*:\s*"') & raw.rlike(r'"citations"\s*:\s*\[\s*("|\])')
    sound = (T.strip(got["answer"]) != "") & got["action"].isin(*ACTIONS) & F.forall(got["citations"], lambda c: c.isNotNull() & (T.strip(c) != ""))
    return F.when((keys == F.array(*[F.lit(k) for k in ("action", "answer", "citations")])) & typed & sound, got)


def citation_check(action: Column, citations: Column, retrieved: Column) -> Column:
    """'failed' if a citation was not retrieved or an answer has none; citations are never silently dropped."""
    invented = F.size(F.array_except(citations, retrieved)) > 0
    return F.when(invented | ((action == "answer") & (F.size(citations) == 0)), "failed").otherwise("ok")


def enriched_citations(citations: Column, contexts: Column) -> Column:
    """Contexts of the citations, each once, in order of first mention."""
    return F.flatten(F.transform(F.array_distinct(citations), lambda c: F.filter(contexts, lambda x: x["chunk_id"] == c)))


def answer(requests: DataFrame, generate, limits: Limits = Limits(), system: str = "Answer from the excerpts only.") -> DataFrame:
    """Requests (question, history, chunks, top_dense) to traces: checked, gated, generated, validated.

    ``generate(messages)`` is a Column function that returns the provider's JSON (a pandas UDF around a client, or
    recorded text).
    """
    q, chunks = F.col("question"), F.col("chunks")
    gated = requests.withColumn("input_error", input_error(q, F.col("history"), limits)).withColumn("refusal_reason", F.when(F.col("input_error").isNull(), refusal_reason(F.size(chunks), F.col("top_dense"), limits)))
    asked = gated.withColumn("raw", F.when(F.col("input_error").isNull() & F.col("refusal_reason").isNull(), generate(messages(system, q, chunks))))
    parsed = asked.withColumn("generated", parsed_generation(F.col("raw")))
    ids = F.transform(chunks, lambda c: c["chunk_id"])
    check = F.when(F.col("refusal_reason").isNotNull(), "not_applicable").when(F.col("generated").isNull(), "not_evaluated").otherwise(citation_check(F.col("generated.action"), F.col("generated.citations"), ids))
    refused = F.struct(T.localised(q, REFUSAL_EN, REFUSAL_ZH).alias("answer"), F.array().cast("array<string>").alias("citations"), F.lit("refuse").alias("action"))
    checked = parsed.withColumn("citation_check", check)
    response = F.when(F.col("refusal_reason").isNotNull(), refused).when(F.col("citation_check") == "ok", F.col("generated"))
    error = F.when(F.col("input_error").isNotNull(), "invalid_input").when(F.col("refusal_reason").isNotNull(), None).when(F.col("generated").isNull(), "generation_failed").when(F.col("citation_check") == "failed", "citation_failed")
    done = checked.withColumn("response", response).withColumn("error_type", error).withColumn("status", F.when(error.isNull(), "ok").otherwise("failed"))
    # a refusal shows no contexts, the retrieved ones stay on record
    shown = F.when(F.col("refusal_reason").isNull(), chunks).otherwise(F.slice(chunks, 1, 0))
    return done.withColumn("contexts", shown).withColumn("retrieval_contexts", chunks).withColumn("citations", enriched_citations(F.coalesce(F.col("response.citations"), F.array().cast("array<string>")), chunks)).drop("generated", "raw")
