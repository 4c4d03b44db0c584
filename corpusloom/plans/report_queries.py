"""Queries of reports and releases: retrieval quality, acceptance, latencies, forecasts, distinct inputs, revisions, next tasks, redaction of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions import text as T
from ..operators import evalset, evidence, items, ledger, rollups, sampling
from ..sources import docx
from .retrieval_queries import ranked, ranked_sql, vectors


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q51_ranking_quality(spark, sf_dir):
    """Vectors of a query's own label are relevant to it."""
    top = ranked(spark, sf_dir, 10, own=False)
    labels = vectors(spark, sf_dir).select("vec_id", "label")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label")
    return evidence.ranking_quality_by_label(top, asked, labels.withColumnRenamed("vec_id", "id"), 10).select("questions", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


Q51 = f"""WITH {ranked_sql(10, False)}, rel AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid), h AS (SELECT qid, count(*) AS found, min(rank) AS first FROM r JOIN rel USING (qid, id) GROUP BY qid)
SELECT count(*) AS questions, round(avg(coalesce(found / n, 0)), 9) AS recall, round(avg(coalesce(1 / first, 0)), 9) AS mrr FROM n LEFT JOIN h USING (qid)"""


def q52_retrieval_summary(spark, sf_dir):
    """Documents as questions, their paragraphs as evidence: what the first half of each document covers, by language."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "lang", F.size(F.split("text", "\n")).alias("lines"), "n_chars")
    covered = F.ceil(F.col("lines") / 2)
    scores = d.select(
        "question_id", "lang", F.lit(1).alias("any_hit"), (covered / F.col("lines")).alias("block_recall"), F.when(covered == F.col("lines"), 1).otherwise(0).alias("all_hit"),
        (covered / (F.col("lines") + 1)).alias("precision"), F.col("n_chars").alias("context_tokens"), (F.col("n_chars") / 1000).alias("retrieval_seconds"),
    )
    r = lambda c: F.round(c, 6).alias(c)
    return evidence.retrieval_summary(scores, ["lang"]).select("lang", "answer_n", F.col("any_full_block_hit").cast("long").alias("any_full_block_hit"), F.col("all_full_blocks_hit").cast("long").alias("all_full_blocks_hit"), r("mean_block_recall"), r("mean_evidence_precision"), r("mean_context_tokens"), r("p50_retrieval_seconds"))


Q52 = """WITH d AS (SELECT lang, n_chars, len(string_split(text, chr(10))) AS lines FROM documents), c AS (SELECT *, ceil(lines / 2) AS covered FROM d)
SELECT lang, count(*) AS answer_n, count(*) AS any_full_block_hit, count(*) FILTER (covered = lines) AS all_full_blocks_hit, round(avg(covered / lines), 6) AS mean_block_recall, round(avg(covered / (lines + 1)), 6) AS mean_evidence_precision,
 round(avg(n_chars), 6) AS mean_context_tokens, round(quantile_cont(n_chars / 1000, 0.5), 6) AS p50_retrieval_seconds FROM c GROUP BY lang"""


def q53_acceptance(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    http = F.when(F.col("event_id") % 17 == 0, 503).otherwise(200)
    turns = e.select(F.col("user_id").alias("session_id"), http.alias("http_status"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok").alias("status"))
    got = ledger.acceptance(turns, e.select(http.alias("http_status"), (F.col("value") / 10).alias("wall_seconds")))
    return got.withColumn("max_seconds", F.round("max_seconds", 6))


Q53 = """WITH e AS (SELECT user_id, event_id % 17 <> 0 AS good, event_id % 5 <> 0 AS ok, value / 10 AS s FROM events)
SELECT count(*) AS turns, count(*) FILTER (good AND ok) AS turns_ok, count(DISTINCT user_id) AS sessions, count(*) AS requests, count(*) FILTER (good) AS http_200, count(*) FILTER (good AND s <= 10) AS within_limit, round(max(s), 6) AS max_seconds FROM e"""


def q54_stage_latencies(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("start", F.col("ts").cast("timestamp"))
    later = lambda ms: F.timestamp_micros(F.unix_micros("start") + (ms * 1000).cast("long"))
    first, second = F.floor(F.col("value")), F.floor(F.col("value") * 3)
    timed = e.select("event_type", "start", later(first).alias("found"), later(first + second).alias("answered"))
    stages = timed.select("event_type", *ledger.stage_latencies({"start": F.col("start"), "retrieval": F.col("found"), "generation": F.col("answered")}))
    r = lambda c: F.round(F.avg(c), 6).alias(c)
    return stages.groupBy("event_type").agg(r("retrieval_ms"), r("generation_ms"), r("total_ms"))


Q54 = "SELECT event_type, round(avg(floor(value)), 6) AS retrieval_ms, round(avg(floor(value * 3)), 6) AS generation_ms, round(avg(floor(value) + floor(value * 3)), 6) AS total_ms FROM events GROUP BY 1"


def q55_cost_forecast(spark, sf_dir):
    """What answering every turn may cost at most, by role, with up to three attempts for each third turn."""
    c = read(spark, sf_dir, "conversations")
    tries = F.when(F.col("turn") % 3 == 0, 3).otherwise(1)
    cost = money.forecast("deepseek-v4-flash", F.col("text"), F.lit(256), tries)
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("upper"))


Q55 = "SELECT role, count(*) AS calls, round(sum(((strlen(text) + 1024) * 3.0::DOUBLE + 256 * 9.0::DOUBLE) / 1e6 * CASE WHEN turn % 3 = 0 THEN 3 ELSE 1 END), 6) AS upper FROM conversations GROUP BY role"


def q56_distinct_inputs(spark, sf_dir):
    return evalset.distinct_inputs(read(spark, sf_dir, "documents"), "text", "source", by=["lang"])


Q56 = "SELECT lang, count(*) AS n, count(DISTINCT {'t': text, 's': source}) AS distinct_inputs FROM documents GROUP BY lang"


def q57_revised_rows(spark, sf_dir):
    """Turns by their place before and after a revision that changes some texts, some roles, and drops some turns."""
    before = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = before.where("turn % 7 <> 6").withColumn("text", F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("role", F.when(F.col("turn") % 4 == 2, "reviewer").otherwise(F.col("role")))
    return evalset.changed_rows(before, after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("after_sha256").isNull().alias("gone"), F.array_join("changed_fields", ",").alias("fields"))


Q57 = """WITH b AS (SELECT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'reviewer' ELSE role END AS role, CASE WHEN turn % 5 = 1 THEN text || '.' ELSE text END AS text FROM b WHERE turn % 7 <> 6),
j AS (SELECT b.conv_id, b.turn, a.conv_id IS NULL AS gone, a.conv_id IS NULL OR a.role IS DISTINCT FROM b.role AS r, a.conv_id IS NULL OR a.text IS DISTINCT FROM b.text AS t FROM b LEFT JOIN a ON a.conv_id = b.conv_id AND a.turn = b.turn)
SELECT conv_id, turn, gone, concat_ws(',', CASE WHEN r THEN 'role' END, CASE WHEN t THEN 'text' END) AS fields FROM j WHERE r OR t"""


def q58_next_tasks(spark, sf_dir):
    """The first 50 labelled documents that no label calls done, as a task limit has it."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return sampling.next_tasks(docs.select("doc_id", "lang"), labels.where("quality = 1").select("doc_id").distinct(), ["doc_id"], "lang", 50).select("doc_id", "lang", "planned")


Q58 = "SELECT doc_id, lang, (SELECT count(*) FROM documents) AS planned FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY lang, doc_id LIMIT 50"


def q59_payload_redaction(spark, sf_dir):
    """Turns as nested payloads: strings redacted at every depth, secrets replaced by their names; what is left of both, by role."""
    c = read(spark, sf_dir, "conversations")
    said = F.concat(F.col("text"), F.lit(" write to user"), F.col("conv_id").cast("string"), F.lit("@mail.example.com please"))
    payload = F.struct(F.col("role"), F.struct(F.array(F.struct(said.alias("content"), F.lit("k-123").alias("api_key"))).alias("messages"), F.create_map(F.lit("Authorization"), F.col("text"), F.lit("note"), said).alias("headers")).alias("body"))
    typed = c.select(payload.alias("p"))
    safe = typed.select(T.redact_payload(F.col("p"), typed.schema["p"].dataType).alias("p"))
    content, headers = F.col("p.body.messages")[0]["content"], F.col("p.body.headers")
    return safe.groupBy("p.role").agg(
        F.count("*").alias("n"), F.count_if(content.contains("@mail.example.com") | headers["note"].contains("@mail.example.com")).alias("addresses_left"), F.count_if(content.contains("[EMAIL] please")).alias("addresses_redacted"),
        F.count_if((F.col("p.body.messages")[0]["api_key"] == "[REDACTED]") & (headers["Authorization"] == "[REDACTED]")).alias("secrets_redacted"),
    )


Q59 = r"""WITH m AS (SELECT role, regexp_replace(text || ' write to user' || conv_id || '@mail.example.com please', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS c FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (contains(c, '@mail.example.com')) AS addresses_left, count(*) FILTER (contains(c, '[EMAIL] please')) AS addresses_redacted, count(*) AS secrets_redacted FROM m GROUP BY role"""


def q60_first_formats(spark, sf_dir):
    """Pages as an item's documents: the format of the first, by the ending of its address."""
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url"))
    kind = F.when(F.col("url").endswith("/"), "dir").when(F.col("url").contains("?"), "query").otherwise("page")
    docs = F.when(F.col("page_id") % 9 == 4, F.array().cast("array<struct<format:string>>")).otherwise(F.array(F.struct(kind.alias("format")), F.struct(F.lit("other").alias("format"))))
    return p.select(evalset.document_format(docs).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


Q60 = "SELECT CASE WHEN page_id % 9 = 4 THEN 'unknown' WHEN ends_with(url, '/') THEN 'dir' WHEN contains(url, '?') THEN 'query' ELSE 'page' END AS format, count(*) AS n FROM pages GROUP BY 1"

#: Styles of a document's lines in turn, and what DOCX can't hold.
STYLES, UNFIT = ("Heading 2", "List Number", "List Number", "List Bullet 2", "Normal"), r"[\x00-\x08\x0B-\x1F]"


def q61_docx_markdown(spark, sf_dir):
    """Documents as DOCX files, a line a paragraph, and these files as Markdown."""
    import pandas as pd

    def files(batches):
        for batch in batches:
            made = [docx.document([(STYLES[i % len(STYLES)], line) for i, line in enumerate(text.split("\n"))]) for text in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "content": made})

    texts = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", UNFIT, "").alias("text"))
    done = docx.to_markdown(texts.mapInPandas(files, "doc_id long, content binary"))
    return done.select("doc_id", "status", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


Q61 = r"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)), lambda x, i: {'i': i - 1, 'x': trim(x, ' ' || chr(9))}), recursive := true) FROM documents),
k AS (SELECT doc_id, i, x, x <> '' AND i % 5 = 2 AND coalesce(lag(x <> '') OVER (PARTITION BY doc_id ORDER BY i), false) AS second FROM l),
m AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '### ' WHEN 1 THEN '1. ' WHEN 2 THEN CASE WHEN second THEN '2. ' ELSE '1. ' END WHEN 3 THEN '  - ' ELSE '' END || x AS line FROM k WHERE x <> '')
SELECT d.doc_id, 'ok' AS status, sha256(coalesce(string_agg(line, chr(10) || chr(10) ORDER BY i), '') || chr(10)) AS text_sha256 FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id"""


def q62_runtime_items(spark, sf_dir):
    """User turns as items: candidates for review, and what reviews make of them."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    turn, text, of = F.col("turn"), F.col("text"), F.col("conv_id").cast("string")
    none = F.lit(None).cast("string")
    spans = F.array(F.struct(of.alias("doc_id"), F.lit("answer").alias("source_turn"), F.concat(F.lit("b"), (turn % 4).cast("string")).alias("source_block_id")), F.struct(of.alias("doc_id"), F.lit("question").alias("source_turn"), F.lit("q").alias("source_block_id")))
    kinds = F.array(F.lit("answer"), F.lit("clarification"), F.lit("unanswerable"))
    found = items.candidates(c.select(
        F.concat(of, F.lit(":"), turn.cast("string")).alias("eval_item_id"), of.alias("dialogue_id"), turn.alias("question_turn_id"), (turn + 1).alias("answer_turn_id"), F.lit("respond").alias("agent_dialogue_act"), F.element_at(kinds, (turn % 3 + 1).cast("int")).alias("evaluation_category"),
        F.lit("any").alias("domain"), F.lit("en").alias("dialogue_language"), F.lit("same").alias("language_relation"), text.alias("question"), none.alias("source_question_en"),
        F.when(turn > 0, F.transform(F.sequence(F.lit(1), F.greatest(turn, F.lit(1)).cast("int")), lambda i: F.struct(F.lit("user").alias("role"), i.cast("string").alias("utterance")))).alias("conversation_history"), text.alias("gold_answer"), none.alias("source_gold_answer_en"),
        F.array(of).alias("required_doc_ids"), F.array(of).alias("gold_doc_ids"), F.array(F.struct(of.alias("doc_id"), F.lit("md").alias("format"))).alias("required_documents"), spans.alias("evidence"),
    ), "dev", ["eval_item_id"])
    asked = F.split("question_id", ":")[1].cast("int")
    reviews = found.select("question_id", F.element_at(F.array(F.lit("answer"), F.lit("clarify"), F.lit("refuse")), asked % 3 + 1).alias("task_label"), F.when(asked % 2 == 0, "=SOURCE").otherwise("own").alias("reviewed_reference"), F.lit("clear").alias("label_reason"), F.lit("").alias("reviewer_notes"))
    done = items.runtime_items(found, reviews).join(found.select("question_id", "sequence"), "question_id")
    join = lambda c: F.array_join(c, ",").alias(c)
    return done.select("question_id", "sequence", "answerable", F.sha2(F.col("gold_answer").cast("binary"), 256).alias("gold_sha256"), join("answer_evidence_ids"), join("answer_doc_ids"), join("candidate_doc_ids"), "history_bucket", F.size("evidence").cast("long").alias("documents"))


Q62 = """WITH c AS (SELECT conv_id || ':' || turn AS question_id, conv_id::VARCHAR AS d, turn, text, turn % 3 <> 2 AS answerable FROM conversations WHERE role = 'user')
SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS sequence, answerable, sha256(CASE WHEN turn % 2 = 0 THEN text ELSE 'own' END) AS gold_sha256, CASE WHEN answerable THEN 'b' || (turn % 4) ELSE '' END AS answer_evidence_ids, CASE WHEN answerable THEN d ELSE '' END AS answer_doc_ids,
 CASE WHEN answerable THEN '' ELSE d END AS candidate_doc_ids, CASE WHEN turn = 0 THEN 'none' WHEN turn <= 4 THEN 'short' WHEN turn <= 8 THEN 'medium' ELSE 'long' END AS history_bucket, CASE WHEN answerable THEN 1 ELSE 0 END::BIGINT AS documents FROM c"""

#: Stated categories of a report; some have no rows.
LANGS, SIZES = ("de", "en", "es", "fr", "zh"), ("empty", "small", "medium", "large")


def q64_zero_filled(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    size = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    counts = d.select("lang", size.alias("size"), "n_chars").groupBy("lang", "size").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rollups.zero_filled(counts, {"lang": list(LANGS), "size": list(SIZES)})


Q64 = """WITH s AS (SELECT * FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('zh')) l(lang), (VALUES ('empty'), ('small'), ('medium'), ('large')) z(size)),
c AS (SELECT lang, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL)
SELECT lang, size, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars FROM s FULL JOIN c USING (lang, size)"""

QUERIES = {f.__name__: f for f in (q51_ranking_quality, q52_retrieval_summary, q53_acceptance, q54_stage_latencies, q55_cost_forecast, q56_distinct_inputs, q57_revised_rows, q58_next_tasks, q59_payload_redaction, q60_first_formats, q61_docx_markdown, q62_runtime_items, q64_zero_filled)}
ORACLES = {"q51_ranking_quality": Q51, "q52_retrieval_summary": Q52, "q53_acceptance": Q53, "q54_stage_latencies": Q54, "q55_cost_forecast": Q55, "q56_distinct_inputs": Q56, "q57_revised_rows": Q57, "q58_next_tasks": Q58, "q59_payload_redaction": Q59, "q60_first_formats": Q60, "q61_docx_markdown": Q61, "q62_runtime_items": Q62, "q64_zero_filled": Q64}
