"""Queries over labels, conversations and events: judging, ledgers, service levels, evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions import text as T
from ..operators import answers, integrity, judging, ledger, sampling, selection


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q17_correctness_bounds(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    j = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    cases = j.select(F.lit("all").alias("candidate"), F.col("doc_id").alias("question_id"), "lang", F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("status"), F.lit("clarify").alias("label"))
    verdicts = labels.select(F.lit("all").alias("candidate"), F.col("doc_id").alias("question_id"), F.lit("correctness").alias("metric"), F.lit("ok").alias("status"), F.col("quality").cast("double").alias("score"))
    both = cases.select(F.explode(F.array(F.col("lang"), F.lit("(all)"))).alias("group"), "*")
    out = judging.summary(both, verdicts, ["group"])
    r = lambda c: F.round(c, 6).alias(c)
    status = judging.threshold_status(F.col("correctness_lo"), F.col("correctness_hi"), 0.5)
    return out.select("group", "n", "failures", F.col("correct").cast("long").alias("correct"), "unknown", r("correctness_lo"), r("correctness_hi"), status.alias("target_half"))


Q17 = """WITH x AS (SELECT lang, coalesce(toxic, 0) AS toxic, quality FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT coalesce(lang, '(all)') AS "group", count(*) AS n, count(*) FILTER (toxic = 1) AS failures, CAST(sum(CASE WHEN toxic = 0 THEN coalesce(quality, 0) ELSE 0 END) AS BIGINT) AS correct, count(*) FILTER (toxic = 0 AND quality IS NULL) AS unknown FROM x GROUP BY GROUPING SETS ((lang), ()))
SELECT "group", n, failures, correct, unknown, round(correct / n, 6) AS correctness_lo, round((correct + unknown) / n, 6) AS correctness_hi,
 CASE WHEN correct / n >= 0.5 THEN 'met' WHEN (correct + unknown) / n < 0.5 THEN 'not_met' ELSE 'indeterminate_due_to_unknown_scores' END AS target_half FROM g"""


def q19_faithfulness(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    scope = F.when(F.col("role") == "assistant", "external_fact").when(F.col("role") == "user", "non_assertion").otherwise("assistant_capability")
    unit = F.struct(scope.alias("scope"), (F.length("text") % 2 == 0).alias("supported"))
    units = t.groupBy("conv_id").agg(F.collect_list(unit).alias("units"))
    excluded = judging.excluded_scopes(F.col("units"))
    n = lambda s: F.coalesce(excluded[s], F.lit(0)).cast("long")
    return units.select("conv_id", F.round(judging.faithfulness(F.col("units")), 6).alias("score"), n("non_assertion").alias("non_assertions"), n("assistant_capability").alias("capabilities"))


Q19 = """SELECT conv_id, round(avg(CASE WHEN role = 'assistant' THEN CAST(length(text) % 2 = 0 AS INTEGER) END), 6) AS score, count(*) FILTER (role = 'user') AS non_assertions, count(*) FILTER (role NOT IN ('user', 'assistant')) AS capabilities FROM conversations GROUP BY conv_id"""


def turns(spark, sf_dir) -> DataFrame:
    """Turns in the service's terms: user and agent; system turns are left out."""
    t = read(spark, sf_dir, "conversations").where("role <> 'system'")
    return t.select("conv_id", "turn", F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("role"), F.col("text").alias("utterance"))


_TURNS = "t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE 'user' END AS role, text AS utterance FROM conversations WHERE role <> 'system')"
_HIST = f"{_TURNS}, h AS (SELECT *, list(role || ': ' || utterance) OVER w AS lines, list(length(utterance)) OVER w AS sizes, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def q21_history(spark, sf_dir):
    h = answers.with_history(turns(spark, sf_dir)).where("role = 'user'")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("messages"), F.sha2(answers.retrieval_query(F.col("history"), F.col("utterance")).cast("binary"), 256).alias("query_sha256"))


Q21 = f"WITH {_HIST} SELECT conv_id, turn, n AS messages, sha256(array_to_string(list_append(coalesce(lines, []), 'user: ' || utterance), chr(10))) AS query_sha256 FROM h WHERE role = 'user'"


def q22_history_buckets(spark, sf_dir):
    h = answers.with_history(turns(spark, sf_dir)).withColumn("bucket", answers.history_bucket(F.size("history")))
    return sampling.distributions(h, ["bucket", "role"])


Q22 = f"""WITH {_HIST}, b AS (SELECT role, CASE WHEN n = 0 THEN 'none' WHEN n <= 4 THEN 'short' WHEN n <= 8 THEN 'medium' ELSE 'long' END AS bucket FROM h)
SELECT 'bucket' AS dimension, bucket AS value, count(*) AS n FROM b GROUP BY bucket UNION ALL SELECT 'role', role, count(*) FROM b GROUP BY role"""


def q23_input_limits(spark, sf_dir):
    limits = answers.Limits(question_characters=400, history_messages=3, history_characters=900)
    h = answers.with_history(turns(spark, sf_dir))
    return h.select("conv_id", "turn", F.coalesce(answers.input_error(F.col("utterance"), F.col("history"), limits), F.lit("none")).alias("error"))


Q23 = f"""WITH {_HIST} SELECT conv_id, turn, CASE WHEN trim(utterance) = '' OR length(utterance) > 400 THEN 'question' WHEN n > 3 THEN 'history_messages' WHEN coalesce(list_sum(sizes), 0) > 900 THEN 'history_characters' ELSE 'none' END AS error FROM h"""


def calls(spark, sf_dir) -> DataFrame:
    """Events as paid calls: tokens from their value and properties."""
    e = read(spark, sf_dir, "events")
    prompt = F.floor(F.col("value") * 10).cast("long")
    return e.select("event_id", "user_id", "event_type", "ts", prompt.alias("prompt"), F.floor(prompt * 0.25).cast("long").alias("cached"), F.get_json_object("props", "$.k").cast("long").alias("completion"), "value")


_CALLS = """c AS (SELECT event_id, user_id, event_type, ts, CAST(floor(value * 10) AS BIGINT) AS prompt, CAST(floor(floor(value * 10) * 0.25) AS BIGINT) AS cached, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion, value FROM events),
l AS (SELECT *, ts + INTERVAL 8 HOUR AS lt FROM c), p AS (SELECT *, isodow(lt) < 6 AND (hour(lt) BETWEEN 9 AND 11 OR hour(lt) BETWEEN 14 AND 17) AS peak,
 ((prompt - cached) * 3.0::DOUBLE + cached * 0.1::DOUBLE + completion * 9.0::DOUBLE) / 1e6 AS full_price FROM l)"""


def q24_tariff(spark, sf_dir):
    c = calls(spark, sf_dir).withColumn("peak", money.is_peak(F.col("ts")))
    cost = money.price("deepseek-v4-flash", F.col("prompt"), F.col("completion"), F.col("cached"), F.when(F.col("peak"), 1.0).otherwise(0.5))
    return c.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "peak").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(F.sum(cost), 6).alias("cost"))


Q24 = f"WITH {_CALLS} SELECT strftime(ts, '%Y-%m-%d') AS day, peak, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, round(sum(full_price * CASE WHEN peak THEN 1.0 ELSE 0.5 END), 6) AS cost FROM p GROUP BY ALL"


def q25_service_level(spark, sf_dir):
    r = read(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 9 != 0).alias("ok"), (F.col("value") * 100).alias("ms"))
    out = ledger.service_level(r, F.count("*"), ["event_type"])
    return out.withColumn("status", judging.threshold_status(F.col("within"), F.col("within"), 0.8)).withColumn("max_ms", F.round("max_ms", 6))


Q25 = """WITH r AS (SELECT event_type, event_id % 9 <> 0 AS ok, value * 100 AS ms FROM events),
g AS (SELECT event_type, count(*) AS submitted, count(*) FILTER (ok) AS succeeded, round(quantile_cont(ms, 0.5) FILTER (ok), 6) AS p50, round(quantile_cont(ms, 0.9) FILTER (ok), 6) AS p90, round(max(ms), 6) AS max_ms, round(count(*) FILTER (ok AND ms <= 10000) / count(*), 6) AS within FROM r GROUP BY 1)
SELECT *, CASE WHEN within >= 0.8 THEN 'met' ELSE 'not_met' END AS status FROM g"""


def q26_receipts(spark, sf_dir):
    c = calls(spark, sf_dir)
    reserve = c.select(F.lit("reserve").alias("event"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("role"), F.col("ts").alias("time_utc"), money.price("deepseek-v4-flash", F.col("prompt") + 1024, F.lit(100), F.lit(0)).alias("reserved"))
    usage = F.col("event_id") % 5 != 0
    settled = c.where("event_id % 3 <> 0").select(F.lit("settle").alias("event"), F.col("event_id").alias("attempt_id"), F.when(usage, money.price("deepseek-v4-flash", F.col("prompt"), F.col("completion"), F.col("cached"))).otherwise(money.price("deepseek-v4-flash", F.col("prompt") + 1024, F.lit(100), F.lit(0))).alias("accounted"), (~usage).alias("usage_unknown"), F.when(usage, F.col("prompt")).alias("prompt_tokens"), F.when(usage, F.col("completion")).alias("completion_tokens"), F.when(usage, F.col("cached")).alias("cached_tokens"))
    events = reserve.unionByName(settled, allowMissingColumns=True)
    got = ledger.receipts(events).join(c.select(F.col("event_id").alias("attempt_id"), "event_type"), "attempt_id")
    return ledger.spending(got, ["event_type"])


Q26 = f"""WITH {_CALLS}, r AS (SELECT *, ((prompt + 1024) * 3.0::DOUBLE + 100 * 9.0::DOUBLE) / 1e6 AS reserved, event_id % 3 <> 0 AND event_id % 5 <> 0 AS known FROM p)
SELECT event_type, count(*) AS attempts, round(sum(CASE WHEN known THEN full_price ELSE reserved END), 6) AS accounted, count(*) FILTER (NOT known) AS unknown_usage, CAST(coalesce(sum(prompt) FILTER (known), 0) AS BIGINT) AS prompt_tokens,
 CAST(coalesce(sum(completion) FILTER (known), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(cached) FILTER (known), 0) AS BIGINT) AS cached_tokens, min(ts) AS first_utc, max(ts) AS last_utc FROM r GROUP BY 1"""


def q27_admission(spark, sf_dir):
    c = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), F.col("value").alias("amount"))
    return ledger.admit(c, "user_id", 500.0).select("user_id", "ordinal", "admitted", F.round("spent", 6).alias("spent"))


Q27 = """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, value <= 500.0 + 1e-12 AS admitted, CASE WHEN value <= 500.0 + 1e-12 THEN value ELSE 0 END AS spent FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.k, f.spent + o.value <= 500.0 + 1e-12, CASE WHEN f.spent + o.value <= 500.0 + 1e-12 THEN f.spent + o.value ELSE f.spent END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id AS ordinal, admitted, round(spent, 6) AS spent FROM f"""


def q28_pending(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    done = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").select("lang", "source").distinct().withColumn("status", F.lit("ok"))
    plan = docs.select("lang").distinct().join(docs.select("source").distinct(), F.lit(True))
    return sampling.export(plan, done, ["lang", "source"]).select("lang", "source", "status")


Q28 = """WITH d AS (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT l.lang, s.source, CASE WHEN d.lang IS NULL THEN 'not_submitted' ELSE 'ok' END AS status FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN d ON d.lang = l.lang AND d.source = s.source"""


def q29_pools(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    exposed = c.where("role = 'system'").select("conv_id").distinct()
    dev, holdout = c.join(exposed, "conv_id", "left_semi"), c.join(exposed, "conv_id", "left_anti")
    shared = dev.select("conv_id").intersect(holdout.select("conv_id"))
    counts = integrity.rules({"dev_turns": dev, "holdout_turns": holdout, "shared_dialogues": shared, "repeated_turns": integrity.duplicates(c, "conv_id", "turn")})
    return counts


Q29 = """WITH e AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') SELECT 'dev_turns' AS rule, count(*) AS violations FROM conversations WHERE conv_id IN (SELECT conv_id FROM e)
UNION ALL SELECT 'holdout_turns', count(*) FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = c.conv_id) UNION ALL SELECT 'shared_dialogues', count(*) FROM (SELECT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM e) INTERSECT SELECT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = c.conv_id))
UNION ALL SELECT 'repeated_turns', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)"""


def q30_quota_sample(spark, sf_dir):
    s = sampling.quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 5, 20260906, "dev", "doc_id")
    return s.select("doc_id", "lang", F.col("pick").cast("long").alias("pick"), F.round("jitter", 9).alias("jitter"))


Q30 = """WITH j AS (SELECT doc_id, lang, CAST(CAST('0x' || substr(sha256('20260906:dev:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS jitter FROM documents)
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY jitter, doc_id) AS pick, round(jitter, 9) AS jitter FROM j QUALIFY pick <= 5"""


def q31_distributions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("size", F.when(F.col("n_chars") < 500, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large"))
    return sampling.distributions(d, ["lang", "source", "size"])


Q31 = """WITH d AS (SELECT lang, source, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size FROM documents)
SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM d GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY source UNION ALL SELECT 'size', size, count(*) FROM d GROUP BY size"""


def q36_greedy_quotas(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pool = d.select(F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").cast("string").alias("dialogue_id"), F.element_at(F.array(F.lit("unanswerable"), F.lit("clarification"), F.lit("answer")), (F.col("doc_id") % 3 + 1).cast("int")).alias("category"), F.col("source").alias("domain"), F.col("lang").alias("language"), F.lit("same").alias("relation"), answers.history_bucket((F.col("doc_id") % 12).cast("int")).alias("history"), F.lit("md").alias("format"))
    targets = {"language": {"en": 3, "fr": 1, "de": 1, "es": 1}, "history": {"none": 1, "short": 2, "medium": 2, "long": 1}}
    return selection.greedy_quotas(pool, {"unanswerable": 1, "clarification": 2, "answer": 3}, targets, 20260906, "dev")


Q36 = """WITH RECURSIVE pool AS (SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS category, lang, CASE WHEN doc_id % 12 = 0 THEN 'none' WHEN doc_id % 12 <= 4 THEN 'short' WHEN doc_id % 12 <= 8 THEN 'medium' ELSE 'long' END AS history,
 CAST(CAST('0x' || substr(sha256('20260906:dev:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS jitter FROM documents),
wanted AS (SELECT * FROM (VALUES ('lang', 'en', 3, 2.0), ('lang', 'fr', 1, 2.0), ('lang', 'de', 1, 2.0), ('lang', 'es', 1, 2.0), ('history', 'none', 1, 1.0), ('history', 'short', 2, 1.0), ('history', 'medium', 2, 1.0), ('history', 'long', 1, 1.0)) v(dimension, value, target, weight)),
slots AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)) v(ordinal, category)),
picks AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS langs, CAST([] AS VARCHAR[]) AS histories
UNION ALL SELECT n + 1, list_append(ids, best.doc_id), list_append(langs, best.lang), list_append(histories, best.history) FROM (
 SELECT p.n, p.ids, p.langs, p.histories, arg_max({'doc_id': x.doc_id, 'lang': x.lang, 'history': x.history}, ROW(
  coalesce(CAST(l.weight AS DOUBLE) * (l.target - len(list_filter(p.langs, lambda v: v = x.lang))) / l.target, 0.0) + coalesce(CAST(h.weight AS DOUBLE) * (h.target - len(list_filter(p.histories, lambda v: v = x.history))) / h.target, 0.0), x.jitter)) AS best
 FROM picks p JOIN slots s ON s.ordinal = p.n JOIN pool x ON x.category = s.category AND NOT list_contains(p.ids, x.doc_id) LEFT JOIN wanted l ON l.dimension = 'lang' AND l.value = x.lang LEFT JOIN wanted h ON h.dimension = 'history' AND h.value = x.history GROUP BY ALL))
SELECT CAST(generate_subscripts(ids, 1) - 1 AS INTEGER) AS ordinal, CAST(unnest(ids) AS VARCHAR) AS item_id FROM picks WHERE n = 6"""


def q40_exact_cache(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "props").cast("binary"), 256).alias("request_hash"), F.when(F.col("value") > 200, F.lit(None).cast("int")).when(F.col("event_id") % 11 == 0, 429).when(F.col("event_id") % 13 == 0, 401).otherwise(200).alias("http"), F.when(F.col("event_id") % 7 == 0, "length").otherwise("stop").alias("finish"))
    judged = e.withColumn("outcome", money.retry_class(F.col("http"), F.col("finish")))
    first = judged.where("outcome = 'ok'").groupBy("request_hash").agg(F.min("event_id").alias("first_id"))
    cached = judged.join(first, "request_hash", "left").withColumn("hit", F.coalesce(F.col("event_id") > F.col("first_id"), F.lit(False)))
    return cached.groupBy("outcome", "hit").agg(F.count("*").alias("n"))


Q40 = """WITH e AS (SELECT event_id, event_type || '|' || props AS h, CASE WHEN value > 200 THEN 'retry' WHEN event_id % 11 = 0 THEN 'retry' WHEN event_id % 13 = 0 THEN 'authentication_failed' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM events),
f AS (SELECT h, min(event_id) AS first_id FROM e WHERE outcome = 'ok' GROUP BY h) SELECT outcome, coalesce(event_id > first_id, false) AS hit, count(*) AS n FROM e LEFT JOIN f USING (h) GROUP BY ALL"""


def q42_generation_schema(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    good = F.to_json(F.struct(F.col("text").alias("answer"), F.array(F.lit("c1")).alias("citations"), F.lit("answer").alias("action")))
    raw = F.when(kind == 0, good).when(kind == 1, F.regexp_replace(good, '"action":"answer"', '"action":"other"')).when(kind == 2, F.regexp_replace(good, r"\}$", ',"extra":1}')).when(kind == 3, F.regexp_replace(good, r'"citations":\["c1"\]', '"citations":[]')).otherwise(F.lit('{"answer":"x"}'))
    got = answers.parsed_generation(raw)
    return t.select("conv_id", "turn", got.isNotNull().alias("valid"), F.coalesce(F.size(got["citations"]), F.lit(-1)).cast("long").alias("citations"))


Q42 = "SELECT conv_id, turn, (conv_id + turn) % 5 IN (0, 3) AS valid, CAST(CASE (conv_id + turn) % 5 WHEN 0 THEN 1 WHEN 3 THEN 0 ELSE -1 END AS BIGINT) AS citations FROM conversations"


def q46_quality_flags(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    item = {"category": F.when(F.col("role") == "user", "answer").when(F.col("role") == "system", "unanswerable").otherwise("clarification"), "language": F.when(F.col("conv_id") % 2 == 0, "en").otherwise("fr"), "question": F.col("text"), "reference": F.substring("text", 1, 11), "has_evidence": F.col("turn") % 2 == 0}
    return t.select("conv_id", "turn", F.array_join(F.sort_array(sampling.quality_flags(item)), ";").alias("flags"))


Q46 = """WITH t AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'answer' WHEN 'system' THEN 'unanswerable' ELSE 'clarification' END AS c FROM conversations)
SELECT conv_id, turn, concat_ws(';', CASE WHEN c <> 'unanswerable' AND turn % 2 <> 0 THEN 'missing_answer_evidence' END, CASE WHEN c <> 'answer' THEN 'source_label_requires_review' END,
 CASE WHEN regexp_matches(text, '(?i)(lorem ipsum|\\bTODO\\b|\\bplaceholder\\b|\\x{FFFD}|\\?{3,})') THEN 'suspect_placeholder_or_garbled_text' END, CASE WHEN conv_id % 2 <> 0 THEN 'translated_text_review' END,
 CASE WHEN length(trim(text)) < 8 THEN 'very_short_question' END, 'very_short_reference') AS flags FROM t""".replace("\\\\", "\\")

QUERIES = {f.__name__: f for f in (q17_correctness_bounds, q19_faithfulness, q21_history, q22_history_buckets, q23_input_limits, q24_tariff, q25_service_level, q26_receipts, q27_admission, q28_pending, q29_pools, q30_quota_sample, q31_distributions, q36_greedy_quotas, q40_exact_cache, q42_generation_schema, q46_quality_flags)}
ORACLES = {"q17_correctness_bounds": Q17, "q19_faithfulness": Q19, "q21_history": Q21, "q22_history_buckets": Q22, "q23_input_limits": Q23, "q24_tariff": Q24, "q25_service_level": Q25, "q26_receipts": Q26, "q27_admission": Q27, "q28_pending": Q28, "q29_pools": Q29, "q30_quota_sample": Q30, "q31_distributions": Q31, "q36_greedy_quotas": Q36, "q40_exact_cache": Q40, "q42_generation_schema": Q42, "q46_quality_flags": Q46}
