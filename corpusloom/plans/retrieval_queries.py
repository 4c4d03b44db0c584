"""Queries over vectors and texts: ranking, fusion, re-ranking, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, evidence, integrity, judging, nearest, retrieval, sampling
from ..sources.tables import written

#: The queries: every row whose id is divisible by 20.
EVERY = 20


def vectors(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def ranked(spark, sf_dir, k: int, own: bool = True) -> DataFrame:
    """(qid, id, score, rank) to 6 places; without ``own`` a query's own vector does not count."""
    v = vectors(spark, sf_dir)
    queries = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    got = retrieval.dense_top_k(queries, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k + (not own), places=6)
    if own:
        return got
    w = Window.partitionBy("qid").orderBy("rank")
    return got.where("id <> qid").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_RANKED = """s AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score, q.label AS q_label, e.label
 FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 {own}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {k})"""


def ranked_sql(k: int, own: bool = True) -> str:
    return _RANKED.format(k=k, own="" if own else "AND q.vec_id <> e.vec_id")


def q09_dense_top20(spark, sf_dir):
    return ranked(spark, sf_dir, 20).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


Q09 = f"WITH {ranked_sql(20)} SELECT qid, id, score, rank FROM r"


def q50_pivots_top20(spark, sf_dir):
    """The same rows as q09, by pivots and bounds."""
    v = vectors(spark, sf_dir)
    queries = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("v"))
    best, _ = nearest.top_k(queries, v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 20, places=6)
    return best.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def q10_confidence_gate(spark, sf_dir):
    top = ranked(spark, sf_dir, 5, own=False).groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("contexts"))
    reason = answers.refusal_reason(F.col("n"), F.col("top_score"))
    return top.select("qid", "n", "top_score", F.coalesce(reason, F.lit("answerable")).alias("decision"), F.when(reason.isNull(), F.col("contexts")).otherwise("").alias("contexts"))


Q10 = f"""WITH {ranked_sql(5, False)}, g AS (SELECT qid, count(*) AS n, max(score) AS top_score, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS c FROM r GROUP BY qid)
SELECT qid, n, top_score, CASE WHEN top_score < 0.55 THEN 'low_retrieval_confidence' ELSE 'answerable' END AS decision, CASE WHEN top_score < 0.55 THEN '' ELSE c END AS contexts FROM g"""


def lexical(spark, sf_dir, k: int) -> tuple[DataFrame, DataFrame]:
    """BM25 ranking of documents for the benchmark's texts, and the tokens of these."""
    tokens = T.words(F.lower(F.col("text")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), tokens.alias("tokens"))
    return retrieval.bm25_top_k(asked, docs, k), asked


_BM25 = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
raw AS (SELECT term, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, n GROUP BY term, docs), low AS (SELECT 0.25 * avg(idf) AS low FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN low ELSE idf END AS idf FROM raw, low),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})"""


def q20_bm25(spark, sf_dir):
    return lexical(spark, sf_dir, 10)[0].select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


Q20 = f"WITH {_BM25.format(k=10)} SELECT qid, doc_id, score, rank FROM b"


def reranked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    top, asked = lexical(spark, sf_dir, retrieval.POOL)
    top = written(top, "pool")
    # only the pool's texts are split into words again
    pool = top.select("doc_id").distinct()
    pool = F.broadcast(pool) if top.count() <= retrieval.ASKED_ROWS else pool
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(pool, "doc_id", "left_semi").select("doc_id", T.words(F.lower(F.col("text"))).alias("tokens"))
    pairs = top.select("qid", "doc_id", "rank").join(asked.select("qid", F.col("tokens").alias("query")), "qid").join(docs, "doc_id").withColumnRenamed("doc_id", "id")
    return top, retrieval.window_rerank(pairs, 5)


def q11_window_rerank(spark, sf_dir):
    return reranked(spark, sf_dir)[1].select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("rerank_score", 6).alias("rerank_score"), F.col("new_rank").cast("long").alias("new_rank"))


_RERANK = rf"""{_BM25.format(k=20)}, qt AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '\S+') AS q FROM benchmark),
c AS (SELECT qid, doc_id AS id, rank, q[greatest(len(q) - 95, 1) :] AS q, w, unnest(range(0, greatest(len(w), 1), 320)) AS s FROM b JOIN qt USING (qid) JOIN t USING (doc_id)),
m AS (SELECT qid, id, rank, max(len(list_distinct(list_intersect(q, w[s + 1 : s + 384]))) / len(list_distinct(q))) AS sc FROM c GROUP BY ALL),
z AS (SELECT qid, id, rank, sc, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, rank) AS new_rank FROM m QUALIFY new_rank <= 5)"""
Q11 = f"WITH {_RERANK} SELECT qid, id, rank, round(sc, 6) AS rerank_score, new_rank FROM z"


def q12_profiles_paired(spark, sf_dir):
    labels = vectors(spark, sf_dir).select("vec_id", "label")
    top = ranked(spark, sf_dir, 10, own=False).join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    hit = lambda k: top.groupBy("qid").agg(F.max(F.when((F.col("rank") <= k) & (F.col("label") == F.col("ql")), 1).otherwise(0)).alias("hit"))
    return sampling.paired_changes(hit(5), hit(10), "qid", "hit")


Q12 = f"""WITH {ranked_sql(10, False)}, h AS (SELECT qid, max(CAST(rank <= 5 AND label = q_label AS INTEGER)) AS a, max(CAST(label = q_label AS INTEGER)) AS b FROM r GROUP BY qid)
SELECT count(*) AS pairs, count(*) FILTER (b > a) AS gained, count(*) FILTER (b < a) AS lost FROM h"""


def q13_fusion(spark, sf_dir):
    top, again = reranked(spark, sf_dir)
    lists = [(top.select("qid", F.col("doc_id").alias("id"), "rank"), 1.0), (again.select("qid", "id", F.col("new_rank").alias("rank")), 1.0)]
    return retrieval.fuse(lists, 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


Q13 = f"""WITH {_RERANK}, u AS (SELECT qid, doc_id AS id, 1.0 / (60 + rank) AS part, rank AS seen FROM b UNION ALL SELECT qid, id, 1.0 / (60 + new_rank), 10000000 + new_rank FROM z),
f AS (SELECT qid, id, round(CAST(sum(CAST(part AS DOUBLE)) AS DOUBLE), 12) AS score, min(seen) AS seen FROM u GROUP BY ALL)
SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS rank FROM f QUALIFY rank <= 10"""


def located(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("block_id"), "text")
    return evidence.find_verbatim(docs, items, ["lang"])


def q14_located_blocks(spark, sf_dir):
    return located(spark, sf_dir).select("doc_id", "block_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_LOC = "loc AS (SELECT doc_id, lang, length(d.text) AS chars, item_id AS block_id, strpos(d.text, b.text) - 1 AS start, strpos(d.text, b.text) - 1 + length(b.text) AS stop FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '')"
Q14 = f'WITH {_LOC} SELECT doc_id, block_id, start, stop AS "end" FROM loc'


def runs_and_blocks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks of 200 characters every 150, each third left out, of documents that hold a block; and the blocks."""
    blocks = located(spark, sf_dir).withColumn("length", F.col("end") - F.col("start"))
    docs = blocks.select("doc_id", "chars", "lang").distinct()
    runs = docs.select("doc_id", "lang", "chars", F.explode(F.sequence(F.lit(0), F.greatest(F.col("chars") - 1, F.lit(0)), F.lit(150))).alias("start")).where(F.col("start") / 150 % 3 != 2)
    runs = runs.select("doc_id", "lang", F.concat_ws("::", F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("chunk_id"), "start", F.least(F.col("start") + 200, "chars").alias("end"))
    return runs, blocks.select("doc_id", "block_id", "start", "end", "length")


_RUNS = """ru AS (SELECT DISTINCT doc_id, lang, s AS start, least(s + 200, chars) AS stop, concat(doc_id, '::', s) AS chunk_id FROM (SELECT doc_id, lang, chars, unnest(range(0, greatest(chars, 1), 150)) AS s FROM loc) WHERE s // 150 % 3 <> 2),
ov AS (SELECT ru.doc_id, ru.lang, chunk_id, block_id, greatest(ru.start, loc.start) - loc.start AS a, least(ru.stop, loc.stop) - loc.start AS z, loc.stop - loc.start AS length FROM ru JOIN loc ON ru.doc_id = loc.doc_id AND ru.start < loc.stop AND ru.stop > loc.start)"""


def q15_interval_coverage(spark, sf_dir):
    spans = evidence.overlaps(*runs_and_blocks(spark, sf_dir))
    union = evidence.union_length(spans, ["doc_id", "block_id"])
    n = spans.groupBy("doc_id", "block_id").agg(F.count("*").alias("runs"), F.max("length").cast("long").alias("length"))
    return n.join(union, ["doc_id", "block_id"]).select("doc_id", "block_id", "runs", "length", "covered", (F.col("covered") == F.col("length")).alias("complete"))


Q15 = f"""WITH {_LOC}, {_RUNS}, o AS (SELECT *, max(z) OVER (PARTITION BY doc_id, block_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ov),
g AS (SELECT *, sum(CAST(reach IS NULL OR a > reach AS INTEGER)) OVER (PARTITION BY doc_id, block_id ORDER BY a, z) AS island FROM o), i AS (SELECT doc_id, block_id, island, count(*) AS n, max(z) - min(a) AS len, max(length) AS length FROM g GROUP BY ALL)
SELECT doc_id, block_id, CAST(sum(n) AS BIGINT) AS runs, max(length) AS length, CAST(sum(len) AS BIGINT) AS covered, sum(len) = max(length) AS complete FROM i GROUP BY ALL"""


def q16_window_scores(spark, sf_dir):
    runs, blocks = runs_and_blocks(spark, sf_dir)
    spans = evidence.overlaps(runs, blocks)
    targets = blocks.select(F.col("block_id").alias("question_id"), "doc_id", "block_id").distinct()
    near = spans.select(F.col("block_id").alias("question_id"), "doc_id", "chunk_id").distinct().join(runs, ["doc_id", "chunk_id"]).withColumn("token_count", F.col("end") - F.col("start"))
    s = evidence.window_scores(near.select("question_id", "doc_id", "chunk_id", "token_count"), spans, targets)
    return s.select("question_id", "any_hit", F.round("block_recall", 6).alias("block_recall"), "all_hit", F.round("precision", 6).alias("precision"), F.col("context_tokens").cast("long").alias("context_tokens"), "chunks_returned")


Q16 = f"""WITH {_LOC}, {_RUNS}, o AS (SELECT *, max(z) OVER (PARTITION BY doc_id, block_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ov),
cov AS (SELECT doc_id, block_id, sum(greatest(z - greatest(a, coalesce(reach, a)), 0)) = max(length) AS ok FROM o GROUP BY ALL), tg AS (SELECT block_id, count(*) AS targets FROM loc GROUP BY 1),
h AS (SELECT block_id, count(*) FILTER (ok) AS hit FROM cov GROUP BY 1), one AS (SELECT block_id, count(DISTINCT chunk_id) FILTER (z - a = length) AS good, count(DISTINCT chunk_id) AS n FROM ov GROUP BY 1),
tk AS (SELECT block_id, sum(stop - start) AS tokens FROM (SELECT DISTINCT ov.block_id, ov.chunk_id, ru.start, ru.stop FROM ov JOIN ru ON ov.doc_id = ru.doc_id AND ov.chunk_id = ru.chunk_id) GROUP BY 1)
SELECT tg.block_id AS question_id, CAST(coalesce(hit, 0) > 0 AS INTEGER) AS any_hit, round(coalesce(hit, 0) / targets, 6) AS block_recall, CAST(coalesce(hit, 0) = targets AS INTEGER) AS all_hit,
 round(CASE WHEN n IS NULL THEN 0 ELSE good / n END, 6) AS precision, CAST(coalesce(tokens, 0) AS BIGINT) AS context_tokens, coalesce(n, 0) AS chunks_returned FROM tg LEFT JOIN h USING (block_id) LEFT JOIN one USING (block_id) LEFT JOIN tk USING (block_id)"""


def q18_context_precision(spark, sf_dir):
    labels = vectors(spark, sf_dir).select("vec_id", "label")
    top = ranked(spark, sf_dir, 5, own=False).join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    verdicts = top.withColumn("verdict", F.when(F.col("id") % 17 != 0, (F.col("label") == F.col("ql")).cast("int")))
    return judging.average_precision(verdicts, ["qid"]).select("qid", F.round("score", 6).alias("score"))


Q18 = f"""WITH {ranked_sql(5, False)}, v AS (SELECT qid, rank, CASE WHEN id % 17 <> 0 THEN CAST(label = q_label AS INTEGER) END AS v FROM r), p AS (SELECT *, sum(v) OVER (PARTITION BY qid ORDER BY rank) / rank AS p FROM v)
SELECT qid, round(CASE WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL WHEN sum(v) = 0 THEN 0.0 ELSE sum(p * v) / sum(v) END, 6) AS score FROM p GROUP BY qid"""


def q32_vector_rules(spark, sf_dir):
    return integrity.vector_rules(vectors(spark, sf_dir), "vec_id", "embedding", 64)


Q32 = """WITH x AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS n FROM embeddings)
SELECT 'dimension' AS rule, count(*) FILTER (len(embedding) <> 64) AS violations FROM x UNION ALL SELECT 'finite', count(*) FILTER (len(list_filter(embedding, lambda y: isnan(y) OR isinf(y))) > 0) FROM x
UNION ALL SELECT 'unit_norm', count(*) FILTER (abs(n - 1) > 1e-3) FROM x UNION ALL SELECT 'unique_key', count(*) - count(DISTINCT vec_id) FROM x"""


def q35_citation_check(spark, sf_dir):
    top = ranked(spark, sf_dir, 5).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")).alias("ids"))
    kind = (F.col("qid") / EVERY % 4).cast("int")
    cited = F.when(kind == 0, F.slice("ids", 1, 2)).when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array(F.col("ids")[0], F.lit("invented"))).otherwise(F.array(F.col("ids")[1], F.col("ids")[0], F.col("ids")[1]))
    action = F.when(F.col("qid") / EVERY % 8 == 5, "clarify").otherwise("answer")
    contexts = F.transform("ids", lambda i: F.struct(i.alias("chunk_id")))
    return top.select("qid", answers.citation_check(action, cited, F.col("ids")).alias("citation_check"), F.array_join(F.transform(answers.enriched_citations(cited, contexts), lambda c: c["chunk_id"]), ",").alias("cited"))


Q35 = f"""WITH {ranked_sql(5)}, g AS (SELECT qid, list(CAST(id AS VARCHAR) ORDER BY rank) AS ids FROM r GROUP BY qid), k AS (SELECT *, qid // 20 % 4 AS k FROM g)
SELECT qid, CASE WHEN k = 2 OR (k = 1 AND qid // 20 % 8 <> 5) THEN 'failed' ELSE 'ok' END AS citation_check, CASE k WHEN 0 THEN ids[1] || ',' || ids[2] WHEN 1 THEN '' WHEN 2 THEN ids[1] ELSE ids[2] || ',' || ids[1] END AS cited FROM k"""


def q38_canonical_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # sentences of each document as its blocks
    parts = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"(?<=\.)\s"), lambda s: s != "")).alias("block_ix", "text")).withColumn("block_id", F.col("block_ix"))
    found = evidence.locate_blocks(docs, parts)
    return found.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count("start").alias("aligned"), F.sum("length").alias("chars"))


def q39_budget_prefix(spark, sf_dir):
    top = ranked(spark, sf_dir, 20).withColumn("tokens", F.col("id") % 50 + 10)
    return retrieval.budget_prefix(top, 200).groupBy("qid").agg(F.count("*").alias("kept"), F.max("spent").alias("spent"))


Q39 = f"""WITH {ranked_sql(20)}, p AS (SELECT qid, sum(id % 50 + 10) OVER (PARTITION BY qid ORDER BY rank) AS spent FROM r)
SELECT qid, count(*) AS kept, CAST(max(spent) AS BIGINT) AS spent FROM p WHERE spent <= 200 GROUP BY qid"""

QUERIES = {f.__name__: f for f in (q09_dense_top20, q50_pivots_top20, q10_confidence_gate, q11_window_rerank, q12_profiles_paired, q13_fusion, q14_located_blocks, q15_interval_coverage, q16_window_scores, q18_context_precision, q20_bm25, q32_vector_rules, q35_citation_check, q38_canonical_alignment, q39_budget_prefix)}
ORACLES = {"q09_dense_top20": Q09, "q50_pivots_top20": Q09, "q10_confidence_gate": Q10, "q11_window_rerank": Q11, "q12_profiles_paired": Q12, "q13_fusion": Q13, "q14_located_blocks": Q14, "q15_interval_coverage": Q15, "q16_window_scores": Q16, "q18_context_precision": Q18, "q20_bm25": Q20, "q32_vector_rules": Q32, "q35_citation_check": Q35, "q39_budget_prefix": Q39}
