"""Queries over documents: profiles, redaction, conversion, sections, chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import SubwordOffsets
from ..operators import chunking, sections
from ..operators.integrity import duplicates
from ..operators.retrieval import reuse_by_text

CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{FF00}-\x{FFEF}\x{3000}-\x{303F}]"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


def q01_profile(spark, sf_dir):
    t = F.col("text")
    return docs_of(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(T.word_count(t)).alias("words"), F.count_if(T.has_cjk(t)).alias("cjk_docs"), F.sum(T.heading_count(t)).alias("headings"), F.sum(F.size(F.split(t, "\n"))).alias("lines"))


Q01 = rf"""SELECT lang, source, count(*) AS docs,
 CAST(sum(len(regexp_extract_all(text, '{CJK}')) + len(regexp_extract_all(regexp_replace(text, '{CJK}', ' ', 'g'), '\S+'))) AS BIGINT) AS words,
 count(*) FILTER (regexp_matches(text, '{CJK}')) AS cjk_docs, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: x[1] = '#'))) AS BIGINT) AS headings,
 CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY ALL"""


def q02_redaction(spark, sf_dir):
    red = docs_of(spark, sf_dir).select("doc_id", "text", T.redact(F.col("text")).alias("red"))
    return red.select("doc_id", (F.col("red") != F.col("text")).alias("changed"), sha(F.col("red")).alias("redacted_sha256"))


def _redact_sql() -> str:
    """The redactions for an engine without look-around: the neighbours are captured, and each rule runs twice."""
    out = "text"
    for pattern, kind in T.REDACTIONS:
        before, core, after = re.fullmatch(r"\(\?<!\[(.+?)\]\)(.+?)(?:\(\?!\[(.+?)\]\))?", pattern).groups()
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^{before}]){core}" + (f"($|[^{after}])', '\\1{kind}\\2', 'g')" if after else f"', '\\1{kind}', 'g')")
    return out


Q02 = f"SELECT doc_id, r <> text AS changed, sha256(r) AS redacted_sha256 FROM (SELECT doc_id, text, {_redact_sql()} AS r FROM documents)"


def q03_language_hint(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.language_hint(F.col("text")).alias("hint"))


Q03 = r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{30FF}]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents)
SELECT doc_id, CASE WHEN cjk = 0 THEN 'English' WHEN latin = 0 THEN 'Chinese (Simplified)' WHEN cjk >= latin THEN 'Chinese (Simplified), naturally keeping English terms the question itself used in English'
 ELSE 'English, naturally keeping Chinese terms the question itself used in Chinese' END AS hint FROM c"""


def q04_plain_text_parts(spark, sf_dir):
    parts = docs_of(spark, sf_dir).select("doc_id", F.posexplode(sections.plain_parts(F.col("text"))).alias("part_ix", "p"))
    return parts.select("doc_id", F.col("part_ix").cast("long").alias("part_ix"), "p.kind", sha(F.col("p.text")).alias("text_sha256"))


Q04 = r"""WITH l AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\n+|\n+$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(t, '\n{2,}'), lambda x: x <> ''), lambda x: string_split(x, chr(10))) AS bl FROM l),
e AS (SELECT doc_id, 0 AS bi, bl[1][1:1] AS ls, true AS title FROM b WHERE len(bl) > 0
 UNION ALL SELECT doc_id, 1, bl[1][2:], false FROM b WHERE len(bl) > 0 AND len(bl[1]) > 1
 UNION ALL SELECT doc_id, i, bl[i], false FROM (SELECT doc_id, bl, unnest(range(2, len(bl) + 1)) AS i FROM b)),
m AS (SELECT *, list_transform(ls, lambda x: x LIKE '- %' OR x LIKE '* %' OR x LIKE '• %' OR (regexp_matches(x, '^[0-9]+[.)]* ') AND strpos(x, ' ') <= 5)) AS li FROM e),
k AS (SELECT *, CASE WHEN title THEN 'title' WHEN len(ls) = 1 AND regexp_matches(ls[1], '^#{1,6}\s+\S') THEN 'leaked'
 WHEN len(ls) = 1 AND NOT li[1] AND NOT regexp_matches(ls[1], '[.。!!,，;；]$') AND length(ls[1]) <= 100 THEN 'heading' WHEN list_bool_and(li) THEN 'list' ELSE 'body' END AS kind FROM m),
x AS (SELECT doc_id, bi, j, kind, ls[j] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS j FROM k WHERE kind = 'list')
 UNION ALL SELECT doc_id, bi, 1, kind, CASE kind WHEN 'title' THEN '# ' || ls[1] WHEN 'leaked' THEN regexp_replace(ls[1], '^(#{1,6})\s+', '\1 ') WHEN 'heading' THEN '## ' || ls[1] ELSE array_to_string(ls, ' ') END FROM k WHERE kind <> 'list')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bi, j) - 1 AS part_ix, kind, sha256(text) AS text_sha256 FROM x"""


def headed(docs: DataFrame) -> DataFrame:
    """Documents as Markdown: above every third line stands a heading, its first 24 characters, of a level from its place and the document's id."""
    level = lambda i: F.pmod(F.floor(i / 3).cast("long") * 7 + F.col("doc_id"), F.lit(3)).cast("int") + 1
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), level(i)), F.lit(" "), F.substring(x, 1, 24), F.lit("\n"), x)).otherwise(x)
    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


def q05_sections(spark, sf_dir):
    table = sections.sections_table(headed(docs_of(spark, sf_dir)))
    return table.select("doc_id", F.col("sec_ix").cast("long").alias("sec_ix"), "level", "heading", F.array_join("path", " > ").alias("path"), sha(F.col("text")).alias("text_sha256"))


_SECTIONS = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, i // 3 AS sec_ix, CAST((i // 3 * 7 + doc_id) % 3 + 1 AS INTEGER) AS level, trim(substr(line, 1, 24)) AS heading FROM l WHERE i % 3 = 0),
t AS (SELECT doc_id, i // 3 AS sec_ix, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY ALL)"""
Q05 = rf"""WITH {_SECTIONS},
p AS (SELECT s.doc_id, s.sec_ix, a.sec_ix AS a_ix, a.heading FROM s JOIN s a ON a.doc_id = s.doc_id AND a.sec_ix < s.sec_ix AND a.level < s.level
 WHERE NOT EXISTS (SELECT 1 FROM s m WHERE m.doc_id = s.doc_id AND m.sec_ix > a.sec_ix AND m.sec_ix < s.sec_ix AND m.level <= a.level)),
g AS (SELECT doc_id, sec_ix, string_agg(heading, ' > ' ORDER BY a_ix) AS above FROM p GROUP BY ALL)
SELECT s.doc_id, s.sec_ix, s.level, s.heading, CASE WHEN g.above IS NULL THEN s.heading ELSE g.above || ' > ' || s.heading END AS path, sha256(regexp_replace(coalesce(t.text, ''), '^\s+|\s+$', '', 'g')) AS text_sha256
FROM s LEFT JOIN g USING (doc_id, sec_ix) LEFT JOIN t USING (doc_id, sec_ix)"""


def q06_word_windows(spark, sf_dir):
    w = chunking.word_windows(docs_of(spark, sf_dir))
    return w.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id", "token_count", sha(F.col("text")).alias("text_sha256"))


Q06 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(0, len(w), 320)) AS s FROM w),
y AS (SELECT doc_id, s // 320 AS ordinal, w[s + 1 : s + 384] AS w FROM x)
SELECT doc_id, ordinal, printf('%d::c%04d', doc_id, ordinal) AS chunk_id, len(w) AS token_count, sha256(array_to_string(w, ' ')) AS text_sha256 FROM y"""


def q07_overlap(spark, sf_dir):
    return chunking.carry_overlap(docs_of(spark, sf_dir), 200, 16).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), sha(F.col("text")).alias("text_sha256"))


Q07 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(0, len(w), 200)) AS s FROM w),
y AS (SELECT doc_id, s // 200 AS ordinal, array_to_string(w[s + 1 : s + 200], ' ') AS t, array_to_string(w[s + 185 : s + 200], ' ') AS tail FROM x)
SELECT doc_id, ordinal, sha256(coalesce(lag(tail) OVER (PARTITION BY doc_id ORDER BY ordinal) || chr(10) || chr(10), '') || t) AS text_sha256 FROM y"""


def q08_text_reuse(spark, sf_dir):
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    stored = docs.select("text", F.col("doc_id").alias("position"), F.col("doc_id").alias("vector_id"))
    same = duplicates(docs.withColumn("sha", sha(F.col("text"))), "sha")
    return reuse_by_text(docs, stored).join(same, "sha", "left").select("doc_id", "reused_id", F.coalesce("n", F.lit(1)).cast("long").alias("copies"))


Q08 = "SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS reused_id, count(*) OVER (PARTITION BY text) AS copies FROM documents"


def q37_section_chunks(spark, sf_dir):
    c = chunking.chunk_documents(headed(docs_of(spark, sf_dir)), 128, 16)
    return c.select("doc_id", "ordinal", "chunk_id", F.array_join("heading_path", " > ").alias("path"), "token_count", sha(F.col("text")).alias("text_sha256"))


def q64_subword_chunks(spark, sf_dir):
    """As q37, with budgets in subword tokens of a public vocabulary."""
    import public_tokenizers

    offsets = SubwordOffsets(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    c = chunking.chunk_documents(headed(docs_of(spark, sf_dir)), 256, 32, offsets)
    return c.select("doc_id", "ordinal", "chunk_id", F.array_join("heading_path", " > ").alias("path"), "token_count", sha(F.col("text")).alias("text_sha256"))


def q41_clean(spark, sf_dir):
    c = sections.clean(headed(docs_of(spark, sf_dir)), normalise=False)
    return c.select("doc_id", "sections_dropped", "escapes_fixed", F.length("cleaned").cast("long").alias("cleaned_chars"))


Q41 = rf"""WITH {_SECTIONS},
u AS (SELECT doc_id, sec_ix, level, heading, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\([\[\]\$\*])', '\1', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS t FROM s LEFT JOIN t USING (doc_id, sec_ix)),
g AS (SELECT doc_id, string_agg(repeat('#', level) || ' ' || heading || CASE WHEN regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') = '' THEN '' ELSE chr(10) || chr(10) || regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') END, chr(10) || chr(10) ORDER BY sec_ix) AS c FROM u GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '\\[\[\]\$\*]')) + CASE WHEN i % 3 = 0 THEN len(regexp_extract_all(substr(line, 1, 24), '\\[\[\]\$\*]')) ELSE 0 END) AS BIGINT) AS e FROM l GROUP BY doc_id)
SELECT doc_id, CAST(0 AS BIGINT) AS sections_dropped, e AS escapes_fixed, length(regexp_replace(c, '^\s+|\s+$', '', 'g')) + 1 AS cleaned_chars FROM g JOIN n USING (doc_id)"""

QUERIES = {f.__name__: f for f in (q01_profile, q02_redaction, q03_language_hint, q04_plain_text_parts, q05_sections, q06_word_windows, q07_overlap, q08_text_reuse, q37_section_chunks, q41_clean, q64_subword_chunks)}
ORACLES = {"q01_profile": Q01, "q02_redaction": Q02, "q03_language_hint": Q03, "q04_plain_text_parts": Q04, "q05_sections": Q05, "q06_word_windows": Q06, "q07_overlap": Q07, "q08_text_reuse": Q08, "q41_clean": Q41}
