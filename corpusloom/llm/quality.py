"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits.

The ledger holds each document's measurements and one bit for each rule it fails. A policy is a version's name and the
mask of the bits that reject; ablations count documents by their bits (at most 2 to the number of rules groups) and work
on the counts. The query returns the ledger itself, so what is stored serves later policies and ablations without a text.
Repeated three-word windows are found by sorting the windows' hashes within the document, so no row leaves its task.

Null or empty text: no words, so it fails the rule on length. Very long texts are measured whole. A measurement equal to its
limit does not fail. Repeated rows each get a row, a null doc_id stays null, an empty table gives an empty one,
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Rules by bit: name and condition on the measurements that fails a document. The first two are the base rules.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "100 * n_upper > 60 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v0": ("short", "repeated_windows"),
    "v1": ("short", "repeated_windows", "symbols", "repeated_lines", "upper_case", "word_length"),
}


def mask(names: tuple[str, ...]) -> int:
    at = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(at[n] for n in names)


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the windows' hashes in order."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # neighbours with one hash, both places
    twice = lambda s: F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    at = F.array_sort(F.array_distinct(F.flatten(F.aggregate(F.array(placed), F.array().cast("array<array<int>>"), lambda _, s: twice(s)))))
    # a window covers its own word and the next two, up to the next window
    return F.aggregate(F.array(at), F.lit(0).cast("long"), lambda _, p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_repeat_words)."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.zip_with(F.slice("words", 1, n - 2), F.slice("words", 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("words", 3, n - 2), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c)))
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        windows.alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("windows")))
    return hashed.withColumn("n_repeat_words", repeated).drop("windows")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements with ``failures``: bit i is set where rule i fails."""
    bits = " | ".join(f"CASE WHEN {fails} THEN {1 << i}L ELSE 0L END" for i, (_, fails) in enumerate(RULES))
    return measure(docs).withColumn("failures", F.expr(bits))


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with ``kept`` under a version of the policy."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only): documents that fail each rule, and those that only this rule rejects."""
    use = mask(POLICIES[version])
    groups = entries.groupBy(F.col("failures").bitwiseAND(F.lit(use)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).alias("bit")) for name in POLICIES[version]])
    each = groups.select("bits", "count", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy("r.rule").agg(F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"))


def query(docs: DataFrame) -> DataFrame:
    judged = apply_policy(ledger(docs))
    failed = F.col("failures").bitwiseAND(F.lit(mask(POLICIES["v0"]))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "n_upper", "failures")


#: Policy v1 for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
      length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_upper AS BIGINT) AS n_upper, failures
FROM (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
      + 16 * (100 * n_upper > 60 * word_chars)::INT + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS BIGINT) AS failures FROM m)"""
