"""Personal data: four patterns as seeds, and contextual patterns bootstrapped from them.

Instances are the seeds' matches and other identifiers (five or more digits, or an at sign). Each has up to four lexical patterns:
its two words before; the word before and its own shape; the words before and after; its shape and the two words after. Shapes write
each run of digits as 9 and of letters as a. Patterns and values form a bipartite graph, scored in rounds: a pattern's confidence is the mean
score of its values, shrunk by one value that scores nothing; a value's score is that of its best pattern; seeds score 1, and what
a seed pattern takes for a card or an address but a checksum or a bound refutes scores 0 for good. Patterns count from ``support``
different accepted values on (a score of at least ``threshold``), so what one round accepts supports the next one's patterns. An
identifier in a place where one of its patterns ends with a confidence of at least ``threshold`` is found, though no seed pattern knows its form.

All of it is Column expressions and aggregations with partial sums over (pattern, value) pairs; the graph is small against the
texts (identifiers only) and is written to the shared folder between rounds.

Null or empty text: no spans. Very long texts and very many matches cost little more than linear time. Spans of different kinds
may overlap; found ones overlap no seed. Values of equal score are all kept. Repeated rows each get a row, a null doc_id stays null,
an empty table gives an empty one, further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise
from .spans import PLACE, clear_of, cut, ends_of, find_spans, once, places, ranked, running, written

#: The seed patterns. Possessive runs that start where a run begins cost linear time and match the same.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PARTS = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP = rf"(?:(?<![0-9])|\G){IP_PARTS}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifiers: what a seed pattern may match, else runs of letters, digits and joining marks with a digit or an at sign.
_RUN = r"\p{L}\p{N}_.@+#/-"
IDENTIFIER = rf"{EMAIL}|{PHONE}|(?<![0-9]){IP_PARTS}|(?<![0-9])[0-9](?:[\x20-]?[0-9]){{12,}}+|(?<![{_RUN}])[\p{{L}}_.+#/-]*+[0-9@][{_RUN}]*+"
#: Where a word begins: else a very long word would be tried from each of its letters.
_BEGIN = r"(?<![^\x20\x09-\x0D])"
#: Marks that end a sentence rather than an identifier.
TRAILING = "_.+#/-@"

KINDS = ("email", "ip", "card", "phone")
NEAR = "array<struct<s:int,e:int,patterns:array<string>,value:bigint,kind:int,long:boolean>>"
ROUNDS, SUPPORT, THRESHOLD = 3, 3, 0.8


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def seeds(text: Column) -> dict[str, Column]:
    number = text.rlike("[0-9]")
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    n_digits = lambda x: F.length(digits(x["m"]))
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find_spans(text, IP, number), lambda x: F.forall(F.split(x["m"], r"\."), lambda p: small(p) & (F.when(small(p), p.cast("decimal(38,0)")).otherwise(F.lit(999)) <= 255))),
        "card": F.filter(find_spans(text, CARD, number), lambda x: luhn_number(x["m"])),
        "phone": F.filter(find_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n_digits(x).between(9, 15)),
    }


def luhn_number(m: Column) -> Column:
    """Whether a match of CARD is a card."""
    n = F.length(digits(m))
    return n.between(13, 19) & luhn(F.when(n.between(13, 19), digits(m)).otherwise("1"))


def _word(gap: Column, pattern: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(gap, pattern, 1)), SPACE, " ")


def instances(docs: DataFrame) -> DataFrame:
    """Per document the seed spans, and ``near``: all identifiers with their place, patterns, value and kind (1 seed, 0 refuted, null unknown)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # one split at all identifiers gives the words around each; what is no identifier after all stays in place as "#"
    found = docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), *[places(c).alias(k) for k, c in seeds(text).items()], F.when(text.rlike("[0-9@]"), cut(text, IDENTIFIER)).otherwise(F.array().cast("array<struct<g:string,m:string>>")).alias("cut"))

    def around(pieces: Column) -> Column:
        """Each match with its end, the text before and behind it, and whether it is the first or the last."""
        n = F.size(pieces) - 1
        ended = F.zip_with(F.slice(pieces, 1, n), F.slice(ends_of(pieces), 1, n), lambda x, e: F.struct(x["m"].alias("m"), x["g"].alias("g"), e.alias("e")))
        behind = F.transform(F.slice(pieces, 2, n), lambda x, i: F.struct(x["g"].alias("g"), (i == 0).alias("first"), (i == n - 1).alias("last")))
        return F.zip_with(ended, behind, lambda x, y: describe(x, y["g"], y["first"], y["last"]))

    def describe(x: Column, after: Column, first: Column, last: Column) -> Column:
        m = F.rtrim(x["m"], F.lit(TRAILING))
        kind = F.when(m.rlike(f"^{EMAIL}$"), 1).when(m.rlike(f"^{PHONE}$") & F.length(digits(m)).between(9, 15), 1)
        kind = kind.when(m.rlike(f"^{IP}$"), F.forall(F.split(m, r"\."), lambda p: F.when(F.length(p) <= 9, p.cast("int")).otherwise(999) <= 255).cast("int"))
        kind = kind.when(m.rlike(f"^{CARD}$") & F.length(digits(m)).between(13, 19), luhn_number(m).cast("int"))
        e = x["e"]
        # a gap with fewer words than are asked for ends at the text's edge or at the identifier beyond it
        before = F.concat(F.when(first, "^ ^ ").otherwise("# # "), x["g"])
        behind = F.concat(after, F.when(last, " $ $").otherwise(" # #"))
        shape = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"\p{L}+", "a")
        two, one = _word(before, rf"{_BEGIN}([^\x20\x09-\x0D]+{SPACE}[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z"), _word(before, rf"{_BEGIN}([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z")
        next_two, next_one = _word(behind, rf"\A[\x20\x09-\x0D]*([^\x20\x09-\x0D]+{SPACE}[^\x20\x09-\x0D]+)"), _word(behind, r"\A[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")
        patterns = F.array(F.concat(two, F.lit(" _")), F.concat(one, F.lit(" _ "), shape), F.concat(one, F.lit(" _ "), next_one), F.concat(F.lit("_ "), shape, F.lit(" "), next_two))
        s = e - F.length(x["m"])
        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), patterns.alias("patterns"), F.xxhash64(F.lower(m)).alias("value"), kind.alias("kind"), (F.contains(m, F.lit("@")) | (F.length(digits(m)) >= 5)).alias("long"))

    each = F.when(F.size("cut") > 1, once(F.col("cut"), around)).otherwise(F.expr(f"CAST(array() AS {NEAR})"))
    return found.select("key", "doc_id", *KINDS, F.filter(each, lambda x: x["long"]).alias("near"))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(pattern, confidence) after the last round."""
    pairs = found.select(F.explode("near").alias("x")).select("x.value", "x.kind", F.explode("x.patterns").alias("pattern"))
    pairs = materialise(pairs.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pairs")
    # a value that is a seed somewhere is one everywhere; a refuted one never scores
    known = materialise(pairs.groupBy("value").agg(F.max("kind").alias("kind")), "known")
    scores = known.select("value", F.coalesce(F.col("kind").cast("double"), F.lit(0.0)).alias("score"))
    patterns = None
    for _ in range(rounds):
        rated = pairs.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("score") >= threshold).alias("support"))
        patterns = materialise(rated.where(F.col("support") >= support).select("pattern", "confidence"), "patterns")
        best = pairs.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        scores = materialise(known.join(best, "value", "left").select("value", F.coalesce(F.col("kind").cast("double"), "best", F.lit(0.0)).alias("score")), "scores")
    return patterns


def scan(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, email, ip, card, phone, context): spans of each kind."""
    found = materialise(instances(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("key"))), "pii")
    patterns = confident_patterns(found, rounds, support, threshold).where(F.col("confidence") >= threshold).select("pattern")
    unseen = found.select("key", F.explode("near").alias("x")).where("x.kind IS NULL").select("key", "x.s", "x.e", F.explode("x.patterns").alias("pattern"))
    context = unseen.join(patterns, "pattern", "left_semi").groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("context"))
    free = clear_of(F.array_sort(F.coalesce("context", F.expr(f"CAST(array() AS {PLACE})"))), [F.col(k) for k in KINDS])
    return found.join(context, "key", "left").select("doc_id", *KINDS, free.alias("context"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in square brackets; rows, order of columns and other columns stay.

    Of overlapping spans the first is replaced and the others are covered by it.
    """
    row, listed_, kept_ = (f"{n}-{uuid.uuid4().hex}" for n in ("row", "spans", "kept"))  # no table has such a column
    kept = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "redact")  # written, so the numbers stay
    spans = scan(kept.select(F.col(f"`{row}`").alias("doc_id"), "text"))
    listed = spans.select(F.col("doc_id").alias(row), ranked([(k, F.col(k)) for k in (*KINDS, "context")], True).alias(listed_)).where(F.size(F.col(f"`{listed_}`")) > 0)

    def fresh(all_: Column) -> Column:
        # a span that starts before an earlier one's end adds to it and is not written
        reach = running(F.transform(all_, lambda x: x["e"]), 0, F.greatest)
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        return F.zip_with(F.zip_with(all_, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), reach, lambda xb, r: F.struct(xb["x"]["k1"].alias("s"), r.alias("r"), F.upper(xb["x"]["kind"]).alias("kind"), (xb["x"]["k1"] < xb["b"]).alias("covered"), xb["b"].alias("b")))

    def assemble(letters: Column) -> Column:
        # substrings by place would read the text from its start for each span
        part = lambda s, e: F.array_join(F.slice(letters, s + 1, F.greatest(e - s, F.lit(0))), "")
        spans_ = F.col(f"`{kept_}`")
        parts = F.transform(spans_, lambda x: F.when(x["covered"], "").otherwise(F.concat(part(x["b"], x["s"]), F.lit("["), x["kind"], F.lit("]"))))
        return F.concat(F.array_join(parts, ""), part(F.get(spans_, F.size(spans_) - 1)["r"], F.size(letters)))

    joined = kept.join(listed, row, "left").withColumn(kept_, once(F.col(f"`{listed_}`"), fresh))
    text = F.when(F.col(f"`{listed_}`").isNull(), F.col("text")).otherwise(once(F.split("text", ""), assemble))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    kinds = [(k, F.col(k)) for k in KINDS]
    listed = scan(docs).select("*", ranked(kinds, False).alias("base"), ranked([*kinds, ("context", F.col("context"))], False).alias("all"))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return listed.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base"), False).cast("binary"), 256).alias("base_sha256"), written(F.col("all"), False).alias("spans"), count("context"))
