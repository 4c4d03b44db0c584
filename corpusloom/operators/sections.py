"""Markdown sections: segmentation at headings, ancestor paths, cleaning, and headings inferred from plain text.

A document is one row and its sections an array, folded inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"(?md)^(?=#{1,6}[^\S\n])"
SECTION = "struct<level:int,heading:string,text:string>"


def flat_sections(body: Column) -> Column:
    """Array of (level, heading, text) in order; text before the first heading has level 0 and no heading, and goes if empty."""

    def one(piece: Column) -> Column:
        marks = F.length(F.regexp_extract(piece, r"\A(#{1,6})[^\S\n]", 1))
        heading = F.when(marks > 0, T.strip(F.regexp_extract(piece, r"\A#{1,6}[^\S\n]+([^\n]*)", 1)))
        text = F.when(marks > 0, F.regexp_replace(piece, r"\A[^\n]*\n?", "")).otherwise(piece)
        return F.struct(marks.alias("level"), heading.alias("heading"), T.strip(text).alias("text"))

    return F.filter(F.transform(F.split(body, HEADING), one), lambda s: s["heading"].isNotNull() | (s["text"] != ""))


def with_paths(sections: Column) -> Column:
    """Each section with the headings of its ancestors and its own: those above it with a lower level, none of which is closed."""
    start = F.expr(f"named_struct('open', CAST(array() AS array<struct<level:int,heading:string>>), 'out', CAST(array() AS array<struct<section:{SECTION},path:array<string>>>))")

    def step(a: Column, s: Column) -> Column:
        above = F.filter(a["open"], lambda o: o["level"] < s["level"])
        now = F.when(s["heading"].isNull(), a["open"]).otherwise(F.concat(above, F.array(F.struct(s["level"].alias("level"), s["heading"].alias("heading")))))
        path = F.when(s["heading"].isNull(), F.array().cast("array<string>")).otherwise(F.transform(now, lambda o: o["heading"]))
        return F.struct(now.alias("open"), F.concat(a["out"], F.array(F.struct(s.alias("section"), path.alias("path")))).alias("out"))

    return F.aggregate(sections, start, step, lambda a: a["out"])


def sections_table(docs: DataFrame, body: str = "text") -> DataFrame:
    """One row for each section: doc_id, sec_ix, level, heading, text, path."""
    listed = docs.select("doc_id", F.posexplode(with_paths(flat_sections(F.col(body)))).alias("sec_ix", "s"))
    return listed.select("doc_id", "sec_ix", "s.section.level", "s.section.heading", "s.section.text", "s.path")


def clean(docs: DataFrame, body: str = "text", normalise: bool = True) -> DataFrame:
    """Adds ``cleaned``, ``sections_dropped`` and ``escapes_fixed``: boilerplate sections go, texts are unescaped and tidied."""
    tidy = lambda c: T.tidy(T.unescape(c))
    source = T.nfc(F.col(body)) if normalise else F.col(body)
    # texts are tidied once, in an array that the next one is made from; columns that are used twice stand in a projection of their own
    cut = docs.withColumn("_s", flat_sections(source))
    cut = cut.withColumn("_k", F.filter("_s", lambda s: ~T.is_boilerplate(s["heading"])))
    done = F.transform("_k", lambda s: F.struct(F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), tidy(s["heading"])).alias("heading"), tidy(s["text"]).alias("text")))
    parts = F.flatten(F.transform(done, lambda d: F.array(d["heading"], F.when(d["text"] != "", d["text"]))))
    cut = cut.withColumn("_j", T.strip(F.array_join(F.array_compact(parts), "\n\n")))
    return cut.select(
        *docs.columns,
        F.when(F.col("_j") != "", F.concat("_j", F.lit("\n"))).otherwise("").alias("cleaned"),
        (F.size("_s") - F.size("_k")).cast("long").alias("sections_dropped"),
        T.escape_count(F.col(body)).alias("escapes_fixed"),
    )


def plain_blocks(c: Column) -> Column:
    """Blocks of a plain text, each an array of stripped lines."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), T.strip)
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")
    return F.transform(F.filter(F.split(joined, "\n{2,}"), lambda b: b != ""), lambda b: F.split(b, "\n"))


def block_kind(lines: Column) -> Column:
    one = F.size(lines) == 1
    return F.when(one & lines[0].rlike(r"^#{1,6}(?U:\s+)\S"), "leaked").when(one & T.is_heading_line(lines[0]), "heading").when(F.forall(lines, T.is_list_line), "list").otherwise("body")


def plain_parts(c: Column) -> Column:
    """Array of (kind, text): title, headings, list items and paragraphs of a plain text."""
    blocks = plain_blocks(c)

    def part(lines: Column) -> Column:
        kind = block_kind(lines)
        body = F.when(F.exists(lines, T.has_cjk), T.smart_join(lines)).otherwise(F.array_join(lines, " "))
        text = F.when(kind == "leaked", F.regexp_replace(lines[0], r"^(#{1,6})(?U:\s+)", "$1 ")).when(kind == "heading", F.concat(F.lit("## "), lines[0])).otherwise(body)
        return F.when(kind == "list", F.transform(lines, lambda item: F.struct(kind.alias("kind"), item.alias("text")))).otherwise(F.array(F.struct(kind.alias("kind"), text.alias("text"))))

    def parts(all_blocks: Column) -> Column:
        first = all_blocks[0]
        title = F.array(F.struct(F.lit("title").alias("kind"), F.concat(F.lit("# "), first[0]).alias("text")))
        rest = F.when(F.size(first) > 1, F.array(F.slice(first, 2, F.size(first)))).otherwise(F.array().cast("array<array<string>>"))
        others = F.concat(rest, F.slice(all_blocks, 2, F.size(all_blocks)))
        return F.when(F.size(all_blocks) > 0, F.concat(title, F.flatten(F.transform(others, part)))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))

    # the blocks are bound once by a fold over a single value
    return F.aggregate(F.array(blocks), F.array().cast("array<struct<kind:string,text:string>>"), lambda _, b: parts(b))


def plain_to_markdown(c: Column) -> Column:
    return F.concat(T.strip(F.array_join(F.transform(plain_parts(c), lambda p: p["text"]), "\n\n")), F.lit("\n"))
