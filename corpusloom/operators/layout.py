"""Markdown from layout tables: words with boxes (as character recognition gives them) and styled paragraphs.

Extraction itself (from PDF or DOCX bytes) needs optional libraries and stays behind the sources' extractor functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Colour and height that make a heading candidate, height ratios of its levels, gaps that join or part lines.
CHROMA, TALL, LEVEL1, LEVEL2 = 12, 1.15, 0.85, 0.55
JOIN_GAP, JOIN_HEIGHT, BREAK_GAP = 0.6, 0.7, 1.6
LANGUAGE_PACKS = {"en": "eng", "zh": "chi_sim", "mixed": "chi_sim+eng"}
DEFAULT_PACK = "chi_sim+eng"
#: White space in Unicode's sense, which ``T.strip`` takes away.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HEADING, _LISTED = re.compile(r"^Heading\s*(\d+)$", re.I | re.A), re.compile(r"^List (Bullet|Number)\s*(\d*)$", re.I | re.A)


def language_pack(language: Column) -> Column:
    pack = F.lit(DEFAULT_PACK)
    for name, value in LANGUAGE_PACKS.items():
        pack = F.when(language == name, value).otherwise(pack)
    return pack


def word_lines(words: DataFrame) -> DataFrame:
    """Lines (page, text, x0, y0, x1, y1, height, color) from words (page, block, par, line, ix, text, left, top, width, height, color)."""
    kept = words.where(T.strip(F.col("text")) != "")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"])
    got = kept.groupBy("page", "block", "par", "line").agg(T.smart_join(pieces).alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), F.min_by("color", "ix").alias("color"))
    return got.withColumn("height", F.col("y1") - F.col("y0")).drop("block", "par", "line")


def upper_median(values: Column) -> Column:
    """The middle of sorted values, the upper one of two; 1 for none."""
    s = F.array_sort(values)
    return F.when(F.size(s) == 0, F.lit(1.0)).otherwise(F.try_element_at(s, (F.size(s) / 2).cast("int") + 1).cast("double"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """Adds ``level``: 0 for body lines and list items, 1 to 3 by height against the tallest candidate of the page."""
    w = Window.partitionBy("page")
    body = upper_median(F.collect_list("height").over(w))
    chroma = F.array_max("color") - F.array_min("color")
    marked = lines.withColumn("_body", body).withColumn("_c", (chroma >= CHROMA) | (F.col("height") >= F.col("_body") * TALL))
    tallest = F.coalesce(F.max(F.when(F.col("_c"), F.col("height"))).over(w), F.col("_body"))
    ratio = F.try_divide(F.col("height").cast("double"), tallest)
    listed = F.col("text").rlike(r"^[-*•]")
    level = F.when(~F.col("_c") | listed, 0).when(ratio >= LEVEL1, 1).when(ratio >= LEVEL2, 2).otherwise(3)
    return marked.withColumn("level", level).drop("_body", "_c")


def merge_headings(lines: Column) -> Column:
    """An array of lines in reading order with adjacent headings of about one height joined; each is compared with what was merged before it."""

    def step(a: Column, ln: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        near = (ln["level"] > 0) & (F.size(a) > 0) & (last["level"] > 0) & (ln["y0"] - last["y1"] < last["height"] * JOIN_GAP) & (F.least(ln["height"], last["height"]) / F.greatest(ln["height"], last["height"]) > JOIN_HEIGHT)
        one = F.struct(
            T.smart_join(F.array(last["text"], ln["text"])).alias("text"), last["y0"].alias("y0"), ln["y1"].alias("y1"), F.greatest(last["height"], ln["height"]).alias("height"), F.least(last["level"], ln["level"]).alias("level")
        )
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(one))).otherwise(F.concat(a, F.array(ln)))

    return F.aggregate(lines, F.slice(lines, 1, 0), step)


def lines_to_markdown(lines: DataFrame) -> DataFrame:
    """(page, markdown) from lines: headings, list items and paragraphs parted by gaps."""
    listed = heading_levels(lines).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "text", "y1", "height", "level"))).alias("l"))
    plain = listed.select("page", F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["y0"].alias("y0"), x["y1"].alias("y1"), x["height"].alias("height"), x["level"].alias("level"))).alias("l"))
    merged = plain.select("page", merge_headings(F.col("l")).alias("l")).withColumn("body", upper_median(F.transform(F.filter("l", lambda x: x["level"] == 0), lambda x: x["height"])))
    start = F.expr("named_struct('bottom', CAST(NULL AS int), 'open', false, 'out', CAST(array() AS array<struct<level:int,parts:array<string>>>))")

    def step(a: Column, ln: Column) -> Column:
        gap = F.coalesce(ln["y0"] - a["bottom"] > F.col("body") * BREAK_GAP, F.lit(False))
        joins = (ln["level"] == 0) & a["open"] & ~gap & ~ln["text"].rlike(r"^[-*•]")
        last = F.try_element_at(a["out"], F.lit(-1))
        grown = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["level"].alias("level"), F.concat(last["parts"], F.array(ln["text"])).alias("parts"))))
        added = F.concat(a["out"], F.array(F.struct(ln["level"].cast("int").alias("level"), F.array(ln["text"]).alias("parts"))))
        return F.struct(ln["y1"].cast("int").alias("bottom"), (ln["level"] == 0).alias("open"), F.when(joins, grown).otherwise(added).alias("out"))

    blocks = F.aggregate("l", start, step, lambda a: a["out"])
    text = F.transform(blocks, lambda b: F.when(b["level"] > 0, F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["parts"][0])).otherwise(T.smart_join(b["parts"])))
    return merged.select("page", F.array_join(text, "\n\n").alias("markdown"))


def style_level(style: Column) -> Column:
    """Heading level of a paragraph style: titles 1, heading n one below, 6 at most; null for others."""
    s = F.trim(F.coalesce(style, F.lit("")))
    n = F.regexp_extract(s, r"(?i)^Heading\s*(\d+)$", 1)
    return F.when(s.isin("Title", "Document Title"), 1).when(n != "", F.least(n.cast("int") + 1, F.lit(6)))


def paragraphs_to_markdown(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, markdown) from paragraphs (doc_id, ix, style, runs array<struct<text,bold,italic>>, cells array<array<string>>).

    Numbered items count on for each indent until a paragraph of another kind comes between. Rows with cells are tables.
    """
    run = lambda r: F.concat(F.when(r["bold"] & r["italic"], "***").when(r["bold"], "**").when(r["italic"], "*").otherwise(""), r["text"], F.when(r["bold"] & r["italic"], "***").when(r["bold"], "**").when(r["italic"], "*").otherwise(""))
    text = T.strip(F.array_join(F.transform(F.filter("runs", lambda r: r["text"] != ""), run), ""))
    tidy = F.filter(F.transform("cells", lambda row: F.transform(row, lambda c: F.regexp_replace(T.strip(c), "\n", " "))), lambda row: F.exists(row, lambda c: c != ""))
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    table = F.when(F.size(tidy) > 0, F.array_join(F.concat(F.array(line(tidy[0]), line(F.transform(tidy[0], lambda _: F.lit("---")))), F.transform(F.slice(tidy, 2, F.size(tidy)), line)), "\n"))
    listed = F.regexp_extract("style", r"(?i)^List (Bullet|Number)\s*\d*$", 1)
    depth = F.regexp_extract("style", r"(?i)^List (?:Bullet|Number)\s*(\d*)$", 1)
    p = paragraphs.select("doc_id", "ix", F.coalesce("style", F.lit("")).alias("style"), F.coalesce("runs", F.expr("CAST(array() AS array<struct<text:string,bold:boolean,italic:boolean>>)")).alias("runs"), F.col("cells"))
    p = p.withColumn("is_table", F.col("cells").isNotNull()).withColumn("text", F.when(F.col("is_table"), table).otherwise(text)).where(F.col("is_table") | (F.col("text") != ""))
    p = p.withColumn("kind", F.when(F.col("is_table"), "table").when(style_level(F.col("style")).isNotNull(), "heading").when(F.lower(listed) == "number", "number").when(F.lower(listed) == "bullet", "bullet").otherwise("body"))
    p = p.withColumn("indent", F.when(depth != "", depth.cast("int") - 1).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy("ix")
    p = p.withColumn("stretch", F.sum(F.when(F.col("kind") == "number", 0).otherwise(1)).over(order))
    p = p.withColumn("no", F.sum(F.when(F.col("kind") == "number", 1).otherwise(0)).over(Window.partitionBy("doc_id", "stretch", "indent").orderBy("ix")))
    pad = F.repeat(F.lit("  "), F.col("indent"))
    written = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), style_level(F.col("style"))), F.lit(" "), F.col("text"))).when(F.col("kind") == "bullet", F.concat(pad, F.lit("- "), F.col("text"))).when(F.col("kind") == "number", F.concat(pad, F.col("no").cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    gathered = p.withColumn("w", written).where("w IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ix", "w"))).alias("all"))
    return gathered.select("doc_id", F.concat(T.strip(F.array_join(F.transform("all", lambda x: x["w"]), "\n\n")), F.lit("\n")).alias("markdown"))


def blocks_to_markdown(blocks: Iterable[tuple]) -> str:
    """The Markdown of one document's blocks ``(ix, style, runs, cells)`` in order, runs as (text, bold, italic): what ``paragraphs_to_markdown`` makes of them as a table.

    A file's blocks come from one task in their order, so they need no shuffle, sort or windows.
    """
    out: list[str] = []
    numbers: dict[int, int] = {}
    for _, style, runs, cells in blocks:
        if cells is not None:
            numbers = {}
            rows = [r for r in ([c.strip(_WHITE).replace("\n", " ") for c in row] for row in cells) if any(r)]
            if rows:
                out.append("\n".join(f"| {' | '.join(r)} |" for r in (rows[0], ["---"] * len(rows[0]), *rows[1:])))
            continue
        mark = lambda bold, italic: "***" if bold and italic else "**" if bold else "*" if italic else ""
        text = "".join(mark(b, i) + t + mark(b, i) for t, b, i in runs or () if t).strip(_WHITE)
        if not text:
            continue
        style = style or ""
        title, heading, listed = style.strip(" ") in ("Title", "Document Title"), _HEADING.match(style.strip(" ")), _LISTED.match(style)
        indent = int(listed[2]) - 1 if listed and listed[2] else 0
        if listed and listed[1].lower() == "number":
            numbers[indent] = numbers.get(indent, 0) + 1
            out.append(f"{'  ' * indent}{numbers[indent]}. {text}")
            continue
        numbers = {}
        out.append(f"{'#' * (1 if title else min(int(heading[1]) + 1, 6))} {text}" if title or heading else f"{'  ' * indent}- {text}" if listed else text)
    return "\n\n".join(out).strip(_WHITE) + "\n"
