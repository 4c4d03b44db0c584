"""Chunks under a token budget: word windows with overlap, and sections kept whole or cut along the heading tree.

A document is one row and its chunks are made where it lies, without a shuffle: a chunk's start depends on where the one before it
ended. A tokeniser is a parameter: a function that gives the place where each token of a text starts. The tokens of any span are then
the difference of two searches, so a text is tokenised once however often it is cut. The default takes CJK characters and words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Where a text may be cut, coarsest first; subtrees of up to 1.5 budgets stay whole, texts of up to 2 are not cut.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")
WHOLE, UNCUT = 1.5, 2
_ATOM = re.compile("[一-鿿㐀-䶿＀-￯　-〿]|[^\\s一-鿿㐀-䶿＀-￯　-〿]+")
#: The start of each token of a text, in order; a token that starts inside a character has the start of the one before it.
Offsets = Callable[[str], list[int]]
Section = tuple[int, str | None, str]


def word_offsets(text: str) -> list[int]:
    return [m.start() for m in _ATOM.finditer(text)]


def size(text: str, offsets: Offsets) -> int:
    """How many tokens a text has; a tokeniser may have a ``count`` of its own, which need not find their places."""
    count = getattr(offsets, "count", None)
    return count(text) if count else len(offsets(text))


def count_words(text: str) -> int:
    return len(word_offsets(text))


def tail(text: str, n: int, offsets: Offsets = word_offsets) -> str:
    """The last ``n`` tokens of a text, fewer where they begin inside a character; nothing for none."""
    if n <= 0:
        return ""
    at = offsets(text)
    if len(at) <= n:
        return text.strip()
    begin = next((x for y, x in pairwise(at[len(at) - n - 1 :]) if x > y), len(text))
    return text[begin:].strip()


def joined(*pieces: str) -> str:
    return "\n\n".join(filter(None, map(str.strip, pieces)))


def runs(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of things of these sizes, each as long as the budget allows and at least one."""
    sums = [0, *accumulate(sizes)]
    first = 0
    while first < len(sizes):
        last = max(first + 1, bisect_right(sums, sums[first] + budget) - 1)
        yield first, last
        first = last


def hard_cuts(at: list[int], budget: int) -> Iterator[int]:
    """Where pieces after the first start, each of as many whole characters as the budget holds; one whose tokens exceed it stays whole."""
    first = 0
    while first + budget < len(at):
        within = (i for i in range(first + budget, first, -1) if at[i] > at[i - 1])
        beyond = (i for i in range(first + 1, len(at)) if at[i] > at[i - 1])
        first = next(within, None) or next(beyond, len(at))
        if first < len(at):
            yield at[first]


def split_to_size(text: str, budget: int, offsets: Offsets = word_offsets) -> list[str]:
    """Pieces within the budget, cut at the coarsest separator that helps; separators stay with the piece before them.

    Spans wait with the separators that they have not been cut at: a span between two separators of one kind has none of that or a coarser
    kind inside, so each is tried once. Spans of white space go. Where no separator is left, pieces take as many tokens as the budget holds.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    at = offsets(text)

    def between(lo: int, hi: int) -> int:
        return bisect_left(at, hi) - bisect_left(at, lo)

    out: list[str] = []
    waiting: list[tuple[int, int, int] | str] = [(0, len(text), 0)]
    while waiting:
        now = waiting.pop()
        if isinstance(now, str):
            out.append(now)
            continue
        lo, hi, kind = now
        piece = text[lo:hi]
        lo, hi = lo + len(piece) - len(piece.lstrip()), lo + len(piece.rstrip())
        if lo >= hi:
            continue
        if between(lo, hi) <= budget:
            out.append(text[lo:hi])
            continue
        spans: list[tuple[int, int]] = []
        while kind < len(SEPARATORS) and len(spans) < 2:
            cuts = re.compile(re.escape(SEPARATORS[kind])).finditer(text, lo, hi)
            spans = [(a, b) for a, b in pairwise([lo, *(m.end() for m in cuts), hi]) if text[a:b].strip()]
            kind += 1
        if len(spans) < 2:
            inner = hard_cuts(at[bisect_left(at, lo) : bisect_left(at, hi)], budget)
            out += [text[a:b] for a, b in pairwise([lo, *inner, hi]) if a < b]
            continue
        parts = [(*spans[a], kind) if b == a + 1 else "".join(text[x:y] for x, y in spans[a:b]).strip() for a, b in runs([between(x, y) for x, y in spans], budget)]
        waiting += reversed(parts)
    return out


def with_overlap(pieces: list[str], overlap: int, offsets: Offsets = word_offsets) -> list[str]:
    """Pieces, each headed by the last ``overlap`` tokens of the one before."""
    return [joined(tail(a, overlap, offsets), b) for a, b in pairwise(["", *pieces])]


def pack(units: list[str], budget: int, overlap: int = 0, offsets: Offsets = word_offsets) -> list[str]:
    """Units in chunks within the budget, in order; a chunk after the first starts with the last ``overlap`` tokens before it."""
    held = [u for u in map(str.strip, units) if u]
    ends = list(accumulate(size(u, offsets) for u in held))
    chunks: list[str] = []
    done = 0
    while done < len(held):
        lead = tail(chunks[-1], overlap, offsets) if chunks else ""
        room = (ends[done - 1] if done else 0) + budget - size(lead, offsets)
        upto = max(done + 1, bisect_right(ends, room))
        chunks.append(joined(lead, *held[done:upto]))
        done = upto
    return chunks


def subtree_ends(levels: list[int]) -> list[int]:
    """For each section of a document the place of the next one that is not below it: a subtree is a range of sections."""
    outer = {x: [*(i for i, y in enumerate(levels) if y <= x), len(levels)] for x in set(levels)}
    return [outer[x][bisect_right(outer[x], i)] for i, x in enumerate(levels)]


def section_chunks(sections: list[Section], budget: int, overlap: int = 0, offsets: Offsets = word_offsets, keep_bare_headings: bool = True) -> Iterator[tuple[list[str], str]]:
    """(heading path, text) of each chunk, from a document's flat sections in one pass.

    A subtree that fits 1.5 budgets is one chunk, prefixed by its path, and the pass goes on behind it; else its heading's own text
    goes ahead of the next section, the first below it. A prefixed text beyond two budgets is cut to size. A leaf with a heading only is a chunk
    of that heading under its parent's path, unless ``keep_bare_headings`` is off (the older strategy loses it).
    """
    listed = [*([] if sections and sections[0][1] is None else [(0, None, "")]), *sections]
    title = [f"{'#' * level} {heading}" if heading is not None else "" for level, heading, _ in listed]
    ends = subtree_ends([level for level, *_ in listed])
    sums = [0, *accumulate(size(t, offsets) + size(x, offsets) for t, (*_, x) in zip(title, listed, strict=True))]

    def prefixed(path: list[str], text: str) -> str:
        return f"[{' > '.join(path)}]\n{text}" if path else text

    above: list[int] = []
    lead, i, seen = "", 0, 0
    while i < len(listed):
        for j in range(seen, i + 1):  # open headings, those of whole subtrees passed over included
            above = [*(a for a in above if ends[a] > j), j]
        seen = i + 1
        whole = sums[ends[i]] - sums[i] - size(title[i], offsets) + size(lead, offsets)
        if ends[i] > i + 1 and whole > WHOLE * budget:
            lead, i = joined(lead, listed[i][2]), i + 1
            continue
        path = [listed[a][1] for a in above if listed[a][1] is not None]
        below = (part for j in range(i + 1, ends[i]) for part in (title[j], listed[j][2]))
        text = joined(lead, listed[i][2], *below)
        full = prefixed(path, text)
        if not text:
            if listed[i][1] and keep_bare_headings:
                yield path, prefixed(path[:-1], path[-1])
        elif size(full, offsets) <= UNCUT * budget:
            yield path, full
        else:
            yield from ((path, prefixed(path, piece)) for piece in with_overlap(split_to_size(text, budget, offsets), overlap, offsets))
        lead, i = "", ends[i]


def chunk_documents(docs: DataFrame, budget: int, overlap: int = 0, offsets: Offsets = word_offsets, keep_bare_headings: bool = True) -> DataFrame:
    """(doc_id, ordinal, chunk_id, heading_path, text, token_count) from ``docs(doc_id, text)`` in Markdown; a null text has no chunks."""
    from .sections import flat_sections

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, sections in zip(batch.doc_id, batch.sections, strict=True):
                listed = [(s["level"], s["heading"], s["text"]) for s in sections]
                for n, (path, text) in enumerate(section_chunks(listed, budget, overlap, offsets, keep_bare_headings)):
                    out.append((doc_id, n, f"{doc_id}::c{n:04d}", path, text, size(text, offsets)))
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "chunk_id", "heading_path", "text", "token_count"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", flat_sections(F.coalesce(F.col("text"), F.lit(""))).alias("sections")).mapInPandas(run, f"doc_id {kind}, ordinal int, chunk_id string, heading_path array<string>, text string, token_count long")


def word_windows(docs: DataFrame, size: int = 384, stride: int = 320) -> DataFrame:
    """(doc_id, ordinal, chunk_id, text, token_count): windows of words, in the JVM."""
    cut = docs.select("doc_id", F.posexplode(T.windows(T.words(F.col("text")), size, stride)).alias("ordinal", "w")).where(F.size("w") > 0)
    return cut.select("doc_id", "ordinal", F.format_string("%s::c%04d", F.col("doc_id").cast("string"), "ordinal").alias("chunk_id"), F.array_join("w", " ").alias("text"), F.size("w").cast("long").alias("token_count"))


def carry_overlap(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Consecutive windows of ``size`` words, each preceded by the last ``overlap`` words of the one before and a blank line."""
    cut = docs.select("doc_id", T.windows(T.words(F.col("text")), size, size).alias("w"))
    text = lambda w: F.array_join(w, " ")
    with_tail = F.transform("w", lambda w, i: F.when(i == 0, text(w)).otherwise(F.concat(text(F.slice(F.element_at("w", i), -F.least(F.lit(overlap), F.size(F.element_at("w", i))), F.lit(overlap))), F.lit("\n\n"), text(w))))
    return cut.where(F.size(F.element_at("w", 1)) > 0).select("doc_id", F.posexplode(with_tail).alias("ordinal", "text"))
