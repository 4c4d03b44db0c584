"""Maximal common runs of a document and its chunks, and the source blocks that they cover.

A document and its chunks are ranked together by their suffixes (ranks of 1, 2, 4, ... characters, each from the one before), so the longest match
of every place of a chunk is with one of the two neighbours from the document, and the ranks give its length. That takes n log n time and some tens of bytes
a character, whatever repeats in the text; of the document only stretches that share ``least`` characters with a chunk are ranked. Places where a match can't be extended to the left begin maximal runs. Of overlapping runs the longest is
kept first, then the earliest; what that leaves of the others counts if it still has the least length.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of a run at least; characters of chunks that are matched at once, if the document is not longer.
LEAST, AT_ONCE = 16, 1_000_000
#: Rows of runs that a task gives at once; characters of a text times those of a document up to which it is searched piece by piece.
ROWS, SMALL = 10_000, 250_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def matches(document: str, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every place of each text: the length of the longest piece from there that the document has, and one of its places there."""
    parts, starts, at = [_codes(document)], [], len(document)
    for k, t in enumerate(texts):
        parts += [np.array([0x110000 + k]), _codes(t)]  # a separator that occurs once
        starts.append(at + 1)
        at += 1 + len(t)
    whole, longest = np.concatenate(parts), max([len(t) for t in texts], default=0)
    n = len(whole)
    ranks, span = [np.unique(whole, return_inverse=True)[1]], 1
    while span < longest:
        last = ranks[-1]
        second = np.zeros(n, np.int64)
        second[: n - span] = last[span:] + 1
        ranks.append(np.unique(last * (n + 1) + second, return_inverse=True)[1])
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    own = order < len(document)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(own, place, -1))
    after = np.minimum.accumulate(np.where(own, place, n)[::-1])[::-1]
    best, where = np.zeros(n, np.int64), np.full(n, -1)
    for near in (before, after):
        ok = ~own & (near >= 0) & (near < n)
        i, j = order[ok], order[near[ok]]
        length = np.zeros(len(i), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            a, b = i + length, j + length
            inside = (a < n) & (b < n)
            same = np.zeros(len(i), bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            length[same] += 1 << level
        longer = length > best[i]
        best[i[longer]], where[i[longer]] = length[longer], j[longer]
    return [(best[s : s + len(t)], where[s : s + len(t)]) for s, t in zip(starts, texts, strict=True)]


def fresh_runs(document: str, text: str, least: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the document, length) of maximal runs, for short texts: each search goes on from the length of the one before."""
    found, n, end = [], 0, len(text)
    for i in range(end):
        before, n = n, max(n - 1, 0)
        while i + n < end and text[i : i + n + 1] in document:
            n += 1
        if n >= least and (i == 0 or n != before - 1):
            found.append((i, document.find(text[i : i + n]), n))
    return found


def shared(document: str, texts: list[str], least: int) -> str:
    """The document without characters that no piece of ``least`` characters in common with a text covers; what is between two stretches becomes one separator.

    Pieces are told by hashes of their first characters (a power of two of them), so what is kept may be more than needed and is never less.
    """
    span = 1 << (least.bit_length() - 1)

    def hashes(text: str) -> np.ndarray:
        h, step, factor = _codes(text).astype(np.uint64), 1, 0x9E3779B97F4A7C15
        while step < span and len(h) > step:
            h, step, factor = h[:-step] * np.uint64(factor) + h[step:], 2 * step, factor * factor & 0xFFFFFFFFFFFFFFFF | 1
        return h if step == span else h[:0]

    own, other = hashes(document), np.unique(np.concatenate([hashes(t) for t in texts]))
    if not len(own) or not len(other):
        return ""
    at = np.flatnonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own)
    if not len(at):
        return ""
    new = np.flatnonzero(np.diff(at) > span) + 1
    return "\U0010ffff".join(document[a : b + span] for a, b in zip(at[np.r_[0, new]].tolist(), at[np.r_[new - 1, len(at) - 1]].tolist(), strict=True))


def disjoint(found: list[tuple[int, int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Of runs (place in the text, place in the document, length) those that share no place of the text, by place."""
    heap = [(-n, at, of) for at, of, n in found]
    heapq.heapify(heap)
    taken: list[tuple[int, int, int]] = []
    starts: list[int] = []
    while heap:
        n, at, of = heapq.heappop(heap)
        k = bisect.bisect_right(starts, at)
        begin = max(at, taken[k - 1][0] + taken[k - 1][2]) if k else at
        end = min(at - n, starts[k]) if k < len(starts) else at - n
        if end - begin < least:
            continue
        if end - begin < -n:  # shorter now: back in its place
            heapq.heappush(heap, (begin - end, begin, of + begin - at))
            continue
        starts.insert(k, at)
        taken.insert(k, (at, of, -n))
    return taken


def runs(document: str, texts: list[str], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Where each text stands in the document: whole, at its first place, or else in maximal runs of at least ``least`` characters, as intervals of the document."""
    out: list[list[tuple[int, int]]] = []
    rest = []
    for t in texts:
        at = document.find(t) if t else -1
        out.append([(at, at + len(t))] if at >= 0 else [])
        if t and at < 0:
            rest.append(len(out) - 1)
    pieces = [texts[k] for k in rest]
    # a character that may be in a text can't part stretches
    held = document if any("\U0010ffff" in t for t in pieces) else shared(document, pieces, least) if rest else ""
    if held:
        small = len(held) * sum(map(len, pieces)) <= SMALL
        for k, ranked in zip(rest, pieces if small else matches(held, pieces), strict=True):
            if small:
                found = fresh_runs(held, texts[k], least)
            else:
                length, where = ranked
                fresh = np.ones(len(length), bool)
                fresh[1:] = length[1:] != length[:-1] - 1
                found = [(int(i), int(where[i]), int(length[i])) for i in np.flatnonzero(fresh & (length >= least))]
            for i, _, n in disjoint(found, least):
                of = document.find(texts[k][i : i + n])
                out[k].append((of, of + n))
    return out


def _form(text: Column, normalise: bool | None) -> Column:
    """Canonical form, or the text as it is where ``normalise`` is None."""
    text = F.coalesce(text, F.lit(""))
    return text if normalise is None else T.canonical(text, normalise)


def chunk_runs(docs: DataFrame, chunks: DataFrame, normalise: bool | None = True, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_id, start, end) of each chunk's runs in its document, both in canonical form or, where ``normalise`` is None, as they are.

    A task gets one document with its chunks: the document once, its chunks as many at a time as it has characters. Null and empty
    chunks have no runs, nor has a chunk without a document.
    """
    import pandas as pd

    kinds = docs.schema["doc_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    body = docs.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast(kinds[1]).alias("chunk_id"), _form(F.col("text"), normalise).alias("text"))
    pieces = chunks.where("chunk_id IS NOT NULL").select("doc_id", "chunk_id", _form(F.col("text"), normalise).alias("text"))
    ordered = body.withColumn("piece", F.lit(False)).unionByName(pieces.withColumn("piece", F.lit(True))).repartition("doc_id").sortWithinPartitions("doc_id", "piece")

    def run(batches):
        owner, document, held, size, out = None, None, [], 0, []

        def flush():
            nonlocal held, size
            found = runs(document, [t for _, t in held], least)
            out.extend((owner, c, s, e) for (c, _), of in zip(held, found, strict=True) for s, e in of)
            held, size = [], 0

        def given():
            nonlocal out
            frame, out = pd.DataFrame(out, columns=["doc_id", "chunk_id", "start", "end"]), []
            return frame

        for batch in batches:
            for doc, chunk, text, piece in zip(batch.doc_id, batch.chunk_id, batch.text, batch.piece, strict=True):
                if not piece:
                    if held:
                        flush()
                    owner, document = doc, text
                elif document is not None and doc == owner:
                    held.append((chunk, text))
                    size += len(text)
                    if size > max(AT_ONCE, len(document)):
                        flush()
                if len(out) >= ROWS:
                    yield given()
        if held:
            flush()
        if out:
            yield given()

    return ordered.mapInPandas(run, f"doc_id {kinds[0]}, chunk_id {kinds[1]}, start int, end int")


def visible_headings(text: Column, path: Column, normalise: bool | None = True) -> Column:
    """The headings of ``path`` that a chunk's own text shows."""
    own = _form(text, normalise)
    return F.array_distinct(F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda h: _form(h, normalise)), lambda h: (h != "") & own.contains(h)))


def source_spans(docs: DataFrame, chunks: DataFrame, blocks: DataFrame, normalise: bool | None = True, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_id, block_id, start, end, length): the parts of aligned ``blocks(doc_id, block_id, start, end, length)`` that chunks cover.

    ``chunks(doc_id, chunk_id, text, heading_path)``. A first line in brackets, which the chunker wrote, has no place in the document and is left out of
    the runs; a block that is a heading which the chunk shows counts whole, wherever the chunk's runs are.
    """
    bare = F.when(F.col("text").startswith("[") & F.col("text").contains("\n"), F.expr(r"substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))
    r, b = chunk_runs(docs, chunks.withColumn("text", bare), normalise, least).alias("r"), blocks.alias("b")
    hit = r.join(b, (F.col("r.doc_id") == F.col("b.doc_id")) & (F.col("r.start") < F.col("b.end")) & (F.col("r.end") > F.col("b.start")))
    by_run = hit.select("r.doc_id", "r.chunk_id", "b.block_id", (F.greatest("r.start", "b.start") - F.col("b.start")).alias("start"), (F.least("r.end", "b.end") - F.col("b.start")).alias("end"), "b.length")
    body = docs.select("doc_id", _form(F.col("text"), normalise).alias("body"))
    titled = blocks.join(body, "doc_id").select("doc_id", "block_id", "length", F.expr("substring(body, start + 1, end - start)").alias("heading"))
    shown = chunks.select("doc_id", "chunk_id", F.explode(visible_headings(F.col("text"), F.col("heading_path"), normalise)).alias("heading"))
    by_heading = titled.join(shown, ["doc_id", "heading"]).select("doc_id", "chunk_id", "block_id", F.lit(0).alias("start"), F.col("length").cast("int").alias("end"), "length").distinct()
    return by_run.join(by_heading, ["doc_id", "chunk_id", "block_id"], "left_anti").select(*by_heading.columns).unionByName(by_heading)
