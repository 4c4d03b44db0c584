"""Repeated passages by super-k-mers: windows of ``width`` words that start anywhere else too.

Each window has a minimiser, the first least hash among its ``gram``-word runs; consecutive windows with one minimiser
at one place form a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser occurs elsewhere can
hold a repeated window: the others are told apart by counting minimisers and never travel. Of those left, equal
super-k-mers, by a 128-bit cryptographic hash of their words, are found first: a group of copies has each of them
thousands of times, so the members are dealt over DEALS parts, and one member of each part meets those of the others.
One of each kind travels, as one string of words, to the bucket of its minimiser, where sorting the windows counts
them exactly. A minimiser with more than ``hot`` different super-k-mers deals out its windows one by one instead, each
to the bucket of its own words. Words covered by a repeated window go; the texts are joined to the spans by a row key.

Null or empty text: no words. A text shorter than a window keeps all words. Repeated rows are documents of their own,
so each makes the other's windows repeated; their spans, which are the same, are held once. Which of equal super-k-mers
travels (least row key, then place) changes no result. A null doc_id stays null. An empty table gives an empty result.
Further columns are ignored. A very long text is one row's work: time and memory grow with its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, row_key, rows

WIDTH, GRAM, HOT = 35, 8, 2000
#: Parts that the members of a group of equal super-k-mers are dealt over.
DEALS = 64
_A = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of ``width`` values."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(base) + h[j : j + len(out)]
    return _mix(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum of each run of ``width`` values, by doubling."""
    have, at = 1, np.arange(len(x))
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at


def super_kmers(words: list[bytes], width: int, gram: int):
    """(first window, number of windows, minimiser, 128-bit hash of all its words) of each super-k-mer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in words], np.uint64)
    grams = _rolling(h, gram, _A)
    at = _least(grams, width - gram + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    start, end = np.r_[0, cut], np.r_[cut, len(at)]
    # words s .. e, joined, are a slice of all words, joined
    joined, place = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
    slices = zip(place[start].tolist(), (place[end + width - 1] - 1).tolist(), strict=True)
    whole = [hashlib.blake2b(joined[i:j], digest_size=16).digest() for i, j in slices]
    return start.tolist(), (end - start).tolist(), grams[at[start]].view(np.int64).tolist(), whole


def repeated_windows(strings: list[bytes], width: int) -> list[list[int]]:
    """For different super-k-mers of one bucket: which windows of each occur in the bucket more than once."""
    found = []
    for i, s in enumerate(strings):
        words = s.split(b" ")
        found += [(b" ".join(words[j : j + width]), i, j) for j in range(len(words) - width + 1)]
    found.sort()
    out: list[list[int]] = [[] for _ in strings]
    for n, (window, i, j) in enumerate(found):
        if (n and found[n - 1][0] == window) or (n + 1 < len(found) and found[n + 1][0] == window):
            out[i].append(j)
    return out


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` with a row key, and (key, start, n): n windows from word ``start`` that are repeated."""
    keyed = docs.select("doc_id", "text", row_key().alias("key"))

    def cut(batches):
        dealt = TaskContext.get().partitionId()
        for key, text in rows(batches, "key", "text"):
            words = (text or "").encode("utf-8", "replace").split()
            if len(words) >= width:
                for t in zip(*super_kmers(words, width, gram), strict=True):
                    yield key, *t, dealt % DEALS
                dealt += 1

    cuts = materialise(map_rows(keyed.select("key", "text"), cut, "key binary, start int, n int, mini long, whole binary, deal int", 16384), "superkmers")
    # counts are written before they are joined, so that the join can split a minimiser with many rows
    again = materialise(cuts.groupBy("mini").count().where("count > 1").select("mini"), "again")
    part = Window.partitionBy("whole", "deal").orderBy("key", "start")
    dealt = cuts.join(again, "mini").select("key", "start", "n", "mini", "whole", F.row_number().over(part).alias("nth"), F.lead(F.lit(1)).over(part).isNotNull().alias("copied"))
    dealt = materialise(dealt, "dealt")
    # the first of each part: at most DEALS of a kind
    kind = Window.partitionBy("whole").orderBy("key", "start")
    met = dealt.where("nth = 1").withColumn("nth", F.row_number().over(kind)).withColumn("copied", F.col("copied") | (F.col("nth") > 1) | F.lead(F.lit(1)).over(kind).isNotNull())
    met = materialise(met.drop("whole"), "met")
    # equal super-k-mers that occur twice: every window of theirs is repeated
    copied = dealt.where("nth > 1").select("key", "start", "n").unionByName(met.where("copied").select("key", "start", "n"))
    kinds = met.where("nth = 1").select("key", "start", "n", "mini")
    # different super-k-mers of one minimiser: one of each travels
    several = materialise(kinds.groupBy("mini").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    sent = kinds.join(several, "mini").groupBy("key").agg(F.collect_list(F.struct("start", "n", "mini", (F.col("kinds") > hot).alias("split"))).alias("parts"))

    def pack(batches):
        for key, text, parts in rows(batches, "key", "text", "parts"):
            words = (text or "").encode("utf-8", "replace").split()
            for p in parts:
                s, n = p["start"], p["n"]
                if not p["split"]:
                    yield p["mini"], key, s, b" ".join(words[s : s + n + width - 1])
                else:
                    for j in range(s, s + n):
                        yield None, key, j, b" ".join(words[j : j + width])

    packed = map_rows(keyed.join(sent, "key").select("key", "text", "parts"), pack, "mini long, key binary, start int, words binary", 1024)
    packed = materialise(packed, "packed")

    def count(batches):
        bucket, held, last = None, [], None

        def done():
            if len(held) > 1:
                for (key, start, _), at in zip(held, repeated_windows([w for *_, w in held], width), strict=True):
                    for j in at:
                        yield key, start + j, 1

        for mini, key, start, words in rows(batches, "mini", "key", "start", "words"):
            if mini != bucket:
                yield from done()
                bucket, held = mini, []
            if (mini, key, start) != last:  # a repeated row sends its strings again
                held.append((key, start, words))
            last = mini, key, start
        yield from done()

    buckets = packed.where("mini IS NOT NULL").repartition("mini").sortWithinPartitions("mini", "key", "start")
    counted = map_rows(buckets.select("mini", "key", "start", "words"), count, "key binary, start int, n int")
    alone = packed.where("mini IS NULL").select("key", "start", F.sha2("words", 256).alias("window"))
    twice = materialise(alone.groupBy("window").count().where("count > 1").select("window"), "twice")
    spread = alone.join(twice, "window", "left_semi").select("key", "start", F.lit(1).alias("n"))
    return keyed, copied.unionByName(counted).unionByName(spread)


def covered(spans: list[tuple[int, int]], n_words: int, width: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for start, n in spans:
        edge[start] += 1
        edge[start + n - 1 + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the text that is left, words joined by one space."""
    keyed, spans = repeated_spans(docs, width, gram, hot)
    spans = materialise(spans.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")

    def make(batches):
        for doc_id, text, spans in rows(batches, "doc_id", "text", "spans"):
            words = (text or "").encode("utf-8", "replace").split()
            gone = covered([(s["start"], s["n"]) for s in spans or ()], len(words), width)
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            yield doc_id, len(words), int(gone.sum()), kept.decode()

    return map_rows(keyed.join(spans, "key", "left").select("doc_id", "text", "spans"), make, "doc_id long, n_words long, n_removed long, kept string", 512)


def query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text, from all windows in one table; for tests."""
    all_words = [(t or "").encode().split() for t in texts]
    seen: dict[bytes, int] = {}
    for words in all_words:
        for j in range(len(words) - width + 1):
            window = b" ".join(words[j : j + width])
            seen[window] = seen.get(window, 0) + 1
    out = []
    for words in all_words:
        gone = set()
        for j in range(len(words) - width + 1):
            if seen[b" ".join(words[j : j + width])] > 1:
                gone.update(range(j, j + width))
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return out


#: The same from all windows in one table, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT r, i, word, max(CASE WHEN twice.r IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM words LEFT JOIN twice USING (r, i)),
ends AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN ends USING (r)"""
