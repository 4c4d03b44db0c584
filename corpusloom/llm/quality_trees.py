"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document's statistics (lengths, shares of letters, cases, symbols and words, repetition, entropy) are cut into at most ``BINS`` bins at
quantiles of the training rows. Trees of one depth are grown level by level on histograms of the gradients by node, statistic and bin; a node
without a useful cut sends all its rows left. The forest is three arrays (statistic and bin of each inner node, value of each leaf), so a batch
of documents goes down all trees at once by indexing, one step a level.

The forest is fitted on ``SAMPLE`` labelled training rows at most, those with the least hash of their id; all documents are scored where they lie
and nothing is shuffled for that. Statistics are computed over whole texts, in linear time.

Null or empty text: statistics of a text without words, scored like any other. Null doc_id: a training row that no label joins, still
scored. Repeated rows each get a row; of several documents with one id the fit takes the least statistics. Null labels are left out. Without labels of both kinds every score is the
share of label 1, 0.5 without any. Equal gains: the first statistic and bin. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_rows, rows

#: Labelled rows that the forest is fitted on at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_WEIGHT = 64, 60, 4, 0.2, 1.0, 1.0
ACCEPT = 0.3
#: Bytes by kind; bytes above 127 belong to letters of other alphabets.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"#*$%&|<>", b"\"'()[]{}/\\-_=+~^`@", bytes(range(128, 256))]


def _kind_table() -> np.ndarray:
    table = np.zeros((256, len(_KINDS) + 1))
    table[:, -1] = 1
    for k, members in enumerate(_KINDS):
        table[list(members), k], table[list(members), -1] = 1, 0
    return table


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text in UTF-8."""
    counts = np.zeros((len(texts), 256))
    own = np.zeros((len(texts), 13))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        n = len(words)
        distinct = set(words)
        lines = [line for line in text.split(b"\n") if line.strip()]
        own[i, :3] = math.log1p(n), math.log1p(len(text)), math.log1p(len(lines))
        if n:
            lengths = np.fromiter(map(len, words), np.int64, n)
            ends = b"".join([w[-1:] for w in words])
            own[i, 3:10] = lengths.mean(), lengths.std(), math.log1p(lengths.max()), len(distinct) / n, len(set(zip(words, words[1:], strict=False))) / n, sum(map(bytes.isupper, words)) / n, sum(map(ends.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"!"))) / n
            own[i, 10] = 1 - len(set(lines)) / max(1, len(lines))
            own[i, 11] = sum(map(bytes.istitle, words)) / n
        own[i, 12] = len(zlib.compress(text, 1)) / len(text)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    share = counts / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1, keepdims=True)
    return np.hstack([own, share @ _kind_table(), entropy])


class Forest(NamedTuple):
    cuts: list  # of each statistic, ascending
    statistic: np.ndarray  # trees x inner nodes
    bin: np.ndarray  # trees x inner nodes: rows of a higher bin go right
    value: np.ndarray  # trees x leaves
    base: float


def binned(x: np.ndarray, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), int)


def descend(forest: Forest, bins: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to in each tree: rows x trees."""
    n, (trees, inner) = len(bins), forest.statistic.shape
    node, at, each = np.zeros((n, trees), np.int64), np.arange(trees)[None, :], np.arange(n)[:, None]
    while inner:
        node = 2 * node + 1 + (bins[each, forest.statistic[at, node]] > forest.bin[at, node])
        inner >>= 1
    return node - forest.statistic.shape[1]


def probability(forest: Forest, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), forest.base)
    if forest.statistic.size:
        z += forest.value[np.arange(len(forest.value))[None, :], descend(forest, binned(x, forest.cuts))].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Trees that lessen the logistic loss of labels ``y`` step by step."""
    k, n = float(y.sum()), len(y)
    base = math.log((k + 0.5) / (n - k + 0.5))
    inner = 2**depth - 1
    if not 0 < k < n:
        return Forest([], np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="lower")) for j in range(x.shape[1])]
    b, width = binned(x, cuts), x.shape[1] * bins
    flat = b + np.arange(x.shape[1]) * bins
    z = np.full(n, base)
    forest = Forest(cuts, np.zeros((trees, inner), int), np.full((trees, inner), bins), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * width + flat).ravel()
            sums = [np.bincount(slot, np.repeat(v, x.shape[1]), nodes * width).reshape(nodes, x.shape[1], bins).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, (s[:, :1, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain = np.where((hl >= LEAST_WEIGHT) & (ha - hl >= LEAST_WEIGHT), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            useful = gain[np.arange(nodes), best] > 1e-9
            forest.statistic[t, first : first + nodes] = best // bins
            forest.bin[t, first : first + nodes] = np.where(useful, best % bins, bins)
            node = 2 * node + 1 + (b[np.arange(n), forest.statistic[t, node]] > forest.bin[t, node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, v, inner + 1) for v in (g, h))
        forest.value[t] = RATE * gs / (hs + RIDGE)
        z += forest.value[t, leaf]
    return forest


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _by_batch(batches, *names: str, size: int = 512):
    """Columns of ``size`` rows or about 16 MB of text at a time; the last name is the text."""
    held, held_bytes = [], 0
    for row in rows(batches, *names):
        held.append(row)
        held_bytes += len(row[-1])
        if len(held) >= size or held_bytes >= 16 << 20:
            yield [list(c) for c in zip(*held, strict=True)]
            held, held_bytes = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest of the label ``quality``, from training rows only."""
    train = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(~in_fold("doc_id", 5))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    joined = _texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def make(batches):
        for ids, ys, texts in _by_batch(batches, "doc_id", "y", "text"):
            yield from zip(ids, ys, statistics(texts).tolist(), strict=True)

    # one row for each labelled id, however many documents have it
    got = map_rows(joined, make, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    if not got:
        return Forest([], np.zeros((0, 0), int), np.zeros((0, 0), int), np.zeros((0, 1)), 0.0)
    got.sort(key=lambda r: (r.doc_id, r.y))
    return grow(np.array([r.x for r in got]), np.array([r.y for r in got], float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score): how likely label 1 is."""

    def make(batches):
        for ids, texts in _by_batch(batches, "doc_id", "text"):
            yield from zip(ids, probability(forest, statistics(texts)).tolist(), strict=True)

    return map_rows(_texts(docs), make, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 5).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
