"""Toxicity: Levenshtein automata intersected with a lexicon's trie, and context windows around what they match.

The lexicon is learnt from labelled training rows: words and word beginnings (four to six letters, for inflected forms)
that toxic rows hold far more often than chance explains. Each entry's Levenshtein automaton (one edit for entries
of at least ``fuzzy_from`` letters) runs along the trie of all entries; the product is made deterministic step by step
as words are read and its states are shared by all words, so most words die after a few letters.

A match counts by its context window of ``window`` words on each side: inside quotation marks, or near a word of
reporting, it is a quotation; otherwise abuse. A logistic model weighs exact, inflected and misspelled matches of both sorts, each as
log(1 + number), and their share of the text.

Null or empty text: no match, and so the score of a text without one. Null doc_id: a training row that no label joins.
Repeated rows each get a row. Without labels of both kinds the score is the share of toxic labels. Entries of equal strength are
taken in the order of their letters, words before beginnings. Very long texts are read whole, in linear time. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_rows, rows

#: Labelled rows that the lexicon and the model are fitted on at most: those with the least hash of their id.
SAMPLE = 20_000
#: Entries of a lexicon at most, strongest first; the model's driver-side input is bounded by SAMPLE.
ENTRIES = 2_000
WINDOW, FUZZY_FROM = 8, 5
REPORTING = frozenset("said says wrote called quote quoted quoting reported according term word slur insult".split())
_TOKEN = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”«»„"


class Matcher:
    """The product of the lexicon's trie and its Levenshtein automata, determinised as it is used."""

    def __init__(self, words: set[str], stems: set[str], fuzzy_from: int = FUZZY_FROM):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem = [False], [False]
        self.longest = [0]  # of the entries below a node
        for kind, entries in ((self.word, words), (self.stem, stems)):
            for e in sorted(entries):
                node = 0
                self.longest[0] = max(self.longest[0], len(e))
                for c in e:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.word.append(False)
                        self.stem.append(False)
                        self.longest.append(0)
                    node = self.children[node][c]
                    self.longest[node] = max(self.longest[node], len(e))
                kind[node] = True
        self.depth = [0] * len(self.children)
        for node, below in enumerate(self.children):
            for child in below.values():
                self.depth[child] = self.depth[node] + 1
        self.fuzzy_from = fuzzy_from
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.stems: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs) -> int:
        """Number of the state: (node, edits) pairs, with the letters that may be left out."""
        full = set(pairs)
        for node, edits in pairs:
            if edits == 0:
                full |= {(child, 1) for child in self.children[node].values() if self.longest[child] >= self.fuzzy_from}
        full = frozenset((n, e) for n, e in full if not (e and (n, 0) in full))
        if full not in self.states:
            self.states[full] = len(self.sets)
            self.sets.append(full)
            self.steps.append({})
            near = [e for n, e in full if self.word[n] and (e == 0 or self.depth[n] >= self.fuzzy_from)]
            self.ends.append(0 if not near else 1 if 0 in near else 3)
            self.stems.append(2 if any(self.stem[n] and e == 0 for n, e in full) else 0)
        return self.states[full]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if (child := self.children[node].get(c)) is not None:
                out.add((child, edits))
            if edits == 0 and self.longest[node] >= self.fuzzy_from:
                out.add((node, 1))  # a letter too many
                out |= {(child, 1) for child in self.children[node].values() if self.longest[child] >= self.fuzzy_from}
        self.steps[state][c] = nxt = self._state(out) if out else -1
        return nxt

    def match(self, word: str) -> int:
        """1: an entry; 2: begins with a stem; 3: one edit from an entry; 0: none."""
        state, found = self.start, 0
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return found
            found = found or self.stems[state]
        return 1 if self.ends[state] == 1 else found or self.ends[state]


N_FEATURES = 7


def features(text: str | None, matcher: Matcher, cache: dict[str, int], window: int = WINDOW) -> list[float]:
    text = (text or "").lower()
    tokens = _TOKEN.findall(text)
    kinds, get = [], cache.get
    for i, w in enumerate(tokens):
        k = get(w)
        if k is None:
            k = matcher.match(w)
            if len(cache) < 200_000:
                cache[w] = k
        if k:
            kinds.append((i, k))
    counts = [0] * 6
    if kinds:
        spans = [m.span() for m in _TOKEN.finditer(text)] if any(q in text for q in _QUOTES) else None
        for i, k in kinds:
            near = tokens[max(0, i - window) : i + window + 1]
            quoted = not REPORTING.isdisjoint(near)
            if spans and not quoted:
                s, e = spans[i]
                left, right = text[spans[max(0, i - window)][0] : s], text[e : spans[min(len(spans) - 1, i + window)][1]]
                quoted = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES)
            counts[k - 1 + 3 * quoted] += 1
    abuse = counts[0] + counts[1] + counts[2]
    return [math.log1p(c) for c in counts] + [abuse / len(tokens) if tokens else 0.0]


def learn_lexicon(rows_: DataFrame, share: float, n_rows: int) -> tuple[set[str], set[str]]:
    """Words and stems from ``rows_(text, toxic)``, whose toxic share is ``share``."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\P{L}]+"), lambda w: F.length(w) >= 3))
    # near copies would lend their common words false weight: one row for each least hash of the longer words
    near = F.coalesce(F.array_min(F.transform(F.filter(words, lambda w: F.length(w) >= 8), lambda w: F.xxhash64(w))), F.xxhash64("text"))
    marked = rows_.select("toxic", words.alias("w"), near.alias("near")).dropDuplicates(["toxic", "near"])

    def stems_of(n: int):
        cut = F.transform(F.filter("w", lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))
        return F.transform(F.array_distinct(cut), lambda t: F.struct(F.lit(True).alias("stem"), t.alias("t")))

    forms = F.concat(F.transform("w", lambda w: F.struct(F.lit(False).alias("stem"), w.alias("t"))), stems_of(4), stems_of(5), stems_of(6))
    counted = marked.select("toxic", F.explode(forms).alias("f")).groupBy("f.stem", "f.t").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    # if toxic rows were dealt by chance, a of n with this share has a probability below share ** a times n over a; ask for less than one in all terms
    need = max(3, math.ceil(math.log(max(100, 50 * n_rows)) / -math.log(max(share, 1e-6)))) if share < 0.5 else 8
    strong = counted.where((F.col("a") >= need) & (F.col("a") >= 0.9 * F.col("n"))).orderBy(F.desc("a"), "t", "stem").limit(ENTRIES).collect()
    words = {r.t for r in strong if not r.stem}
    stems: set[str] = set()
    for r in sorted((r for r in strong if r.stem), key=lambda r: len(r.t)):
        # a stem must explain more than its single words do, and the shortest beginning speaks for longer ones
        own = max([x.a for x in strong if not x.stem and x.t.startswith(r.t)], default=0)
        if r.a >= own + need / 2 and not any(r.t.startswith(s) for s in stems):
            stems.add(r.t)
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(matcher's entries, weights with the intercept last, mean, scale) from training rows only."""
    train = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~in_fold("doc_id", 5))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()
    try:
        n, k = joined.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < k < n:
            return (set(), set()), np.r_[np.zeros(N_FEATURES), math.log((k + 0.5) / (n - k + 0.5))], 0.0, 1.0
        entries = learn_lexicon(joined, k / n, n)

        def make(batches):
            matcher, cache = Matcher(*entries), {}
            for text, toxic in rows(batches, "text", "toxic"):
                yield features(text, matcher, cache), toxic

        got = map_rows(joined, make, "x array<double>, toxic int").collect()
    finally:
        joined.unpersist()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(N_FEATURES, 1.0), 1e-6]
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return entries, w, mean, scale


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keys: tuple[str, ...] = ("doc_id",), training: DataFrame | None = None) -> DataFrame:
    """(key, score, predicted) of each row, ``key`` a struct of the columns ``keys``; fitted on ``training``, or on ``docs`` itself."""
    entries, w, mean, scale = fit(docs if training is None else training, labels, sample)

    def make(batches):
        matcher, cache = Matcher(*entries), {}
        for key, *rest in rows(batches, "key") if own else rows(batches, "key", "text"):
            text = key["text"] if own else rest[0]
            z = float(((np.array(features(text, matcher, cache)) - mean) / scale) @ w[:-1] + w[-1])
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            yield key, p, int(p >= 0.5)

    own = "text" in keys  # else the text would travel twice
    kinds = ", ".join(f"`{k}`: {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(docs.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("key"), *([] if own else ["text"])), make, f"key struct<{kinds}>, score double, predicted int", 512 if own else 4096)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    return score(docs, labels, keys=tuple(docs.columns)).where("predicted = 0").select("key.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return scored.select("key.doc_id", in_fold("key.doc_id", 5).alias("held_out"), "score", "predicted")
