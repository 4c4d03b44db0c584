"""Benchmark decontamination: passages of every document as BM25 queries over an inverted index of test items.

The index is over the items: postings of each word sorted by item, in blocks of item ids with the greatest impact of
each block. Impacts are divided by the item's score for its own text, so one threshold holds for all: a passage that
holds a whole item scores 1 on it. The longest lists are not opened at first; what they can add at most to an item is
known from the index. A passage is skipped when the greatest impacts of its other words and that bound sum to less than
the threshold, then each block of items when its block maxima do; only items of the blocks left are scored, and the
long lists are added for pairs that can still pass (block-max WAND, over all passages of a batch at once). Passages are ``length``
words every ``length`` / 2, so an item of up to half that length lies whole in one; longer items are searched for in passages of
twice the length, and so on, each by its own length only. Retrieved pairs are verified on the
document's words around the passage: the question part and the answer part (after the last question mark, or the last
quarter) must each share enough of their word 3-grams with it (n-grams of its own length for a part of one or two words).

Words are runs of letters and digits of the lower-cased text. Null or empty texts hold nothing; items without words match nothing.
Repeated rows and items each appear; a null doc_id or item_id stays null. Of passages that hold an item equally well the one with the
greatest overlaps counts. Very long texts are read whole, some 200,000 words at a time and at least a document. An empty table of
documents or items gives an empty result. Items are indexed on the driver and broadcast in shards of ``shard_words`` words at
most, with the statistics of all items, one pass over the documents for each; longer lists of items cost more passes, not more
memory: where there are several, each pass is written before the next. Further columns are ignored by the search and kept by
``drop_leaks``, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialise, row_key, rows

THRESHOLD, QUESTION, ANSWER = 0.6, 0.7, 0.6
LENGTH, BLOCK = 128, 16
#: Words between the starts of a question and an answer of one or two words each, at most.
NEXT = 8
#: Mean share of an item's score that the lists left closed at first may hold.
CLOSED = 0.3
#: Words of the items that are broadcast at once.
SHARD_WORDS = 2_000_000
K1, B = 1.2, 0.75
_WORDS = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def parts(text: str | None) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    text = text or ""
    cut = text.rfind("?") + 1
    question, answer = item_words(text[:cut]), item_words(text[cut:])
    if question and answer:
        return question, answer
    words = item_words(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def overlaps(split: tuple[list[str], list[str]], near: list[str]) -> list[float]:
    """Shares of the n-grams of the question and of the answer among the words ``near``; 1 for a part without words.

    n is 3, or the length of a shorter part. Two short parts could both stand there by chance: they must lie within NEXT words.
    """
    shared = [len(grams(x, n) & grams(near, n)) / len(grams(x, n)) if (n := min(3, len(x))) else 1.0 for x in split]
    if all(shared) and all(0 < len(x) < 3 for x in split):
        q, a = ([i for i in range(len(near)) if near[i : i + len(x)] == x] for x in split)
        if min(abs(i - j) for i in q for j in a) > NEXT:
            return [0.0, 0.0]
    return shared


class Index:
    """Postings with normalised impacts, and their maxima by block.

    ``counts``: number of items with words, their words, and the items that hold each word, where ``items`` are a shard of more.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, counts: tuple[int, int, dict[str, int]] | None = None):
        self.threshold = threshold
        kept = [(i, t) for i, t in items if item_words(t)]
        bags = [Counter(item_words(t)) for _, t in kept]
        n, df = len(bags), Counter(w for b in bags for w in b)
        self.term = {w: i for i, w in enumerate(df)}
        every, length, held_by = counts or (n, sum(sum(b.values()) for b in bags), df)
        mean = length / max(1, every)
        idf = {w: math.log(1 + (every - held_by[w] + 0.5) / (held_by[w] + 0.5)) for w in df}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for item, bag in enumerate(bags):
            size = sum(bag.values())
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)) for w, tf in bag.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                postings[self.term[w]].append((item, x / own))
        self.n, self.blocks = n, -(-n // BLOCK)
        self.starts = np.zeros(len(df) + 1, np.int64)
        ids, impacts, best = [], [], []
        blocks: list[tuple[int, int, float]] = []
        for t in range(len(df)):
            self.starts[t + 1] = self.starts[t] + len(postings[t])
            ids += [i for i, _ in postings[t]]
            impacts += [x for _, x in postings[t]]
            best.append(max(x for _, x in postings[t]))
            top: dict[int, float] = {}
            for i, x in postings[t]:
                top[i // BLOCK] = max(top.get(i // BLOCK, 0), x)
            blocks += [(t, b, x) for b, x in top.items()]
        self.ids, self.impacts = np.array(ids, np.int64), np.array(impacts)
        self.best = np.array(best)
        # the longest lists stay closed until they hold the share CLOSED of an item's score on average
        self.closed = np.zeros(len(df), bool)
        self.rest = np.zeros(self.blocks * BLOCK)
        for t in np.argsort(-np.diff(self.starts), kind="stable"):
            added = self.rest.copy()
            np.add.at(added, self.ids[self.starts[t] : self.starts[t + 1]], self.impacts[self.starts[t] : self.starts[t + 1]])
            if added.sum() > CLOSED * n or self.starts[t + 1] - self.starts[t] < 2:
                break
            if added.max() >= 0.9 * threshold:  # else an item could pass by closed lists alone
                continue
            self.closed[t], self.rest = True, added
        self.block_rest = self.rest.reshape(self.blocks, BLOCK).max(axis=1) if n else np.zeros(0)
        self.block_starts = np.searchsorted([t for t, _, _ in blocks], np.arange(len(df) + 1)) if blocks else np.zeros(1, np.int64)
        self.block_ids, self.block_best = np.array([b for _, b, _ in blocks], np.int64), np.array([x for *_, x in blocks])
        self.split = [parts(t) for _, t in kept]
        self.items = [i for i, _ in kept]

    def _sums(self, passage: np.ndarray, term: np.ndarray, starts, ids, values, width: int):
        """Sums of values by (passage, id) over the terms' lists: sorted codes passage * width + id, and sums."""
        lo, many = starts[term], starts[term + 1] - starts[term]
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        code = np.repeat(passage, many) * width + ids[at]
        code, back = np.unique(code, return_inverse=True)
        return code, np.bincount(back, weights=values[at], minlength=len(code))

    def retrieve(self, passage: np.ndarray, term: np.ndarray):
        """(passage, item, score) with scores of at least the threshold, from distinct (passage, term) pairs sorted by passage."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = self.threshold - 1e-9
        if not self.n:
            return none
        shut = self.closed[term]
        shut_passage, shut_term = passage[shut], term[shut]
        passage, term = passage[~shut], term[~shut]
        bound = np.bincount(passage, weights=self.best[term]) + self.rest.max()
        alive = bound[passage] >= least
        passage, term = passage[alive], term[alive]
        if not passage.size:
            return none
        code, bound = self._sums(passage, term, self.block_starts, self.block_ids, self.block_best, self.blocks)
        code = code[bound + self.block_rest[code % self.blocks] >= least]
        if not code.size:
            return none
        alive = np.isin(passage, code // self.blocks)
        p, item, x = self._postings(passage[alive], term[alive])
        inside = np.isin(p * self.blocks + item // BLOCK, code)
        pair, back = np.unique(p[inside] * self.n + item[inside], return_inverse=True)
        score = np.bincount(back, weights=x[inside], minlength=len(pair))
        near = score + self.rest[pair % self.n] >= least
        pair, score = pair[near], score[near]
        alive = np.isin(shut_passage, pair // self.n)
        p, item, x = self._postings(shut_passage[alive], shut_term[alive])
        code = p * self.n + item
        at = np.minimum(np.searchsorted(pair, code), max(0, len(pair) - 1))
        hit = pair[at] == code if len(pair) else np.zeros(len(code), bool)
        np.add.at(score, at[hit], x[hit])
        keep = score >= least
        return pair[keep] // self.n, pair[keep] % self.n, score[keep]

    def _postings(self, passage: np.ndarray, term: np.ndarray):
        """(passage, item, impact) of all postings of the terms."""
        lo, many = self.starts[term], self.starts[term + 1] - self.starts[term]
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(passage, many), self.ids[at], self.impacts[at]


def item_counts(items: DataFrame) -> tuple[int, int, Counter]:
    """Number of items with words, their words, and the items that hold each word; read one by one."""
    n = length = 0
    df: Counter = Counter()
    for r in items.select("text").toLocalIterator():
        words = item_words(r.text)
        n, length = n + bool(words), length + len(words)
        df.update(set(words))
    return n, length, df


def passage_length(n_words: int, length: int) -> int:
    """Words of the passages that an item of ``n_words`` words is searched for in."""
    while n_words > length // 2:
        length *= 2
    return length


def shards(items: DataFrame, shard_words: int, length: int):
    """(passage length, items) with ``shard_words`` words at most, read one by one."""
    held: dict[int, list] = defaultdict(list)
    size: Counter = Counter()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        n = len(item_words(r.text))
        if not n:
            continue
        own = passage_length(n, length)
        if held[own] and size[own] + n > shard_words:
            yield own, held.pop(own)
            size[own] = 0
        held[own].append((r.item_id, r.text))
        size[own] += n
    yield from sorted(held.items())


def search(index: Index, group: list[tuple], size: int, question: float, answer: float):
    """Verified pairs of the documents ``group`` of (id, words), in passages of ``size`` words."""
    half, get, terms = size // 2, index.term.get, max(1, len(index.term))
    ids, lens = [], []
    for _, words in group:
        ids += [get(w, -1) for w in words]
        lens.append(len(words))
    ids, lens = np.array(ids, np.int64), np.array(lens, np.int64)
    doc = np.repeat(np.arange(len(group)), lens)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
    known = ids >= 0
    ids, doc, half_no = ids[known], doc[known], place[known] // half
    # passage m of a document holds its halves m and m + 1
    most = int(half_no.max(initial=0)) + 2
    code = np.unique(np.r_[(doc * most + half_no) * terms + ids, (doc * most + np.maximum(half_no - 1, 0)) * terms + ids])
    numbers, passage = np.unique(code // terms, return_inverse=True)
    if not numbers.size:
        return
    p, item, score = index.retrieve(passage, code % terms)
    best: dict[tuple[int, int], tuple] = {}
    for p, item, s in zip(p.tolist(), item.tolist(), score.tolist(), strict=True):
        d, m = divmod(int(numbers[p]), most)
        shared = overlaps(index.split[item], group[d][1][max(0, m * half - half) : m * half + size + half])
        if shared[0] >= question and shared[1] >= answer:
            best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (s, *shared))
    for (d, item), got in best.items():
        yield group[d][0], index.items[item], *got


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, length: int = LENGTH, shard_words: int = SHARD_WORDS, id_type: str = "long") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row for each verified pair, doc_id as ``id_type``."""
    spark = docs.sparkSession
    counts = item_counts(items)
    kind = f"doc_id {id_type}, item_id long, score double, question_overlap double, answer_overlap double"

    def one(size: int, held: list) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(Index(held, threshold, counts))

        def make(batches):
            index = sent.value
            group, words = [], 0
            for doc_id, text in rows(batches, "doc_id", "text"):
                if text:
                    group.append((doc_id, item_words(text)))
                    words += len(group[-1][1])
                if words > 200_000:
                    yield from search(index, group, size, question, answer)
                    group, words = [], 0
            if group:
                yield from search(index, group, size, question, answer)

        return map_rows(docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text"), make, kind), sent

    found = None
    every = shards(items, shard_words, length)
    now = next(every, None)
    while now is not None:
        part, sent = one(*now)
        now = next(every, None)
        if now is None and found is None:  # a single pass need not be written
            return part
        part = materialise(part, "leaks")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], kind) if found is None else found


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id are judged by their text."""
    key = f"key-{uuid.uuid4().hex}"  # no table has such a column
    marked = docs.withColumn(key, row_key())
    bad = find_leaks(marked.select(F.col(f"`{key}`").alias("doc_id"), "text"), items, id_type="binary").select(F.col("doc_id").alias(key)).distinct()
    return marked.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return find_leaks(docs, items)
