"""Marginal probability of a document under a subword lattice, next to an additive word model.

An existing subword vocabulary (a sentencepiece file, its path a parameter) gives the pieces and their scores. A word's
lattice holds all its segmentations into pieces, the first after a word mark; single bytes stand in where no piece fits. Under the
unigram model a document's probability is the product of its pieces' probabilities, summed over all segmentations: a forward
recursion in log space gives the sum. Pieces do not cross words, so it is the product over the words, and of the end of the text.

A unigram file's scores are log probabilities. A BPE file's are negative ranks: they start as Zipf's law of the rank. Expectation
maximisation then fits them to the training documents: ``rounds`` times the expected number of each piece over all
segmentations of all training words, by forward and backward recursions, plus the file's scores as a prior of a tenth of an
occurrence a piece. The vocabulary bounds what reaches the driver; the counts of words, all of them, stay distributed.

Lattices of many words are summed together: arcs from a trie walked by arrays, recursions step by step over places in the word.
Each document needs the counts and lattices of its own words: the ``common`` most frequent words (a bound on what is
broadcast) are looked up in the tasks, which also takes the hottest keys out of the shuffle; all other words are joined by key.

Null or empty text: no words, only its end. Null doc_id: a training document. Repeated rows each count and each get a
row. Very long words have very long lattices, summed one by one in linear time and memory. Words equally frequent: all or none of a
count's cell are broadcast, with the same result. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_rows, materialise, rows

#: Words that every task holds, and words that a task counts before it hands them on.
COMMON, FLUSH = 150_000, 400_000
#: Rounds of expectation maximisation, and occurrences of a piece that the vocabulary's scores stand for, on average.
ROUNDS, PRIOR = 2, 0.1
#: Words with more code points are summed alone.
LONG = 64
START = "▁"


class Lattice:
    """log P of words by log probabilities of pieces and of the 256 bytes."""

    def __init__(self, pieces: dict[str, float], byte: list[float]):
        self.names = list(pieces)
        self.weight, self.byte = np.array([pieces[p] for p in self.names], float), np.array(byte, float)
        # the trie as sorted keys (node, code point): the nodes they lead to, and the piece that ends at each node
        steps: dict[int, int] = {}
        ends = [-1]
        for i, name in enumerate(self.names):
            node = 0
            for c in name:
                key = node << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                node = steps[key]
            if name:
                ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.key = np.array(sorted(steps), np.int64)
        self.node = np.array([steps[k] for k in self.key.tolist()], np.int64)

    def arcs(self, words: list[str]):
        """All arcs of the words' lattices: from, to (nodes of all words in one row), piece or -1, weight; and each node's word and place."""
        marked = [START + w for w in words]
        text = "".join(marked)
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(m) for m in marked], np.int64)
        first = np.cumsum(size + 1) - size - 1  # a word of n code points has n + 1 nodes
        word = np.repeat(np.arange(len(words)), size)
        node_of = np.arange(len(c)) + word  # the node before each code point
        left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # code points up to the end of the word
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        begins = np.flatnonzero((raw & 0xC0) != 0x80)
        source, target, piece, weight = [node_of], [node_of + 1], [np.full(len(c), -1)], [np.add.reduceat(self.byte[raw], begins) if len(raw) else np.zeros(0)]
        at, state, n = np.arange(len(c)), np.zeros(len(c), np.int64), 0
        while at.size and self.key.size:
            key = state << 21 | c[at + n]
            slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            alive = self.key[slot] == key
            at, state, n = at[alive], self.node[slot[alive]], n + 1
            done = self.ends[state]
            hit = done >= 0
            source.append(node_of[at[hit]])
            target.append(node_of[at[hit]] + n)
            piece.append(done[hit])
            weight.append(self.weight[done[hit]])
            more = left[at] > n
            at, state = at[more], state[more]
        return np.concatenate(source), np.concatenate(target), np.concatenate(piece), np.concatenate(weight), first, size, (raw, begins)

    @staticmethod
    def _sums(source, target, weight, first, size, backward: bool = False):
        """Log sums of all paths from a word's first node to each node, or from each node to the last."""
        nodes = int((size + 1).sum())
        place = np.arange(nodes) - np.repeat(first, size + 1)
        out = np.full(nodes, -np.inf)
        if backward:
            source, target = target, source
            place = np.repeat(size, size + 1) - place
        out[place == 0] = 0.0
        order = np.argsort(place[target] * nodes + target)
        source, target, weight = source[order], target[order], weight[order]
        cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if target.size else np.zeros(0, np.int64)
        level = np.searchsorted(place[target[cut]], np.arange(1, int(size.max(initial=0)) + 2)) if cut.size else np.zeros(1, np.int64)
        bounds = np.r_[cut, len(target)]
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if a == b:
                continue
            lo, hi = bounds[a], bounds[b]
            x = out[source[lo:hi]] + weight[lo:hi]
            begin = cut[a:b] - lo
            top = np.maximum.reduceat(x, begin)
            out[target[cut[a:b]]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(bounds[a : b + 1]))), begin))
        return out

    def log_p(self, words: list[str]) -> np.ndarray:
        """Natural logarithms of the sums over all segmentations of each word."""
        source, target, _, weight, first, size, _ = self.arcs(words)
        return self._sums(source, target, weight, first, size)[first + size]

    def expect(self, words: list[str], times: list[int], pieces: np.ndarray, byte: np.ndarray) -> None:
        """Add the expected numbers of pieces and bytes in all segmentations, each word ``times`` over."""
        source, target, piece, weight, first, size, (raw, begins) = self.arcs(words)
        forward, back = self._sums(source, target, weight, first, size), self._sums(source, target, weight, first, size, True)
        whole = np.repeat(forward[first + size], size + 1)
        times = np.repeat(np.array(times, float), size + 1)
        mass = np.exp(forward[source] + weight + back[target] - whole[source]) * times[source]
        own = piece >= 0
        pieces += np.bincount(piece[own], weights=mass[own], minlength=len(pieces))
        byte += np.bincount(raw, weights=np.repeat(mass[~own], np.diff(np.r_[begins, len(raw)])), minlength=256)


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, c_all): times in training documents and in all, from ``docs(text, held_out)``."""

    def make(batches):
        train, held = Counter(), Counter()

        def flush():
            for w in train.keys() | held.keys():
                yield w, train[w], train[w] + held[w]
            train.clear()
            held.clear()

        for text, out in rows(batches, "text", "held_out"):
            (held if out else train).update(fold_words(text))
            if len(train) + len(held) > FLUSH:
                yield from flush()
        yield from flush()

    parts = map_rows(docs.select("text", "held_out"), make, "word binary, c long, c_all long", 16384)
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def together(counted):
    """Lists of rows whose first column, a word in UTF-8, is decoded: many short words at once, long ones by themselves."""
    short: list[tuple] = []
    for word, *more in counted:
        word = word.decode("utf-8", "replace")
        if len(word) > LONG:
            yield [(word, *more)]
            continue
        short.append((word, *more))
        if len(short) >= 4096:
            yield short
            short = []
    if short:
        yield short


def known_scores(vocabulary: str) -> tuple[dict[str, float], list[float]]:
    """Log probabilities of the file's pieces and bytes by its scores."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    usual = [i for i in range(known.get_piece_size()) if not (known.is_byte(i) or known.is_control(i) or known.is_unknown(i) or known.is_unused(i)) and known.get_score(i) > -1e8]
    scores = [known.get_score(i) for i in usual]
    if scores and scores == sorted(scores, reverse=True) and all(x == round(x) for x in scores):  # ranks
        scores = [-math.log(2 - x) for x in scores]
    # bytes are as likely as the least piece, all together
    least = min(scores, default=0.0)
    total = math.log(sum(map(math.exp, scores)) + math.exp(least))
    return {known.id_to_piece(i): x - total for i, x in zip(usual, scores, strict=True)}, [least - total - math.log(256)] * 256


def train_lattice(counts: DataFrame, vocabulary: str, ends: int, rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """Log probabilities of the vocabulary's pieces after expectation maximisation over ``counts(word, c)``, and of a text's end."""
    spark = counts.sparkSession
    pieces, byte = known_scores(vocabulary)
    names = list(pieces)
    prior = np.exp(np.r_[list(pieces.values()), byte])
    prior *= PRIOR * len(prior) / prior.sum()
    train, now, stop = counts.where("c > 0").select("word", "c"), Lattice(pieces, byte), math.log(PRIOR / (PRIOR + prior.sum()))
    for _ in range(rounds):
        lattice = spark.sparkContext.broadcast(now)

        def make(batches, lattice=lattice):
            model = lattice.value
            total, of_bytes = np.zeros(len(model.names)), np.zeros(256)
            for held in together(rows(batches, "word", "c", size=4096)):
                model.expect([w for w, *_ in held], [c for _, c in held], total, of_bytes)
            every = np.r_[total, of_bytes]
            hit = np.flatnonzero(every)
            yield from zip(hit.tolist(), every[hit].tolist(), strict=True)

        # one row for each piece at most
        got = map_rows(train, make, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        mass = prior.copy()
        for r in got:
            mass[r.piece] += r.n
        total = mass.sum() + ends + PRIOR
        logs = np.log(mass / total)
        now, stop = Lattice(dict(zip(names, logs[: len(names)].tolist(), strict=True)), logs[len(names) :].tolist()), math.log((ends + PRIOR) / total)
    return now, stop


def score(docs: DataFrame, vocabulary: str, modulus: int = 10, common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), all logarithms to base 10."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", in_fold("doc_id", modulus).alias("held_out"))
    counts = materialise(count_words(marked), "counts")
    got = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = marked.where("NOT held_out").count()
    n, v = (got["n"] or 0) + ends, got["v"] + (ends > 0)
    model, stop = train_lattice(counts, vocabulary, ends, rounds)
    lattice = spark.sparkContext.broadcast(model)

    def weigh(batches):
        for held in together(rows(batches, "word", "c", "c_all", size=4096)):
            for (word, *counted), x in zip(held, lattice.value.log_p([w for w, *_ in held]).tolist(), strict=True):
                yield word.encode(), *counted, x / math.log(10)

    weighed = materialise(map_rows(counts, weigh, "word binary, c long, c_all long, p double", 16384), "weighed")
    # a bounded number of words, those that occur most
    # by a histogram of counts, an eighth of a doubling to a cell: no task sorts or gathers the words
    cell = F.floor(8 * F.log2("c_all")).cast("int")
    room, least = common, 1 << 30
    for r in sorted(weighed.groupBy(cell.alias("cell")).count().collect(), key=lambda r: -r.cell):
        room -= r["count"]
        if room < 0:
            break
        least = r.cell
    top = {bytes(r.word): (r.c, r.p) for r in weighed.where(cell >= least).select("word", "c", "p").toLocalIterator()}
    table = spark.sparkContext.broadcast(top)
    below = 0.1 * (v + 1) + n
    base = lambda c: math.log10((c + 0.1) / below)
    end_base, end_p = base(ends), stop / math.log(10)

    def look_up(batches):
        known_words = {w: (c > 0, base(c), p) for w, (c, p) in table.value.items()}
        get = known_words.get
        for row, (doc_id, text, held) in enumerate(rows(batches, "doc_id", "text", "held_out")):
            words = fold_words(text)
            n_known, b, s = int(ends > 0), end_base, end_p
            rare = []
            for w, tf in Counter(words).items():
                got = get(w)
                if got is None:
                    rare.append((w, tf))
                else:
                    if got[0]:
                        n_known += tf
                    b += tf * got[1]
                    s += tf * got[2]
            yield doc_id, held, row, None, 0, len(words) + 1, n_known, b, s
            for w, tf in rare:
                yield doc_id, held, row, w, tf, 0, 0, 0.0, 0.0

    parts = map_rows(marked, look_up, "doc_id long, held_out boolean, row long, word binary, tf long, n_tokens long, n_known long, b double, s double", 16384)
    parts = parts.withColumn("task", F.spark_partition_id())
    joined = parts.join(weighed.select("word", "c", "p"), "word", "left")
    known = F.coalesce(F.when(F.col("c") > 0, F.col("tf")), F.lit(0))
    out = joined.groupBy("doc_id", "held_out", "task", "row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(known)).alias("n_known"),
        (F.sum("b") + F.sum(F.when(F.col("word").isNotNull(), F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(below))).otherwise(0.0))).alias("base_score"),
        (F.sum("s") + F.sum(F.coalesce(F.col("tf") * F.col("p"), F.lit(0.0)))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return score(docs, vocabulary)
