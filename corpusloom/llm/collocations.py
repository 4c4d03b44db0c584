"""Phrase collocations: phrases whose words stand together more often than their parts explain.

Words that occur ``least`` times or more in their language are numbered, most frequent first; every other word breaks its piece, as no phrase
with it can be frequent. What remains is one key for each place where two numbered words meet: the numbers of the up to ``longest`` words from
there, each in as many bytes as the dictionary needs. A task sorts its keys by radix and counts runs of equal ones, so what travels is
distinct keys; they are dealt by ranges of keys (bounds from a sample of the documents), sorted again, and their counts added up. In sorted keys
all phrases of two to ``longest`` words are runs of equal beginnings; a run at the edge of a range is added to its neighbours' afterwards.

The dictionary is broadcast up to ``HEAD`` words of 32 bytes at most (longer ones by a 128-bit hash). Rarer numbered words beyond these are joined
by shuffle, occurrence by occurrence, so the result is the same for any ``HEAD``. At most ``RANGES`` bounds are broadcast. A frequent word, pair or phrase is one
key with its count in each task's run, so no task gets its occurrences.

Null or empty text: no words. Null language: ``und``. Null ids and repeated rows count as documents of their own. Very long texts are read whole, in slices that end between words. Ties: the
smallest cut, then the phrase's bytes. An empty table, or one without frequent phrases, gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, numbered, rows

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of the dictionary that every task holds.
HEAD = 500_000
#: Keys that a task sorts at once, keys of a range (a few times more may come), and ranges; the bounds of the ranges come from one of SAMPLE documents.
BLOCK, RANGE, RANGES, SAMPLE = 250_000, 500_000, 200_000, 16
_PLAIN = 32
_SLICE = 1 << 20
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"." * 10 + b" ")


def slices(text: bytes):
    """Lists of a text's words, A to Z in lower case, with ``b"."`` where a piece ends (no word holds one)."""
    text, start = text.lower().translate(_BREAKS), 0
    while start < len(text):
        stop = text.find(b" ", start + _SLICE)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].replace(b".", b" . ").split()
        start = stop


def _short(word: bytes) -> bytes:
    """What stands for a word: itself, or 128 bits of a long one after 17 bytes that no word has."""
    from hashlib import blake2b

    return word if len(word) <= _PLAIN else b" " * 17 + blake2b(word, digest_size=16).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, c): how often a language has a word."""

    def make(batches):
        from collections import Counter

        held: dict[str, Counter] = {}
        size = 0
        for lang, text in rows(batches, "lang", "text"):
            counts = held.setdefault(lang, Counter())
            before = len(counts)
            for words in slices(text):
                counts.update(words)
            size += len(counts) - before
            if size > 400_000:
                yield from ((lang, w.decode(), c) for lang, counts in held.items() for w, c in counts.items() if w != b".")
                held, size = {}, 0
        yield from ((lang, w.decode(), c) for lang, counts in held.items() for w, c in counts.items() if w != b".")

    return map_rows(_texts(docs), make, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def dictionary(docs: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, c, n) of the frequent words, ``id`` from 1 by falling count; ``n`` counts all words of the language."""
    counted = materialise(count_words(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("c").alias("n"))
    kept = materialise(counted.where(F.col("c") >= least).select(F.lit("").alias("all"), (-F.col("c")).alias("falling"), "lang", "word", "c"), "frequent")
    ids = numbered(kept, "all", ["falling", "lang", "word"], "numbered").select((F.col("idx") + 1).alias("id"), "lang", "word", "c")
    return materialise(ids.join(totals, "lang").select("id", "lang", "word", "c", "n"), "dictionary")


def encode(docs: DataFrame, words: DataFrame, head: int = HEAD):
    """Each document's words as 32-bit numbers, 0 for what breaks a phrase: a table, and what makes arrays of numbers from its batches."""
    n_words = words.count()
    known: dict[str, dict[bytes, int]] = {}
    wire = F.when(F.octet_length("word") <= _PLAIN, F.col("word").cast("binary"))
    for r in words.where(F.col("id") <= head).select("id", "lang", wire.alias("w"), F.when(wire.isNull(), F.col("word")).alias("long")).toLocalIterator():
        known.setdefault(r.lang, {})[bytes(r.w) if r.w is not None else _short(r.long.encode())] = r.id
    shared = docs.sparkSession.sparkContext.broadcast(known)
    more = n_words > head

    def make(batches):
        has_long = {lang: any(len(w) > _PLAIN for w in d) for lang, d in shared.value.items()}
        for lang, text in rows(batches, "lang", "text"):
            get, parts, open_at, at = shared.value.get(lang, {}).get, [], [], 0
            for ws in slices(text):
                if has_long.get(lang) or more:
                    ws = [_short(w) for w in ws]
                ids = np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws))
                if more:
                    open_at += [(at + int(i), ws[i]) for i in np.flatnonzero(ids == 0) if ws[i] != b"."]
                at += len(ids)
                parts.append(ids)
            yield np.concatenate(parts) if parts else np.zeros(0, np.int32), lang, open_at

    if not more:
        return _texts(docs), lambda batches: (ids for ids, *_ in make(batches))

    def keep(batches):
        return ((ids.astype("<i4").tobytes(), *rest) for ids, *rest in make(batches))

    first = materialise(map_rows(_texts(docs), keep, "ids binary, lang string, open array<struct<at: int, w: binary>>", 64).withColumn("row", F.monotonically_increasing_id()), "coded")

    def name(batches):
        for i, lang, word in rows(batches, "id", "lang", "word"):
            yield i, lang, _short(word.encode())

    rest = map_rows(words.where(F.col("id") > head).select("id", "lang", "word"), name, "id long, lang string, w binary")
    found = first.select("row", "lang", F.explode("open").alias("o")).select("row", "lang", "o.at", "o.w").join(rest, ["lang", "w"]).groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("found"))

    def fill(batches):
        for ids, late in rows(batches, "ids", "found", size=64):
            ids = np.frombuffer(ids, "<i4").copy()
            if late:
                ids[[f["at"] for f in late]] = [f["id"] for f in late]
            yield ids

    return first.select("row", "ids").join(found, "row", "left").select("found", "ids"), fill


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of word numbers as 16-bit digits, most significant first: one digit sequence for each row."""
    n, words = ids.shape
    raw = np.zeros((n, -(-words * width // 2) * 2), np.uint8)
    raw[:, : words * width] = ids.astype(">u4").view(np.uint8).reshape(n, words, 4)[:, :, 4 - width :].reshape(n, -1)
    return np.ascontiguousarray(raw.view(">u2").astype(np.uint16).T)


def unpack(digits: np.ndarray, width: int, words: int) -> np.ndarray:
    raw = np.ascontiguousarray(digits.T).astype(">u2").view(np.uint8).reshape(digits.shape[1], -1)
    wide = np.zeros((len(raw), words, 4), np.uint8)
    wide[:, :, 4 - width :] = raw[:, : words * width].reshape(len(raw), words, width)
    return wide.reshape(len(raw), -1).view(">u4").astype(np.int32)


def radix_order(digits: np.ndarray) -> np.ndarray:
    """Order of the columns of ``digits``, by stable passes over its rows from the last to the first."""
    order = np.arange(digits.shape[1])
    for digit in digits[::-1]:
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(digits: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = radix_order(digits)
    digits = digits[:, order]
    fresh = np.ones(digits.shape[1], bool)
    fresh[1:] = (digits[:, 1:] != digits[:, :-1]).any(axis=0)
    starts = np.flatnonzero(fresh)
    if counts is None:
        return digits[:, starts], np.diff(np.r_[starts, len(order)])
    return digits[:, starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def _keys(a: np.ndarray, longest: int) -> np.ndarray:
    """The words from every place that begins with two numbered ones, 0 from the first break on; ``a`` ends in ``longest - 1`` words that begin none."""
    n = len(a) - longest + 1
    starts = np.flatnonzero((a[:n] > 0) & (a[1 : n + 1] > 0))
    out = np.zeros((len(starts), longest), np.int32)
    live = np.ones(len(starts), bool)
    for j in range(longest):
        out[:, j] = np.where(live, a[starts + j], 0)
        live &= out[:, j] > 0
    return out


def sorted_runs(arrays, width: int, longest: int, block: int = BLOCK):
    """Sorted distinct keys, digit by digit, and their counts, of a few documents at a time."""

    def run(parts):
        return run_lengths(pack(np.concatenate(parts), width), None)

    held, size = [], 0
    for ids in arrays:
        for start in range(0, len(ids), block):
            want = min(block, len(ids) - start) + longest - 1  # keys that begin in the block may end behind it
            part = ids[start : start + want]
            keys = _keys(np.r_[part, np.zeros(want - len(part), np.int32)], longest)
            if len(keys):
                held.append(keys)
                size += len(keys)
            if size >= block:
                yield run(held)
                held, size = [], 0
    if held:
        yield run(held)


def _as_text(digits: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort alike."""
    return np.ascontiguousarray(digits.T).astype(">u2").view(f"S{2 * digits.shape[0]}").ravel()


def count_phrases(coded: DataFrame, arrays, n_words: int, n_keys: int, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, per_range: int = RANGE) -> DataFrame:
    """(phrase, f): the numbers of two to ``longest`` words that occur together ``f`` times, ``least`` or more; there are ``n_keys`` keys at most."""
    width = max(2, (max(1, n_words).bit_length() + 7) // 8)
    n_digits = -(-longest * width // 2)
    ranges = int(min(RANGES, max(1, n_keys // per_range)))
    step = max(1, n_keys // SAMPLE // (64 * ranges))

    def sample(batches):
        for digits, _ in sorted_runs(arrays(batches), width, longest, block):
            for key in _as_text(digits[:, int(digits.sum()) % step :: step]):
                yield (key.ljust(2 * n_digits, b"\0"),)

    bounds = np.zeros(0, f"S{2 * n_digits}")
    if ranges > 1:  # bounds only decide where a key is counted
        some = coded.where(F.pmod(F.xxhash64(coded.columns[-1]), F.lit(SAMPLE)) == 0)
        seen = np.sort(np.array([bytes(r.key) for r in map_rows(some, sample, "key binary").collect()], f"S{2 * n_digits}"))
        bounds = np.unique(seen[(np.arange(1, ranges) * len(seen)) // ranges]) if len(seen) else bounds

    def deal(batches):
        for digits, counts in sorted_runs(arrays(batches), width, longest, block):
            edges = np.r_[0, np.searchsorted(_as_text(digits), bounds, side="left"), len(counts)]
            digits, counts = digits.astype("<u2"), counts.astype("<u4")
            for i in np.flatnonzero(np.diff(edges)):
                part = slice(edges[i], edges[i + 1])
                yield int(i), digits[:, part].tobytes(), counts[part].tobytes()

    names = [f"w{j + 1}" for j in range(longest)]

    def merge(table):
        import pyarrow as pa

        digits = np.concatenate([np.frombuffer(k, "<u2").reshape(n_digits, -1) for k in table.column("keys").to_pylist()], axis=1)
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()]).astype(np.int64)
        digits, counts = run_lengths(digits, counts)
        ids = unpack(digits, width, longest)
        fresh, found, sums = np.zeros(len(ids), bool), [], []
        fresh[0] = True
        fresh[1:] |= ids[1:, 0] != ids[:-1, 0]
        for m in range(2, longest + 1):
            fresh[1:] |= ids[1:, m - 1] != ids[:-1, m - 1]
            starts = np.flatnonzero(fresh)
            f = np.add.reduceat(counts, starts)
            # the first and the last run may go on in the ranges beside this one
            keep = (f >= least) | (starts == 0) | (starts == starts[-1])
            keep &= ids[starts, m - 1] > 0
            phrase = ids[starts[keep]]
            phrase[:, m:] = 0
            found.append(phrase)
            sums.append(f[keep])
        found, sums = np.concatenate(found), np.concatenate(sums)
        return pa.table({**{c: found[:, j].astype(np.int64) for j, c in enumerate(names)}, "f": sums})

    dealt = map_rows(coded, deal, "range int, keys binary, counts binary", 16)
    parts = dealt.groupBy("range").applyInArrow(merge, ", ".join(f"{c} long" for c in names) + ", f long")
    whole = parts.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return whole.select(F.filter(F.array(*names), lambda w: w > 0).alias("phrase"), "f")


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), exact while 1000 a n has at most 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(38, 0))"
    return F.expr(f"CAST(({wide('1000')} * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)}) AS BIGINT)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, head: int = HEAD, block: int = BLOCK, per_range: int = RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases whose words are in no longer phrase as often."""
    words = dictionary(docs, least)
    size = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    counted = materialise(count_phrases(*encode(docs, words, head), *size, least, longest, block, per_range), "phrases")
    m = F.size("phrase")
    # what a phrase is part of: a longer one that occurs as often implies one longer by a word that does
    shorter = [counted.where(m > 2).select(F.slice("phrase", at, m - 1).alias("phrase"), F.col("f").alias("longer")) for at in (1, 2)]
    longer = shorter[0].unionByName(shorter[1]).groupBy("phrase").agg(F.max("longer").alias("longer"))
    kept = counted.join(longer, "phrase", "left").where("longer IS NULL OR longer < f").select("phrase", F.col("f").alias("a"))
    # every cut, with how often its two parts occur
    cuts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, m - F.col("k")).alias("right"))
    every = counted.unionByName(words.select(F.array("id").alias("phrase"), F.col("c").alias("f")))
    for side, of in (("left", "l"), ("right", "r")):
        cuts = cuts.join(every.select(F.col("phrase").alias(side), F.col("f").alias(of)), side)
    cuts = cuts.withColumn("id", F.col("phrase")[0]).join(words.select("id", "lang", "n"), "id")
    best = cuts.groupBy("phrase", "lang", "n", "a").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("b"))
    # words in place of their numbers
    spelt = best.select("*", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase", "lang", "n", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("words"))
    spelt = spelt.select("lang", F.col("words").alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    # the best of parts of a language first, so that none is ranked whole in one task
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = spelt.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, w[i:i + m - 1] AS p, m, count(*) AS f FROM places, range(1, 6) AS r(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, p, m, f AS a, ' ' || array_to_string(p, ' ') || ' ' AS s FROM grams WHERE m > 1),
kept AS (SELECT * FROM candidates AS c WHERE NOT EXISTS (SELECT 1 FROM candidates AS d WHERE d.lang = c.lang AND d.m > c.m AND d.a >= c.a AND contains(d.s, c.s))),
cuts AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM kept AS c JOIN range(1, 5) AS t(k) ON k < c.m JOIN totals USING (lang) JOIN grams AS x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN grams AS y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
best AS (SELECT *, array_to_string(p, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
