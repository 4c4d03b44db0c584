"""Secret scan: three patterns, and a battery of randomness tests for strings that no pattern knows.

Long strings over an encoding's alphabet are tested for randomness: chi-squared uniformity over eight equal parts of the
inferred alphabet, Wald-Wolfowitz runs about the alphabet's middle, and lag-one serial correlation. The least of the
three p-values, times three, is the battery's. A string is called random if the battery does not reject it (p of
at least ``level``) and the false discoveries among strings of its length class stay below ``rate``: strings of
letters only (long words, and for each string as many of the letters before it) are the decoys, and the share of them that looks
as random, times the strings that are not random (from those the battery rejects), bounds the false calls. Short classes have
less power, so their decoys pass more often and their threshold is stricter; classes with few decoys borrow from their neighbours.

All of it is Column expressions. The only thing that leaves the executors is a histogram of at most 6 x 41 cells.

Null or empty text: no spans. Very long texts and very many matches cost little more than linear time. Strings of equal surprise
are called alike. Repeated rows each get a row and each count, a null doc_id stays null, an empty table gives an empty one, further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import SPAN, clear_of, cut, ends_of, find_spans, once, places, ranked, written

#: The patterns whose matches the base result lists. Runs are possessive or start at a run's beginning, so long runs cost linear time.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
#: Strings that are tested.
CANDIDATE = r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_-]{20,}+={0,2}"

LEVEL, RATE = 0.01, 0.05
#: Upper ends of length classes.
CLASSES = (24, 32, 40, 64, 128)
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def upper_tail(z: Column) -> Column:
    """P(standard normal > z) for z >= 0, by a rational approximation (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def battery(spans: Column) -> Column:
    """Each span with its encoding's tests: struct(s, e, decoy, class, surprise), surprise = -log10 p in tenths, 40 at most."""

    def encode(x: Column) -> Column:
        m = F.rtrim(x["m"], F.lit("="))
        kind = F.when(m.rlike("^[0-9a-fA-F]+$"), "hex").when(m.rlike("^[A-Z2-7]+$"), "base32").when(m.rlike("^[a-z0-9]+$"), "base36").otherwise("base64")
        text = F.when(kind == "hex", F.lower(m)).when(kind == "base64", F.translate(m, "-_", "+/")).otherwise(m)
        letters = F.create_map(*[F.lit(v) for kv in _ALPHABETS.items() for v in kv])[kind]
        place = F.transform(F.split(text, ""), lambda c: F.greatest(F.instr(letters, c), F.lit(1)) - 1)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), (~x["m"].rlike("[0-9]")).alias("decoy"), F.length(letters).cast("double").alias("a"), place.alias("v"))

    def measure(x: Column) -> Column:
        v, a = x["v"], x["a"]
        n = F.size(v).cast("double")
        part = F.transform(v, lambda i: F.floor(8 * i / a).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(part, lambda p: p == b)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + (c - n / 8) * (c - n / 8) / (n / 8))
        high = F.transform(v, lambda i: i >= a / 2)
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        changes = F.size(F.filter(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda p, q: p != q), lambda c: c)).cast("double")
        mean = (a - 1) / 2
        cov = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda p, q: (p - mean) * (q - mean)), F.lit(0.0), lambda s, c: s + c)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["decoy"].alias("decoy"), n.alias("n"), a.alias("a"), chi.alias("chi"), n1.alias("n1"), (n - n1).alias("n2"), (changes + 1).alias("runs"), cov.alias("cov"))

    def judge(x: Column) -> Column:
        n, n1, n2 = x["n"], x["n1"], x["n2"]
        # Wilson and Hilferty's cube root for chi-squared with 7 degrees of freedom
        z_chi = F.greatest((F.pow(x["chi"] / 7, 1 / 3) - (1 - 2 / 63)) / F.lit((2 / 63) ** 0.5), F.lit(0.0))
        mu = 2 * n1 * n2 / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        z_runs = F.when(var > 0, F.abs(x["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(8.0)
        z_serial = F.abs(x["cov"]) / (F.sqrt(n - 1) * (x["a"] * x["a"] - 1) / 12)
        p = F.least(upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial)) * 3
        surprise = F.least(F.lit(40), F.floor(-10 * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-5)))).cast("int"))
        size = F.lit(len(CLASSES))
        for i in reversed(range(len(CLASSES))):
            size = F.when(n <= CLASSES[i], i).otherwise(size)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["decoy"].alias("decoy"), size.alias("class"), surprise.alias("surprise"))

    return F.transform(F.transform(F.transform(spans, encode), measure), judge)


def thresholds(tested: DataFrame, level: float = LEVEL, rate: float = RATE) -> dict[int, int]:
    """For each length class the greatest surprise that is still called random; -1: none.

    A class's false calls at a threshold are its strings that are not random (those the battery rejects at ``level``, divided by the
    share of decoys it rejects) times the share of decoys that look random; decoys of other classes count half for each
    class between, and one more, half of it random-looking, stands for none. Taken are the threshold and the classes with the most
    calls whose false ones stay below ``rate`` altogether; classes left out get the greatest lower threshold that keeps it so.
    """
    import math

    cells = tested.select(F.explode("tested").alias("x")).groupBy("x.class", "x.decoy", "x.surprise").count().collect()
    last = math.ceil(-10 * math.log10(level)) - 1
    calls: dict[tuple[int, int], int] = {}
    false: dict[tuple[int, int], float] = {}
    classes = range(len(CLASSES) + 1)
    for c in classes:
        own = {s: sum(r["count"] for r in cells if r["class"] == c and not r.decoy and r.surprise <= s) for s in (*range(last + 1), 40)}
        near = {s: 0.5 + sum(0.5 ** abs(r["class"] - c) * r["count"] for r in cells if r.decoy and r.surprise <= s) for s in own}
        whole = near[40] + 0.5
        for s in range(last + 1):
            calls[c, s], false[c, s] = own[s], near[s] / whole * (own[40] - own[last]) / (1 - near[last] / whole)
    best, out = 0, dict.fromkeys(classes, -1)
    for s in range(last + 1):
        got, wrong, chosen = 0, 0.0, dict.fromkeys(classes, -1)
        for c in sorted((c for c in classes if calls[c, s]), key=lambda c: (false[c, s] / calls[c, s], c)):  # noqa: B023
            if wrong + false[c, s] <= rate * (got + calls[c, s]):
                got, wrong, chosen[c] = got + calls[c, s], wrong + false[c, s], s
        for c in classes:
            for t in range(s - 1, -1, -1) if chosen[c] < 0 else ():
                if calls[c, t] and wrong + false[c, t] <= rate * (got + calls[c, t]):
                    got, wrong, chosen[c] = got + calls[c, t], wrong + false[c, t], t
                    break
        if got >= best:
            best, out = got, chosen
    return out


def candidates(text: Column) -> Column:
    """Strings to test, each with a decoy of its own length where there are letters enough: the last ASCII letters before it (s and e -1)."""

    def spans(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        return F.flatten(F.zip_with(F.slice(pieces, 1, n), F.slice(ends_of(pieces), 1, n), one))

    def one(x: Column, e: Column) -> Column:
        size = F.length(F.rtrim(x["m"], F.lit("=")))
        found = F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"))
        decoy = lambda letters: F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.when(F.length(letters) >= size, F.substring(letters, -size, size)).alias("m"))
        return F.array(found, once(F.regexp_replace(x["g"], "[^A-Za-z]+", ""), decoy))

    every = F.when(text.rlike(CANDIDATE), once(cut(text, CANDIDATE), spans)).otherwise(F.array().cast(SPAN))
    return F.filter(every, lambda x: x["m"].rlike("[0-9A-Za-z]{8}"))


def scan(docs: DataFrame, level: float = LEVEL, rate: float = RATE) -> DataFrame:
    """(doc_id, assign, access, hex, random): spans of each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(find_spans(text, ASSIGN, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6).alias("assign"),
        F.filter(find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: x["e"] - x["s"] >= 20).alias("access"),
        find_spans(text, HEX).alias("hex"),
        candidates(text).alias("long"),
    )
    tested = base.select("doc_id", *[places(F.col(k)).alias(k) for k in ("assign", "access", "hex")], battery(F.col("long")).alias("tested"))
    tested = materialise(tested, "secrets")
    limit = F.create_map(*[F.lit(v) for kv in thresholds(tested, level, rate).items() for v in kv])
    called = F.filter("tested", lambda x: ~x["decoy"] & (x["surprise"] <= limit[x["class"]]))
    free = clear_of(called, [F.col("assign"), F.col("access"), F.col("hex")])
    return tested.select("doc_id", "assign", "access", "hex", places(free).alias("random"))


def query(docs: DataFrame) -> DataFrame:
    kinds = [(k, F.col(k)) for k in ("assign", "access", "hex")]
    listed = scan(docs).select("*", ranked(kinds, True).alias("base"), ranked([*kinds, ("random", F.col("random"))], True).alias("all"))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return listed.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base"), True).cast("binary"), 256).alias("base_sha256"), written(F.col("all"), True).alias("spans"), count("random"))
