"""Quality trees, the Merkle manifest and phrase collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, merkle, quality_trees
from tests.llm.conftest import CLASH, DOCS, prose

EXTRA = ("k", 1, "s", 0.5, 1, "same", 7, 8, "w", "l", "h", 9, "x", "y", "z", "n", "k", "e", "a", 4, 5)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars, *_):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proofs(rows, arity):
    """What the manifest's query returns, by plain trees."""

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // arity * arity
            yield level[first:i], level[i + 1 : first + arity]
            i //= arity

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = tree([leaf(*r) for r in by[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    root = top[-1][0]
    for at, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            steps = [*path(trees[lang], i), *path(top, at)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            acc = leaf(*r[:4], r[4] + 1) if hit else leaf(*r)
            for left, right in steps:
                acc = h(*left, acc, *right)
            yield r[0], leaf(*r), trees[lang][-1][0], root, h(*[x for s in steps for side in s for x in side]), acc, acc == root


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(1)
    some = lambda *of: rng.choice(of)
    rows = [(rng.randrange(300) if rng.random() > 0.05 else None, some(None, "", "a é", "long " * 4000), some(None, "en", "en", "en", "", "de", "é"), some(None, "s"), some(None, 5, 7)) for _ in range(400)]
    return rows + [rows[0]] * 90


@pytest.mark.parametrize("arity,height", [(2, 12), (2, 2), (3, 3)])
def test_manifest_is_that_of_plain_trees(spark, leaves, arity, height):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in leaves], f"{DOCS}, {CLASH}").repartition(5)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, arity, height, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.fold(F.col("changed"), F.col("proof")).alias("f")).selectExpr("*", "f = root").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(proofs(leaves, arity), key=repr)


def test_manifest_of_few_rows(spark, empty):
    assert merkle.query(empty).collect() == []
    one = [(7, "text", "en", "s", 4)]
    got = merkle.query(spark.createDataFrame(one, DOCS)).collect()
    assert [tuple(r) for r in got] == list(proofs(one, 2)) and got[0].leaf == got[0].subroot == got[0].root


def test_a_changed_byte_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", "s", 5) for i in range(40)]
    root = lambda rs: merkle.query(spark.createDataFrame(rs, DOCS)).first().root
    assert root(rows) == root(rows[::-1]) != root([*rows[:9], (9, "text 9.", "en", "s", 5), *rows[10:]])


def phrases(docs, least, longest=5, top=2000):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n, f = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        of = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            of.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            s, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-s, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            yield lang, i + 1, p.decode(), -a, left, right, n[lang], -s


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "b", "é", "x" * 40, "y" * 50, "\x01", "a\x01", "zz", "q1", "q2", "q3"]
    say = lambda: "".join(rng.choice(words[: int(rng.expovariate(0.3)) % 14 + 1]) + rng.choice([" "] * 8 + [". ", ",", "\t", "\n", " \x0b", "!?"]) for _ in range(rng.randrange(80)))
    return [(rng.choice([None, "en", "en", "de"]), say()) for _ in range(250)] + [("en", None), (None, "")] + [("en", "of the a b é " * 30)] * 60


@pytest.mark.parametrize("head,block,per_range,cut", [(500_000, 2_000_000, 1_000_000, 1 << 20), (4, 30, 40, 100)])
def test_phrases_are_those_of_plain_counts(spark, spoken, head, block, per_range, cut, monkeypatch):
    monkeypatch.setattr(collocations, "_SLICE", cut)
    docs = spark.createDataFrame([(None, t, lang, None, None, *EXTRA) for lang, t in spoken], f"{DOCS}, {CLASH}").repartition(5)
    got = collocations.collocations(docs, 20, head=head, block=block, per_range=per_range)
    assert sorted(map(tuple, got.collect())) == sorted(phrases(spoken, 20))
    assert sorted(map(tuple, got.where("rank <= 5").collect())) == sorted(phrases(spoken, 20, top=5))


def test_phrases_of_an_empty_table(empty):
    assert collocations.query(empty).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    a, n, left, right = 9_007_199_254_740_993, 10**17 + 3, 9_007_199_254_740_997, 10**16 + 1
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(collocations.score("a", "n", "l", "r")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_radix_order_is_the_order_of_keys():
    rng = np.random.default_rng(5)
    for width in (2, 3, 4):
        ids = rng.integers(0, 2 ** min(31, 8 * width), (500, 5)) // rng.integers(1, 9, (500, 5)) ** 4
        digits = collocations.pack(ids, width)
        assert (collocations.unpack(digits, width, 5) == ids).all()
        assert ids[collocations.radix_order(digits)].tolist() == sorted(ids.tolist())


def _walk(forest, row):
    """A row down every tree, node by node."""
    z = forest.base
    for t in range(len(forest.value)):
        node, inner = 0, forest.statistic.shape[1]
        while node < inner:
            s = forest.statistic[t][node]
            above = sum(1 for c in forest.cuts[s] if c < row[s])
            node = 2 * node + (2 if above > forest.bin[t][node] else 1)
        z += forest.value[t][node - inner]
    return 1 / (1 + np.exp(-z))


def test_forest_in_arrays_is_the_forest_walked():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality_trees.grow(x[:400], y[:400], trees=30)
    got = quality_trees.probability(forest, x)
    assert np.allclose(got, [_walk(forest, r) for r in x])
    assert ((got >= 0.5) == y)[400:].mean() > 0.95
    again = quality_trees.grow(x[:400], y[:400], trees=30)
    assert (again.value == forest.value).all()


def test_quality_of_held_out_documents(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randint(60, 300)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 120).split()) if i % 2 else "again " * rng.randint(80, 200) for i in range(60)]
    rows = [(i, t, "en", "s", len(t), *EXTRA) for i, t in enumerate(good + bad)] + [(None, None, None, None, None, *EXTRA), (9999, "", "en", "s", 0, *EXTRA), (3, good[3], "en", "s", 0, *EXTRA)]
    docs = spark.createDataFrame(rows, f"{DOCS}, {CLASH}")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_trees.query(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 210 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and np.mean([r.predicted == int(r.doc_id < 150) for r in held]) >= 0.95
    # held-out labels say nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality_trees.query(docs, turned).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_trees.query(docs, none).collect()} == {0.5}
    assert quality_trees.query(empty, none).collect() == []
