"""Picks of one job against picking one by one in plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from corpusloom.operators import selection

POOL = "item_id string, dialogue_id string, category string, domain string, language string, relation string, history string, format string"


def jitter(seed, split, item):
    return int(hashlib.sha256(f"{seed}:{split}:{item}".encode()).hexdigest()[:16], 16) / 2**64


def one_by_one(pool, quotas, targets, seed, split):
    counts, used, out = {d: Counter() for d in selection.WEIGHTS}, set(), []
    names = ("item_id", "dialogue_id", "category", "domain", "language", "relation", "history", "format")
    rows = [dict(zip(names, r, strict=True)) for r in pool]
    for category, n in quotas.items():
        for _ in range(n):
            free = [r for r in rows if r["category"] == category and r["dialogue_id"] is not None and r["dialogue_id"] not in used]

            def worth(r):
                total = 0.0
                for d, w in selection.WEIGHTS.items():
                    t = targets.get(d, {}).get(r[d], 0)
                    total += w * (t - counts[d][r[d]]) / t if t > 0 else 0.0
                return total

            best = min(free, key=lambda r: (-worth(r), -jitter(seed, split, r["item_id"]), r["item_id"]))
            out.append(best["item_id"])
            used.add(best["dialogue_id"])
            for d in counts:
                counts[d][best[d]] += 1
    return out


def test_quotas_equal_picking_one_by_one(spark):
    rng = random.Random(7)
    # a third of all rows has one profile and one dialogue holds a tenth of them; some rows are repeated, some have nulls
    pool = [("same", "d0", "answer", "a", "en", "same", "none", "md")] * 3
    for i in range(500):
        hot = rng.random() < 0.35
        dialogue = None if rng.random() < 0.05 else "d0" if rng.random() < 0.1 else f"d{rng.randrange(90)}"
        pool.append((f"i{i}", dialogue, rng.choice(["answer", "clarification"]), "a" if hot else rng.choice(["a", "b", "c", None]), "en" if hot else rng.choice(["en", "zh"]), "same", rng.choice(["none", "short", "long"]), rng.choice(["md", "pdf"])))
    quotas, targets = {"clarification": 9, "answer": 14}, {"domain": {"a": 4, "b": 8, "c": 11}, "language": {"en": 12, "zh": 11}, "history": {"short": 5, "gone": 2, "long": 0}}
    want = one_by_one(pool, quotas, targets, 3, "dev")
    for parts in (1, 7):
        got = selection.greedy_quotas(spark.createDataFrame(pool, POOL).repartition(parts), quotas, targets, 3, "dev")
        assert [r.item_id for r in got.orderBy("ordinal").collect()] == want


def test_rows_are_cut_before_they_meet(spark):
    pool = spark.createDataFrame([("i", "d", "answer", "a", "en", "same", "none", "md")], POOL)
    plan = selection.greedy_quotas(pool, {"answer": 1}, {"domain": {"a": 1}}, 1, "dev")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("column", ["label", "domain"])
def test_smoke_set_equals_picking_one_by_one(spark, column):
    rng = random.Random(8)
    items = [(f"q{i % 190}", "refuse" if i % 190 < 40 else "clarify" if i % 190 < 90 else "answer", "out_of_domain" if i % 190 % 9 == 0 else f"dom{i % 190 % 4}", None if i % 190 % 11 == 0 else f"f{i % 190 % 3}") for i in range(200)] + [(None, "answer", "dom1", "f9")]
    rng.shuffle(items)
    targets, dims = {"refuse": 4, "clarify": 5, "answer": 11}, ["domain", "format"]
    counts, want = [Counter(), Counter()], []
    for label in ("refuse", "clarify", "answer"):
        for slot in range(targets[label]):
            free = [x for x in items if x[1] == label and x[0] is not None and x[0] not in want]
            if label == "refuse" and slot < 2:
                free = [x for x in free if (x[2] == "out_of_domain") == (slot == 0)] or free
            best = max(free, key=lambda x: (sum(1 / (1 + c[v]) for c, v in zip(counts, x[2:], strict=True)), hashlib.sha256(f"5:smoke:{x[0]}".encode()).hexdigest()))
            want.append(best[0])
            for c, v in zip(counts, best[2:], strict=True):
                c[v] += 1
    table = spark.createDataFrame(items, "question_id string, label string, domain string, format string").repartition(5, column)
    assert [r.question_id for r in selection.smoke_set(table, targets, 5, dims).orderBy("ordinal").collect()] == want


def test_nothing_to_pick_from(spark):
    empty = spark.createDataFrame([], POOL)
    assert selection.greedy_quotas(empty, {}, {}, 1, "dev").count() == 0
    with pytest.raises(Exception, match="no item is left for answer"):
        selection.greedy_quotas(empty, {"answer": 1}, {}, 1, "dev").collect()
    with pytest.raises(Exception, match="no item is left for refuse"):
        selection.smoke_set(spark.createDataFrame([], "question_id int, label string, domain string"), {"refuse": 1}, 1, ["domain"]).collect()
