"""The whole job where a shortcut was easy: crowded shards, block edits, short answers, long words, missing ids."""

import random

from corpusloom.llm import decontaminate, html_extract, simhash

from .conftest import prose


def groups_of(df):
    return sorted((r.doc_id, r.group_id) for r in df.collect())


def test_crowded_shards_keep_their_links(spark):
    rng = random.Random(31)
    rows = []
    for c in range(4):  # windows moved on by ten words: only near ones are alike
        words = prose(rng, 600).split()
        rows += [(c * 100 + i, " ".join(words[10 * i : 10 * i + 200])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = groups_of(simhash.near_groups(table))
    assert groups_of(simhash.near_groups(table, hot=2)) == whole
    assert len({g for _, g in whole}) < 100


def test_block_edits_are_near_copies(spark):
    rng, rows, n = random.Random(32), [], 0
    for words in (150, 250, 400):
        for kind in ("appended", "prepended", "cut"):
            for _ in range(30):
                text, block = prose(rng, words), prose(rng, int(words * 0.21))
                short = " ".join(text.split()[: int(words * 0.83)])
                rows += [(2 * n, text), (2 * n + 1, {"appended": f"{text} {block}", "prepended": f"{block} {text}", "cut": short}[kind])]
                n += 1
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) <= 0.85 for i in range(0, 2 * n, 2))
    got = dict(groups_of(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))))
    found = sum(got[i] == got[i + 1] for i in range(0, 2 * n, 2)) / n
    assert found >= 0.95, found
    assert len(set(got.values())) >= n  # nothing else is linked


def test_pairs_below_are_not_linked(spark):
    """Each pair near but below the similarity asked for, far from all others: the exact test tells them apart."""
    rng, rows, n = random.Random(36), [], 60
    for i in range(n):
        words = prose(rng, 300).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: int(300 * rng.uniform(0.72, 0.79))]))]
    got = dict(groups_of(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert len(set(got.values())) == 2 * n


def test_a_large_group_of_near_copies_is_whole(spark):
    rng = random.Random(37)
    words = prose(rng, 200).split()
    rows = []
    for i in range(1200):
        own = list(words)
        for _ in range(3):
            own[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(2000 + i, prose(rng, 120)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, room in ((20_000, 1 << 30), (50, 1 << 30), (20_000, 100_000)):
        got = dict(groups_of(simhash.near_groups(table, hot=hot, room=room)))
        assert all(got[i] == 0 for i in range(1200)) and all(got[2000 + i] == 2000 + i for i in range(40)), hot


def test_long_items_do_not_change_the_others(spark):
    rng = random.Random(38)
    items = [(i, prose(rng, 20)) for i in range(20)]
    long = [(100, prose(rng, 900)), (101, prose(rng, 150))]
    docs = spark.createDataFrame([(i, f"{prose(rng, 90)} {t} {prose(rng, 300)}") for i, t in items + long], "doc_id long, text string")
    find = lambda some, **more: {(r.doc_id, r.item_id): r.question_overlap for r in decontaminate.find_leaks(docs, spark.createDataFrame(some, "item_id long, text string"), **more).collect()}
    short, every = find(items), find(items + long)
    assert set(every) == {(i, i) for i, _ in items + long} and short == {k: v for k, v in every.items() if k[0] < 100}
    assert find(items + long, shard_words=200) == every


def test_short_answers_are_verified(spark):
    rng = random.Random(33)
    items = [(0, "Which town lies on the river Seine? Paris"), (1, "Who wrote the long book of whales? Herman Melville"), (2, "alpha beta gamma delta"), (3, "Why? Vexillology")]
    copied = [(i, f"{prose(rng, 150)} {t} {prose(rng, 150)}") for i, t in items]
    other = [(10, prose(rng, 200) + " which town lies on the river seine london " + prose(rng, 20)), (11, f"why {prose(rng, 60)} vexillology")]
    got = decontaminate.find_leaks(spark.createDataFrame(copied + other, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items}
    assert all(r.question_overlap == r.answer_overlap == 1.0 for r in got)


def test_scores_do_not_depend_on_shards(spark):
    rng = random.Random(34)
    items = [(i, prose(rng, 10 + i % 40)) for i in range(60)]
    docs = spark.createDataFrame([(i, f"{prose(rng, 60)} {' '.join(t.split()[: -(i % 3) or None])} {prose(rng, 60)}") for i, t in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, table, shard_words=n).collect()} for n in (10**6, 100))
    assert len(one) > 30 and one.keys() == many.keys()
    assert all(abs(s - many[k]) < 1e-9 for k, s in one.items())


def test_articles_do_not_replace_the_threshold():
    say = lambda what, n: " ".join(f"The {what} says a thing, and more of it." for _ in range(n))
    several = "".join(f"<article><h2>Part {i}</h2><p>{say(i, 4 + 8 * i)}</p><p>Short.</p></article>" for i in range(3))
    got = html_extract.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{several}<footer>me</footer></body></html>")
    assert got == "\n".join(f"Part {i}\n{say(i, 4 + 8 * i)}\nShort." for i in range(3))
    text = "".join(f"<p>{say(i, 8)}</p>" for i in range(6))
    got = html_extract.main_text(f"<html><body><div class='story'><h1>Title</h1>{text}</div><div><article><a href='/x'>Read on</a></article></div></body></html>")
    assert got == "\n".join(["Title", *(say(i, 8) for i in range(6))])
    got = html_extract.main_text(f"<html><body><main><h1>Title</h1><article>{text}</article></main></body></html>")
    assert got == "\n".join(["Title", *(say(i, 8) for i in range(6))])


def test_rows_without_an_id_and_shared_ids_are_texts(spark):
    rng = random.Random(35)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    rows = [(5, a), (None, f"{a} end"), (None, b), (None, f"{b} end"), (7, c), (7, d), (9, f"{d} end"), (2, f"{a} too")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 2, 7, 7]
    assert {r.text[:50] for r in got} == {x[:50] for x in (a, b, c, d)}
