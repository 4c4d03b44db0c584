"""Trees of tables, versions and text runs."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keytree, textruns
from corpusloom.sources import snapshots

KIND = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(1)
    return [(i, rng.choice("abc")) for i in range(700)] + [(None, "x"), (3, "again"), (5, None), (5, None)]


def test_one_root_for_all_partitionings(spark, table):
    a = keytree.build(frame(spark, table), "k", leaf=8)
    b = keytree.build(frame(spark, table[::-1]).repartition(7), "k", leaf=8)
    assert a.depth == 2 and a.root().collect() == b.root().collect() and a.root().first().n == len(table)
    assert keytree.diff(a, b).collect() == []
    sizes = a.nodes.where(f"level = {a.depth}").agg(F.max("n")).first()[0]
    assert sizes < 40


def test_differences_by_reading_differing_folders_only(spark, table, tmp_path):
    changed = [(k, "new") if k == 17 else (k, v) for k, v in table if k != 99] + [(5000, "added"), (3, "once more")]
    a, b = (keytree.build(frame(spark, t), "k", leaf=8) for t in (table, changed))
    for name, tree in (("a", a), ("b", b)):
        keytree.store(tree, str(tmp_path / name))
    a, b = (keytree.load(spark, str(tmp_path / n)) for n in "ab")
    got = keytree.diff(a, b)
    assert {(r.key, r.change) for r in got.collect()} == {(17, "changed"), (99, "removed"), (5000, "added"), (3, "changed")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and plan.count("folder#") > 0
    at, depth = keytree.differing(a, b)
    assert depth == 2 and at.count() <= 4
    # trees of other depths
    c = keytree.build(frame(spark, changed), "k", leaf=200)
    assert {(r.key, r.change) for r in keytree.diff(a, c).collect()} == {(17, "changed"), (99, "removed"), (5000, "added"), (3, "changed")}


def test_tree_of_nothing(spark, table):
    none, some = keytree.build(frame(spark, []), "k"), keytree.build(frame(spark, table[:2]), "k")
    assert none.root().collect() == [] and keytree.diff(none, none).collect() == []
    assert {r.change for r in keytree.diff(none, some).collect()} == {"added"}


def test_versions(spark, tmp_path):
    at = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, at)
    assert snapshots.replace(frame(spark, [(1, "a"), (2, "b")]), at) == 0
    assert snapshots.append(frame(spark, [(3, "c")]), at) == 1
    assert snapshots.replace_changed(frame(spark, [(3, "c"), (2, "b"), (1, "a")]), at, "k") == (1, 0)
    assert snapshots.replace_changed(frame(spark, [(1, "z"), (2, "b")]), at, "k") == (2, 2)
    of = lambda v=None: sorted(map(tuple, snapshots.read(spark, at, v).collect()))
    assert of(0) == [(1, "a"), (2, "b")] and of(1) == [(1, "a"), (2, "b"), (3, "c")] and of() == of(2) == [(1, "z"), (2, "b")]
    with pytest.raises(ValueError, match="columns"):
        snapshots.append(spark.createDataFrame([(1,)], "other int"), at)
    assert snapshots.verify(spark, at, 1).collect() == []


def test_a_changed_file_is_told(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace(frame(spark, [(i, "a") for i in range(20)]).repartition(2), at)
    files = sorted((tmp_path / "t" / "data").rglob("*.parquet"))
    raw = bytearray(files[0].read_bytes())
    raw[len(raw) // 2] ^= 1
    files[0].write_bytes(raw)
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert {(r.file, r.problem) for r in snapshots.verify(spark, at).collect()} == {(files[0].name, "changed")}
    files[0].unlink()
    (files[1].parent / "extra.parquet").write_bytes(b"PAR1")
    assert {(r.file, r.problem) for r in snapshots.verify(spark, at).collect()} == {(files[0].name, "missing"), ("extra.parquet", "not_in_inventory")}


def test_two_writers_at_once(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace(frame(spark, [(0, "first")]), at)
    both = threading.Barrier(2)

    def slow(spark_, path, text):
        if not slow.met.get(threading.get_ident()):
            slow.met[threading.get_ident()] = True
            both.wait(60)  # both have read version 0 now
        snapshots.put_if_absent(spark_, path, text)

    slow.met = {}
    failed = []

    def add(k):
        try:
            snapshots.append(frame(spark, [(k, "added")]), at, put=slow)
        except Exception as e:  # noqa: BLE001  told below
            failed.append(e)

    writers = [threading.Thread(target=add, args=(k,)) for k in (1, 2)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and snapshots.versions(spark, at) == [0, 1, 2]
    assert sorted(r.k for r in snapshots.read(spark, at).collect()) == [0, 1, 2]


def test_a_writer_that_depends_on_the_table_is_called_again(spark, tmp_path):
    at = str(tmp_path / "t")
    snapshots.replace(frame(spark, [(0, "first")]), at)
    seen = []

    def change(last):
        if not seen:  # another writer is faster
            snapshots.append(frame(spark, [(7, "other")]), at)
        seen.append(sorted(r.k for r in last.collect()))
        return last.withColumn("v", F.lit("seen"))

    assert snapshots.update(spark, at, change) == 2
    assert seen == [[0], [0, 7]] and sorted(map(tuple, snapshots.read(spark, at).collect())) == [(0, "seen"), (7, "seen")]


@pytest.mark.parametrize("step", ["data", "inventory", "log"])
def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    at = str(tmp_path / "t")
    snapshots.replace(frame(spark, [(0, "first")]), at)

    def crash(*_, **__):
        raise OSError("crash")

    if step == "data":
        monkeypatch.setattr(snapshots, "_stage", crash)
    elif step == "inventory":
        monkeypatch.setattr(snapshots, "hashed", crash)
    put = crash if step == "log" else snapshots.put_if_absent
    with pytest.raises(OSError, match="crash"):
        snapshots.append(frame(spark, [(1, "lost")]), at, put=put)
    monkeypatch.undo()
    assert snapshots.versions(spark, at) == [0] and snapshots.read(spark, at).collect() == [(0, "first")]
    assert snapshots.append(frame(spark, [(1, "kept")]), at) == 1 and snapshots.read(spark, at).count() == 2


def plain_runs(document, text, least):
    """Maximal runs by trying every place; then the longest first, then the earliest."""
    if text and document.find(text) >= 0:
        return [(document.find(text), document.find(text) + len(text))]
    found, before = [], 0
    for i in range(len(text)):
        n = 0
        while i + n < len(text) and text[i : i + n + 1] in document:
            n += 1
        if n >= least and (i == 0 or n != before - 1):
            found.append([i, n])
        before = n
    taken = []
    while found:
        found.sort(key=lambda f: (-f[1], f[0]))
        at, n = found.pop(0)
        hit = [t for t in taken if t[0] < at + n and at < t[0] + t[1]]
        if not hit:
            taken.append((at, n))
            continue
        begin = max([at, *[t[0] + t[1] for t in hit if t[0] <= at]])
        end = min([at + n, *[t[0] for t in hit if t[0] > at]])
        if end - begin >= least:
            found.append([begin, end - begin])
    return [(document.find(text[i : i + n]), document.find(text[i : i + n]) + n) for i, n in sorted(taken)]


@pytest.mark.parametrize("letters,least", [("ab", 3), ("abcdef", 2), ("a", 4), ("ab\U0001f600", 2)])
def test_runs_are_those_of_trying_every_place(letters, least):
    rng = random.Random(len(letters))
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(60):
        document = say(rng.randrange(60))
        texts = [say(rng.randrange(25)) for _ in range(4)] + [document[3:9] + "x" + document[20:29], ""]
        assert textruns.runs(document, texts, least) == [plain_runs(document, t, least) for t in texts]


def test_runs_of_a_long_repetitive_document():
    document = "ab" * 40_000 + "c"
    assert textruns.runs(document, ["ab" * 9_000 + "x" + "bc" * 20]) == [[(0, 18_000)]]


def test_spans_of_blocks_and_visible_headings(spark):
    text = "# Benefits of work\n\nFirst condition applies to all people.\n\nOther text that is quite different here."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    body = docs.select(F.expr("text")).first()[0]
    block = lambda name, s: (1, name, body.find(s), body.find(s) + len(s), len(s))
    blocks = spark.createDataFrame([block("head", "# Benefits of work"), block("first", "First condition applies to all people."), block("other", "Other text that is quite different here.")], "doc_id long, block_id string, start int, end int, length int")
    chunks = spark.createDataFrame(
        [(1, "a", "[Guide > # Benefits of work]\nFirst condition applies to all people.", ["Guide", "# Benefits of work"]), (1, "b", "First condition applies to", None), (1, "c", None, None), (2, "d", "no document", None)],
        "doc_id long, chunk_id string, text string, heading_path array<string>",
    )
    got = {(r.chunk_id, r.block_id, r.start, r.end, r.length) for r in textruns.source_spans(docs, chunks, blocks, normalise=None).collect()}
    assert got == {("a", "head", 0, 18, 18), ("a", "first", 0, 38, 38), ("b", "first", 0, 26, 38)}


def test_short_texts_and_ranks_give_the_same_runs_and_few_frames(spark, monkeypatch):
    rng = random.Random(8)
    cases = []
    for _ in range(300):
        document = "".join(rng.choice(rng.choice(["ab", "abcdefgh", "a\U0010ffff😀"])) for _ in range(rng.randint(0, 90)))
        cut = lambda: document[(at := rng.randint(0, len(document))) : at + rng.randint(0, 40)]  # noqa: B023, E731
        cases.append((document, [cut() + rng.choice("x\x01a") + cut() for _ in range(3)], rng.choice([1, 3, 8, 16, 17])))
    short = [textruns.runs(*c) for c in cases]
    monkeypatch.setattr(textruns, "SMALL", 0)
    assert short == [textruns.runs(*c) for c in cases] == [[plain_runs(d, t, least) for t in texts] for d, texts, least in cases]
    assert len(textruns.shared("x" * 50 + "abcdefghijklmnopqrst" + "y" * 5000, ["?abcdefghijklmnopqrs?"], 16)) < 40
