import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.plans import catalogue
from corpusloom.sources import readers, writers
from corpusloom.streaming import state

SMALL = "/root/testdata/sf0.001"


def test_manifest_and_texts(spark, tmp_path):
    doc = {"doc_id": "a", "domain": "x", "title": "t", "language": "en", "format": "md", "file": "a.md"}
    (tmp_path / "m.json").write_text(json.dumps({"documents": [doc, doc | {"doc_id": "b", "format": "txt"}]}))
    assert [r.doc_id for r in readers.manifest(spark, str(tmp_path / "m.json"), formats=["txt"]).collect()] == ["b"]
    (tmp_path / "bad.json").write_text(json.dumps({"documents": [{"doc_id": "a"}]}))
    with pytest.raises(Exception, match="missing"):
        readers.manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("---\ndoc_id: 'a'\ntitle: T\n---\n\n# H\n")
    (tmp_path / "t" / "b.md").write_text("no block")
    assert sorted(r.text for r in readers.markdown(spark, str(tmp_path / "t")).collect()) == ["# H\n", "no block\n"]
    parsed = readers.front_matter(readers.whole_texts(spark, str(tmp_path / "t"))).collect()
    assert len(parsed) == 1 and parsed[0].meta == {"doc_id": "a", "title": "T"}
    again = spark.createDataFrame([("a: b", None, "x", "body")], "title string, domain string, other string, text string")
    assert readers.with_front_matter(again).first().rendered == "---\ntitle: 'a: b'\nother: x\n---\n\nbody"


def test_conversion_goes_on(spark):
    files = spark.createDataFrame([("a", "txt", "en", bytearray(b"hi")), ("b", "pdf", "en", bytearray(b"x"))], "doc_id string, format string, language string, content binary")
    got = {r.doc_id: (r.status, r.text) for r in readers.convert(files, {"txt": lambda b, _: b.decode()}).collect()}
    assert got == {"a": ("ok", "hi"), "b": ("failed", None)}


def test_reviews(spark, tmp_path):
    ids = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    (tmp_path / "r.csv").write_text("question_id,label\nq1, answer \nq2,refuse\n")
    assert {r.question_id: r.label for r in readers.reviews(spark, str(tmp_path / "r.csv"), ids, ["label"]).collect()} == {"q1": "answer", "q2": "refuse"}
    for bad in ("question_id,label\nq1,a\nq1,a\n", "question_id,label\nq1,a\nq3,a\n", "question_id\nq1\nq2\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(ValueError):
            readers.reviews(spark, str(tmp_path / "b.csv"), ids, ["label"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "call 555-123-4567", ["a", "b"])], "id string, note string, tags array<string>")
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 2 and rows[0].note == "call [PHONE]"
    writers.release(df, str(tmp_path / "rel"))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.release(df, str(tmp_path / "rel"))
    writers.review_sheet(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().tags == "a;b"
    flat = df.select("id", "note")
    assert writers.replace_changed(flat, str(tmp_path / "v"), "id", ["note"]) == 1
    assert writers.replace_changed(flat, str(tmp_path / "v"), "id", ["note"]) == 0
    assert writers.replace_changed(flat.withColumn("note", F.lit("n")), str(tmp_path / "v"), "id", ["note"]) == 1
    assert spark.read.parquet(str(tmp_path / "v")).first().note == "n"


def test_session_stream(spark, tmp_path):
    kind = "session_id string, ts long, question string, answer string, ok boolean, reset boolean"
    rows = [("s", 1, "a", "A", True, False), ("s", 2, "b", "B", False, False), ("s", 3, "c", "C", True, False), ("s", 4, "", "", True, True), ("s", 5, "d", "D", True, False), ("t", 1, "z", "Z", True, False)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = state.session_turns(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    got = {(r.session_id, r.question): (r.turn_id, r.history) for r in state.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got == {("s", "a"): (1, ""), ("s", "b"): (2, "user: a\nagent: A"), ("s", "c"): (3, "user: a\nagent: A"), ("s", "d"): (1, ""), ("t", "z"): (1, "")}


def test_first_requests(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01' AS ts, 'm' AS messages, 'ok' AS status UNION ALL SELECT timestamp'2024-01-01 00:01:00', 'm', 'ok' UNION ALL SELECT timestamp'2024-01-01', 'm', 'failed'").write.parquet(str(tmp_path / "in"))
    s = state.first_requests(spark.readStream.schema("ts timestamp, messages string, status string").parquet(str(tmp_path / "in")))
    got = state.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.status for r in got.collect()) == ["failed", "ok"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_sql(spark, name):
    from tools.compare import TABLES, normal

    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        assert normal(got) == normal(con.sql(catalogue.ORACLES[name]).df())
