from pyspark.sql import functions as F

from corpusloom.functions import money
from corpusloom.functions import text as T
from corpusloom.operators import sections


def one(spark, texts, expr):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expr(F.col("t")).alias("x")).collect()]


def test_redaction(spark):
    cases = {
        "手机号13800138000": "手机号[PHONE]", "身份证11010119900307451X": "身份证[ID_NUMBER]", "SSN为123-45-6789。": "SSN为[SSN]。", "电话(518) 474-0774": "电话[PHONE]",
        "邮箱test.user+qa@example.org请联系": "邮箱[EMAIL]请联系", "我的号码是555-123-4567。": "我的号码是[PHONE]。", "费用$17.50，60天内提交MV-44；日期2026-09-06，24个月服役，电话说明。": "费用$17.50，60天内提交MV-44；日期2026-09-06，24个月服役，电话说明。", "": "",
    }
    assert one(spark, cases, T.redact) == list(cases.values())
    got = spark.sql("SELECT map('Authorization', 'x', 'api-key', 'y', 'note', 'call 555-123-4567') AS m").select(T.redact_map(F.col("m")).alias("m")).first().m
    assert got == {"Authorization": "[REDACTED]", "api-key": "[REDACTED]", "note": "call [PHONE]"}


def test_words_and_hints(spark):
    assert one(spark, ["two words", "驾驶员 abc", "", "ａ b"], T.word_count) == [2, 4, 0, 2]
    assert [h[:18] for h in one(spark, ["hello", "你好", "你好 ok", "你 hello"], T.language_hint)] == ["English", "Chinese (Simplifie", "Chinese (Simplifie", "English, naturally"]
    joined = spark.sql("SELECT array('a', ' b ', '', '驾', 'c') AS p").select(T.smart_join(F.col("p")).alias("x")).first().x
    assert joined == "a b驾c"


def test_canonical(spark):
    a, b, c, d = one(spark, ["June - July", "June July", "- 200 dollars", "200 dollars"], T.canonical)
    assert a != b and c != d
    assert one(spark, ["- First item\n- Second", "ﬁne “X”"], T.canonical) == ["firstitemsecond", 'fine"x"']


def test_tidying(spark):
    assert one(spark, ["a b  \n\n\n\nc \n", "é"], lambda c: T.tidy(T.nfc(c))) == ["a b\n\nc", "é"]
    assert one(spark, ["---\na: 1\n---\n# T\n", "x"], T.strip_front_matter) == ["# T\n", "x\n"]
    assert one(spark, [r"\[a\] \$ \q"], T.unescape) == [r"[a] $ \q"]


def test_sections(spark):
    body = "pre\n# A\nx\n\n## B\n\n### C\ny\n## Related PDFs: z\nq\n# D\n#no heading"
    docs = spark.createDataFrame([(1, body), (2, ""), (3, "\n\n")], "doc_id long, text string")
    got = [(r.level, r.heading, r.text, r.path) for r in sections.sections_table(docs).orderBy("doc_id", "sec_ix").collect()]
    assert got == [(0, None, "pre", []), (1, "A", "x", ["A"]), (2, "B", "", ["A", "B"]), (3, "C", "y", ["A", "B", "C"]), (2, "Related PDFs: z", "q", ["A", "Related PDFs: z"]), (1, "D", "#no heading", ["D"])]
    cleaned = {r.doc_id: (r.cleaned, r.sections_dropped) for r in sections.clean(docs).collect()}
    assert cleaned == {1: ("pre\n\n# A\n\nx\n\n## B\n\n### C\n\ny\n\n# D\n\n#no heading\n", 1), 2: ("", 0), 3: ("", 0)}


def test_plain_text(spark):
    got = one(spark, ["Title\nline two\n\nHeading\n\n- a\n1. b\n\n### Leak\n\nBody ends.\nmore\r\n\r\n驾驶\n员工", ""], sections.plain_to_markdown)
    assert got == ["# Title\n\n## line two\n\n## Heading\n\n- a\n\n1. b\n\n### Leak\n\nBody ends. more\n\n驾驶员工\n", "\n"]


def test_tariff(spark):
    t = spark.sql("SELECT timestamp_ntz'2026-09-06 02:00:00' AS sunday, timestamp_ntz'2026-09-07 02:52:00' AS monday, timestamp_ntz'2026-09-07 00:30:00' AS early, timestamp_ntz'2026-09-07 01:10:00' AS nine")
    m = money.interval_multiplier
    r = t.select(m(F.col("sunday"), F.col("sunday")).alias("a"), m(F.col("monday"), F.col("monday")).alias("b"), m(F.col("early"), F.col("early")).alias("c"), m(F.col("early"), F.col("nine")).alias("d")).first()
    assert tuple(r) == (0.5, 1.0, 0.5, 1.0)
    price = lambda *n: t.select(money.price("deepseek-v4-flash", *map(F.lit, n)).alias("p")).first().p
    assert abs(price(1879, 90, 1152) - 0.0031062) < 1e-12 and price(1, 1, 2) is None
    raw = ['{"prompt_tokens": 10, "completion_tokens": 2, "prompt_cache_hit_tokens": 4}', '{"prompt_tokens": 10, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 3}}', '{"prompt_tokens": 10, "completion_tokens": 2, "prompt_cache_hit_tokens": 40}', '{"prompt_tokens": true, "completion_tokens": 2}']
    assert [u and u.cached_tokens for u in one(spark, raw, money.usage)] == [4, 3, None, None]
    calls = spark.createDataFrame([(None, None), (429, None), (503, None), (401, None), (400, None), (200, "length"), (200, "stop")], "s int, f string")
    assert [r.x for r in calls.select(money.retry_class(F.col("s"), F.col("f")).alias("x")).collect()] == ["retry", "retry", "retry", "authentication_failed", "failed", "failed", "ok"]


def test_redaction_is_that_of_its_sql_where_matches_touch(spark):
    import random

    import duckdb

    from corpusloom.plans.text_queries import _redact_sql

    rng = random.Random(5)
    bits = ["a.b@c.de", "_x@y.zz", "+86", "1", "13812345678", "138-1234-5678", "(555)123-4567", "555-123-4567", "123-45-6789", "123456789012", "12345678901234567X", "call", "@f.gh", "\n", "é", "[", "."]
    texts = ["555-123-4567(555)123-4567", "555-123-4567 1-234-567-8901", "13812345678 +86 13912345678", "a@b.co_d@e.fr"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", "-", ",", "\t"]) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS text", [texts])
    want = dict(con.execute(f"SELECT text, {_redact_sql()} FROM t").fetchall())
    got = dict(map(tuple, spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.redact(F.col("text"))).collect()))
    assert got == want
