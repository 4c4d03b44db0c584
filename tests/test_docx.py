"""DOCX files to Markdown: styles, lists with counters, runs and tables."""

import io
import zipfile

from corpusloom.operators import layout
from corpusloom.sources import docx

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def made(body: str, styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f"<w:styles {SPACE}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}<w:sectPr/></w:body></w:document>")
    return out.getvalue()


def p(text, style=None, run=""):
    of = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{of}<w:r>{run}<w:t>{text}</w:t></w:r></w:p>"


STYLES = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [("T", "Title"), ("H1", "heading 1"), ("H9", "Heading9"), ("N", "List Number"), ("N2", "List Number 2"), ("B", "List Bullet"), ("B3", "list bullet 3")])


def markdown(spark, **files):
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "doc_id string, content binary")
    return {r.doc_id: (r.status, r.text, r.error) for r in docx.to_markdown(table).collect()}


def test_styles_lists_and_counters(spark):
    body = p("Guide", "T") + p("Part", "H1") + p("deep", "H9") + p("one", "N") + p("inner", "N2") + p("  ") + p("two", "N") + p("inner again", "N2") + p("point", "B") + p("far", "B3") + p("new one", "N") + p("plain") + p("newer", "N")
    want = ["# Guide", "## Part", "###### deep", "1. one", "  1. inner", "2. two", "  2. inner again", "- point", "    - far", "1. new one", "plain", "1. newer"]
    assert markdown(spark, a=made(body, STYLES))["a"] == ("ok", "\n\n".join(want) + "\n", None)


def test_runs(spark):
    bold, both, off = "<w:rPr><w:b/></w:rPr>", "<w:rPr><w:b/><w:i/></w:rPr>", '<w:rPr><w:b w:val="0"/><w:i/></w:rPr>'
    run = lambda props, inner: f"<w:r>{props}{inner}</w:r>"
    body = "<w:p>" + run(bold, "<w:t>a</w:t>") + run(both, "<w:t>b</w:t>") + run(off, "<w:t>c</w:t>") + run("", '<w:t xml:space="preserve"> d</w:t><w:tab/><w:t>e</w:t><w:br/><w:t>f</w:t><w:noBreakHyphen/>') + "</w:p>"
    assert markdown(spark, a=made(body))["a"][1] == "**a*****b****c* d\te\nf-\n"


def test_tables_reset_counters_and_repeat_merged_cells(spark):
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"
    rows = [cell("wide", '<w:gridSpan w:val="2"/>') + cell("x"), cell("tall", '<w:vMerge w:val="restart"/>') + cell("b") + cell(" c "), cell("", "<w:vMerge/>") + cell("d") + cell("e"), cell("") + cell("") + cell("")]
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    body = p("one", "N") + table + p("again", "N")
    want = "1. one\n\n| wide | wide | x |\n| --- | --- | --- |\n| tall | b | c |\n| tall | d | e |\n\n1. again\n"
    assert markdown(spark, a=made(body, STYLES))["a"][1] == want


def test_bad_and_empty_files_do_not_stop_the_others(spark):
    got = markdown(spark, bad=b"no archive", empty=made(""), good=docx.document([("Heading 2", "A & <b>"), ("Normal", "text é")]), cut=made("<w:p>")[:60])
    assert got["good"] == ("ok", "### A & <b>\n\ntext é\n", None) and got["empty"] == ("ok", "\n", None)
    assert got["bad"][0] == got["cut"][0] == "failed" and got["bad"][1] is None and "BadZipFile" in got["bad"][2]


def test_a_file_is_read_where_it_lies_as_its_paragraphs_in_a_table(spark):
    import random

    rng = random.Random(4)
    styles = [None, "", "Title", " Document Title ", "heading 1", "Heading7", "Heading", "List Number", "list number 3", "List Number 0", "List Bullet", "List Bullet 2", "Normal", " List Bullet"]
    texts = ["", " ", "a", " b\u3000", "\u00a0", "c\nd", "e\x85", "\u200bf", "g\x1c"]
    made_up = {}
    for doc in range(120):
        rows = [(rng.choice(styles), [(rng.choice(texts), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 3))], None) for _ in range(rng.randint(0, 12))]
        rows += [(None, None, [[rng.choice(texts) for _ in range(2)] for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 2))]
        rng.shuffle(rows)
        made_up[doc] = [(ix, *row) for ix, row in enumerate(rows)]
    table = spark.createDataFrame([(d, *b) for d, all_ in made_up.items() for b in all_], f"doc_id int, {docx.PARAGRAPHS}")
    want = {r.doc_id: r.markdown for r in layout.paragraphs_to_markdown(table).collect()}
    assert {d: layout.blocks_to_markdown(b) for d, b in made_up.items()} == {d: want.get(d, "\n") for d in made_up}
    plan = docx.to_markdown(spark.createDataFrame([(1, bytearray(b""))], "doc_id int, content binary"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInPandas") == 1
