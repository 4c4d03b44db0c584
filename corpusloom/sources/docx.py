"""DOCX files: a streaming reader of paragraphs and tables, and a writer of plain ones.

A file is a ZIP archive; its body is parsed block by block (a paragraph or a table), so what a task holds is one block beside the file's bytes. Styles count by
their names, whatever the case in which they are stored. Text of a paragraph is that of its own runs; bold and italic are what a run itself says.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import blocks_to_markdown

#: Fixed value: the namespace of the format's elements.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "ix int, style string, runs array<struct<text:string,bold:boolean,italic:boolean>>, cells array<array<string>>"


def _says(properties, name: str) -> bool:
    at = None if properties is None else properties.find(W + name)
    return at is not None and at.get(W + "val", "1") not in ("0", "false", "off")


def _run_text(run) -> str:
    plain = {W + "tab": "\t", W + "cr": "\n", W + "noBreakHyphen": "-"}
    out = []
    for e in run:
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "br":
            out.append("\n" if e.get(W + "type", "textWrapping") == "textWrapping" else "")
        else:
            out.append(plain.get(e.tag, ""))
    return "".join(out)


def _cell_text(cell) -> str:
    runs = lambda p: [r for e in p for r in ([e] if e.tag == W + "r" else e.findall(W + "r") if e.tag == W + "hyperlink" else [])]
    return "\n".join("".join(map(_run_text, runs(p))) for p in cell.findall(W + "p"))


def _table(table) -> list[list[str]]:
    """Texts of all grid places: a merged cell stands in each of its places."""
    out: list[list[str]] = []
    for row in table.findall(W + "tr"):
        texts: list[str] = []
        for cell in row.findall(W + "tc"):
            p = cell.find(W + "tcPr")
            span = None if p is None else p.find(W + "gridSpan")
            merge = None if p is None else p.find(W + "vMerge")
            goes_on = merge is not None and merge.get(W + "val", "continue") == "continue"
            above = out[-1][len(texts)] if goes_on and out and len(texts) < len(out[-1]) else None
            texts += [_cell_text(cell) if above is None else above] * int("1" if span is None else span.get(W + "val", "1"))
        out.append(texts)
    return out


def _styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and the name of the default one."""
    names, default = {}, "Normal"
    if "word/styles.xml" in archive.namelist():
        for s in ElementTree.fromstring(archive.read("word/styles.xml")).iter(W + "style"):
            name = s.find(W + "name")
            if s.get(W + "type", "paragraph") == "paragraph" and name is not None:
                names[s.get(W + "styleId", "")] = name.get(W + "val", "")
                if s.get(W + "default") in ("1", "true", "on"):
                    default = name.get(W + "val", "")
    return names, default


def blocks(content: bytes) -> Iterator[tuple]:
    """(ix, style, runs, cells) of a file's paragraphs and tables, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names, default = _styles(archive)
        with archive.open("word/document.xml") as body:
            depth, ix, inside = 0, 0, None
            for event, e in ElementTree.iterparse(body, ("start", "end")):
                if event == "start":
                    depth += 1
                    if e.tag == W + "body" and inside is None:
                        inside = depth
                    continue
                depth -= 1
                if inside is None or depth != inside:
                    continue
                if e.tag == W + "p":
                    of = e.find(f"{W}pPr/{W}pStyle")
                    runs = [(_run_text(r), _says(r.find(W + "rPr"), "b"), _says(r.find(W + "rPr"), "i")) for r in e.findall(W + "r")]
                    yield ix, default if of is None else names.get(of.get(W + "val", ""), default), runs, None
                    ix += 1
                elif e.tag == W + "tbl":
                    yield ix, None, None, _table(e)
                    ix += 1
                e.clear()


def paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, error) and the columns of PARAGRAPHS from ``files(doc_id, content)``; a file that can't be read is one row with its error."""
    import pandas as pd

    names = ["doc_id", "error", "ix", "style", "runs", "cells"]

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                held = []
                try:
                    for ix, style, runs, cells in blocks(bytes(content if content is not None else b"")):
                        held.append((doc_id, None, ix, style, runs and [dict(zip(("text", "bold", "italic"), r, strict=True)) for r in runs], cells))
                        if len(held) >= 1000:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except Exception as e:  # noqa: BLE001  one file's failure is a row of the report
                    held.append((doc_id, f"{type(e).__name__}: {e}", None, None, None, None))
                if held:
                    yield pd.DataFrame(held, columns=names)

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, error string, {PARAGRAPHS}")


def to_markdown(files: DataFrame) -> DataFrame:
    """(doc_id, status, text, error): each file in Markdown, read where it lies; one that can't be read has status 'failed' and the others go on. A file without text is one line break."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, content in zip(batch.doc_id, batch.content, strict=True):
                try:
                    out.append((doc_id, "ok", blocks_to_markdown(blocks(bytes(content if content is not None else b""))), None))
                except Exception as e:  # noqa: BLE001  one file's failure is a row of the report
                    out.append((doc_id, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "status", "text", "error"])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, status string, text string, error string")


def document(paragraphs_: list[tuple[str, str]]) -> bytes:
    """A DOCX file of (style, text) paragraphs."""
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = sorted({s for s, _ in paragraphs_})
    ids = {s: f"s{i}" for i, s in enumerate(styles)}
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{ids[s]}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs_)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/styles.xml", f"<w:styles {spaces}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{ids[s]}"><w:name w:val={quoteattr(s)}/></w:style>' for s in styles) + "</w:styles>")
        z.writestr("word/document.xml", f"<w:document {spaces}><w:body>{body}</w:body></w:document>")
    return out.getvalue()
