"""Word-processor and spreadsheet files as Open XML packages, with the standard library alone.

A document of paragraphs or cells is one value, so a task holds one document at a time. decode() of what encode() made
gives the same rows; of files made elsewhere it gives their text, without their looks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.workers import reach

# Names of the format's parts and spaces.
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
# Body text of an export, and a sheet's header row.
BODY_FONT, BODY_HALF_POINTS = "David", 24
HEADER_FONT, HEADER_SIZE, HEADER_COLOUR, HEADER_FILL = "Calibri", 11, "FFFFFFFF", "FF0D1B2A"

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = {"Heading 1": "Heading1", "Heading 2": "Heading2", "Body": "Body"}
#: What XML can't hold, or would change, and what looks like the escape for it.
_ODD = re.compile("[^\t\n\x20-퟿-�\U00010000-\U0010ffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _text(s: str) -> str:
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", s))


def _plain(s: str | None) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), s or "")


def _zip(parts: dict[str, str]) -> bytes:
    """A package; parts carry one fixed date, so equal documents are equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _package(main: str, kind: str, others: dict[str, str]) -> dict[str, str]:
    """Content types of all parts, and the relation to the main one."""
    types = "".join(f'<Override PartName="/{name}" ContentType="{t}+xml"/>' for name, t in {main: kind, **others}.items())
    return {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="{main}"/></Relationships>',
    }


def _relations(targets: dict[str, str]) -> str:
    return f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t.partition(":")[0]}" Target="{t.partition(":")[2]}"/>' for i, t in targets.items()) + "</Relationships>"


def docx(paragraphs: list[tuple[str, str]]) -> bytes:
    """Bytes of a word-processor file with (style, text) paragraphs; body text is aligned to the right."""
    rows = "".join(f'<w:p><w:pPr><w:pStyle w:val="{_STYLES[style]}"/></w:pPr><w:r><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>' for style, text in paragraphs)
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 6 * i}"/></w:rPr></w:style>' for i in (1, 2))
    body = f'<w:style w:type="paragraph" w:styleId="Body"><w:name w:val="Body"/><w:pPr><w:jc w:val="right"/></w:pPr><w:rPr><w:rFonts w:ascii="{BODY_FONT}" w:hAnsi="{BODY_FONT}" w:cs="{BODY_FONT}"/><w:sz w:val="{BODY_HALF_POINTS}"/></w:rPr></w:style>'
    return _zip({
        **_package("word/document.xml", f"{WORD_TYPE}.document.main", {"word/styles.xml": f"{WORD_TYPE}.styles"}),
        "word/_rels/document.xml.rels": _relations({"rId1": "styles:styles.xml"}),
        "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{rows}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{WORD}">{heads}{body}</w:styles>',
    })


def read_docx(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of each paragraph; a style that isn't one of ours is Body."""
    names = {v: k for k, v in _STYLES.items()}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = f"{{{WORD}}}"
    out = []
    for p in root.iter(f"{w}p"):
        style = p.find(f"{w}pPr/{w}pStyle")
        parts = [{f"{w}t": lambda e: e.text or "", f"{w}tab": lambda _: "\t", f"{w}br": lambda _: "\n"}.get(e.tag, lambda _: "")(e) for e in p.iter()]
        out.append((names.get(style.get(f"{w}val") if style is not None else "", "Body"), _plain("".join(parts))))
    return out


def _column(n: int) -> str:
    name = ""
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def xlsx(sheets: dict[str, list[tuple[int, int, str]]], widths: dict[tuple[str, int], float], headers: frozenset[str] = frozenset()) -> bytes:
    """Bytes of a workbook: for each sheet its (row, col, value) cells in any order, column widths by (sheet, col), and
    which sheets have a header row. All cells of a sheet with widths have borders and are wrapped."""
    parts, names = {}, list(sheets)
    for i, name in enumerate(names, 1):
        by: dict[int, list[str]] = {}
        framed = any(s == name for s, _ in widths)
        for row, col, value in sorted(sheets[name]):
            style = 2 if row == 1 and name in headers else 1 if framed else 0
            by.setdefault(row, []).append(f'<c r="{_column(col)}{row}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>')
        columns = "".join(f'<col min="{c}" max="{c}" width="{w}" customWidth="1"/>' for (s, c), w in sorted(widths.items()) if s == name)
        rows = "".join(f'<row r="{r}">{"".join(cells)}</row>' for r, cells in by.items())
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{SHEET}">' + (f"<cols>{columns}</cols>" if columns else "") + f"<sheetData>{rows}</sheetData></worksheet>"
    edges = "".join(f'<{e} style="thin"/>' for e in ("left", "right", "top", "bottom"))
    align = 'applyAlignment="1" applyBorder="1" borderId="1"><alignment horizontal="right" wrapText="1"/></xf>'
    styles = (
        f'<styleSheet xmlns="{SHEET}"><fonts count="2"><font/><font><b/><sz val="{HEADER_SIZE}"/><color rgb="{HEADER_COLOUR}"/><name val="{HEADER_FONT}"/></font></fonts>'
        f'<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{HEADER_FILL}"/></patternFill></fill></fills>'
        f'<borders count="2"><border/><border>{edges}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="3"><xf/><xf {align}<xf fontId="1" fillId="2" applyFont="1" applyFill="1" {align}</cellXfs></styleSheet>'
    )
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    relations = {f"rId{i}": f"worksheet:worksheets/sheet{i}.xml" for i in range(1, len(names) + 1)} | {f"rId{len(names) + 1}": "styles:styles.xml"}
    return _zip({
        **_package("xl/workbook.xml", f"{SHEET_TYPE}.sheet.main", {p: f"{SHEET_TYPE}.worksheet" for p in parts} | {"xl/styles.xml": f"{SHEET_TYPE}.styles"}),
        "xl/_rels/workbook.xml.rels": _relations(relations),
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/styles.xml": styles,
        **parts,
    })


def read_xlsx(content: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of every cell, in the order of sheets, rows and columns; shared strings are looked up."""
    m, out = f"{{{SHEET}}}", []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_plain("".join(t.text or "" for t in si.iter(f"{m}t"))) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            target = targets[sheet.get(f"{{{OFFICE}}}id")]
            for c in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{m}c"):
                letters, row = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
                col = 0
                for x in letters:
                    col = 26 * col + ord(x) - 64
                value, kind = c.find(f"{m}v"), c.get("t")
                text = _plain("".join(t.text or "" for t in c.iter(f"{m}t"))) if kind == "inlineStr" else shared[int(value.text)] if kind == "s" else (value.text or "") if value is not None else ""
                out.append((sheet.get("name"), int(row), col, text))
    return out


def docx_files(paragraphs: DataFrame) -> DataFrame:
    """doc_id, content: a word-processor file of each document's paragraphs (doc_id, seq, style, text)."""
    reach(paragraphs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [docx([(x["style"], x["text"]) for x in p]) for p in b["p"]]})

    rows = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "style", "text"))).alias("p"))
    return rows.mapInPandas(run, "doc_id long, content binary")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """doc_id, seq, style, text of word-processor files (doc_id, content)."""
    reach(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, s, t) for d, c in zip(b["doc_id"], b["content"], strict=True) for i, (s, t) in enumerate(read_docx(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "style", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, seq long, style string, text string")


def xlsx_files(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """doc_id, content: a workbook of each document's cells (doc_id, sheet, at: the sheet's place, header, row, col, value),
    with widths (doc_id, sheet, col, width)."""
    reach(cells.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, w in zip(b["c"], b["w"], strict=True):
                sheets: dict[str, list] = {}
                for x in c:
                    sheets.setdefault(x["sheet"], []).append((x["row"], x["col"], x["value"]))
                out.append(xlsx(sheets, {(x["sheet"], x["col"]): x["width"] for x in (w if w is not None else [])}, frozenset(x["sheet"] for x in c if x["header"])))
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": out})

    by = cells.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "sheet", "row", "col", "value", "header"))).alias("c"))
    wide = widths.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sheet", "col", "width"))).alias("w"))
    return by.join(wide, "doc_id", "left").select("doc_id", "c", "w").mapInPandas(run, "doc_id long, content binary")


def xlsx_cells(files: DataFrame) -> DataFrame:
    """doc_id, sheet, row, col, value of workbooks (doc_id, content)."""
    reach(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *x) for d, c in zip(b["doc_id"], b["content"], strict=True) for x in read_xlsx(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "sheet", "row", "col", "value"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id long, sheet string, row long, col long, value string")
