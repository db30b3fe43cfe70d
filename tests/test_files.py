"""File formats: bytes against plain readers and small models."""

import io
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.functions import raster
from quire.sources import office

words = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=20)


@given(st.lists(st.tuples(st.sampled_from(["Heading 1", "Heading 2", "Body"]), words), max_size=6))
def test_docx_round_trip(paragraphs):
    content = office.docx(paragraphs)
    assert office.read_docx(content) == paragraphs and office.docx(paragraphs) == content


@given(st.dictionaries(st.sampled_from(["a", "עמ' 1", "<&\">"]), st.dictionaries(st.tuples(st.integers(1, 60), st.integers(1, 800)), words, min_size=1, max_size=5), max_size=3))
def test_xlsx_round_trip(sheets):
    cells = {s: [(r, c, v) for (r, c), v in x.items()] for s, x in sheets.items()}
    assert office.read_xlsx(office.xlsx(cells, {("a", 1): 14}, frozenset("a"))) == [(s, r, c, v) for s in cells for r, c, v in sorted(cells[s])]


def test_packages_are_whole():
    """Every part is XML, has a content type, and every relation has its target."""
    for content in (office.docx([("Heading 1", "OCR"), ("Body", "x")]), office.xlsx({"a": [(1, 1, "x")], "b": []}, {("a", 1): 14}, frozenset("a"))):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            for n in names:
                ElementTree.fromstring(z.read(n))
            typed = {e.get("PartName") for e in ElementTree.fromstring(z.read("[Content_Types].xml")) if e.get("PartName")}
            assert typed == {f"/{n}" for n in names if not n.endswith(".rels") and n != "[Content_Types].xml"}
            for n in names:
                if n.endswith(".rels"):
                    base = n.rpartition("_rels/")[0]
                    assert all(base + e.get("Target") in names for e in ElementTree.fromstring(z.read(n)))


def test_shared_strings_and_numbers():
    made = office._zip({
        "xl/workbook.xml": f'<workbook xmlns="{office.SHEET}" xmlns:r="{office.OFFICE}"><sheets><sheet name="s" r:id="x"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": office._relations({"x": "worksheet:worksheets/one.xml"}),
        "xl/sharedStrings.xml": f'<sst xmlns="{office.SHEET}"><si><t>first</t></si><si><r><t>se</t></r><r><t>cond</t></r></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{office.SHEET}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AB2"><v>3.5</v></c><c r="AC2"/></row></sheetData></worksheet>',
    })
    assert office.read_xlsx(made) == [("s", 2, 2, "second"), ("s", 2, 28, "3.5"), ("s", 2, 29, "")]


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (4, 3, 3), (2, 6, 4)])
def test_png_round_trip(shape):
    pixels = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    data = raster.to_png(pixels)
    assert (raster.from_png(data) == pixels).all()
    assert raster.size(data) == ("png", shape[1], shape[0], {2: "L", 3: "RGB"}.get(len(shape) if len(shape) == 2 else shape[2], "RGBA"))


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Each line filter, applied by its definition, is undone."""
    rng, n = np.random.default_rng(kind), 3
    above, line = rng.integers(0, 256, 12), rng.integers(0, 256, 12)
    coded = []
    for i, x in enumerate(line):
        a, b, c = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
        p = a + b - c
        paeth = min((a, b, c), key=lambda v: (abs(p - v),)) if kind == 4 else 0
        coded.append((x - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    assert raster._unfilter(kind, np.array(coded, np.uint8), above.astype(np.uint8), n).tolist() == line.tolist()


def test_headers():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x04xx\xff\xc2\x00\x0b\x08\x00\x11\x00\x22\x03" + b"\0" * 20
    assert raster.size(jpeg) == ("jpeg", 34, 17, "RGB")
    assert raster.size(b"GIF89a\x05\x00\x07\x00\0\0\0") == ("gif", 5, 7, "P")
    assert raster.size(b"BM" + b"\0" * 16 + (9).to_bytes(4, "little") + (-4).to_bytes(4, "little", signed=True) + b"\1\0\x18\0") == ("bmp", 9, 4, "RGB")
    with pytest.raises(raster.NotReadable):
        raster.size(b"nothing")


def test_preparation():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    grey = raster.grey(pixels)
    assert grey[3, 4] == (int(pixels[3, 4, 0]) * 19595 + int(pixels[3, 4, 1]) * 38470 + int(pixels[3, 4, 2]) * 7471 + 32768) >> 16
    mean = int(grey.mean() + 0.5)
    assert raster.contrast(grey)[5, 5] == min(max(2 * int(grey[5, 5]) - mean, 0), 255)
    sharp = raster.sharpness(grey)
    near = grey[4:7, 4:7].astype(int)
    smooth = int(np.floor((near.sum() + 4 * near[1, 1]) / 13 + 0.5))
    assert sharp[5, 5] == min(max(2 * int(near[1, 1]) - smooth, 0), 255) and sharp[0, 0] == grey[0, 0]
    assert raster.prepare(pixels, 90).shape == (40, 30) and raster.prepare(pixels, 0, 20).shape == (15, 20)
    assert (raster.prepare(pixels, 90) == raster.sharpness(raster.contrast(np.rot90(grey, -1)))).all()
    flat = np.full((50, 20), 77, np.uint8)
    assert (raster.resize(flat, 7, 9) == 77).all() and raster.resize(flat, 20, 50).tolist() == flat.tolist()


def test_broken_images_are_rows(spark):
    from quire.operators import images

    df = spark.createDataFrame([(1, raster.to_png(np.zeros((2, 3), np.uint8)), None), (2, b"x", 90), (3, None, None)], "id long, content binary, angle int")
    got = {r["id"]: (r["width"], r["height"], r["error"] is None) for r in images.info(df).collect()}
    assert got == {1: (3, 2, True), 2: (None, None, False), 3: (None, None, False)}
    assert {r["id"] for r in images.prepared(df).where("error is null").collect()} == {1}


def test_pdf_is_consistent():
    """Every entry of the cross-reference table points at its object, and streams have their lengths."""
    import re

    png = raster.to_png(np.arange(12, dtype=np.uint8).reshape(2, 2, 3))
    data = raster.pdf_of_images([(png, 100.0, 50.0, (25.0, 0.0, 75.0, 50.0)), (png, 10.0, 10.0, (0.0, 0.0, 10.0, 10.0))])
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start:].startswith(b"xref\n0 9\n")
    for i, m in enumerate(re.finditer(rb"(\d{10}) 00000 n ", data[start:]), 1):
        assert data[int(m[1]) :].startswith(b"%d 0 obj" % i)
    for m in re.finditer(rb"/Length (\d+) >>\nstream\n", data):
        assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")
    assert b"/Count 2" in data and b"50.0000 0 0 50.0000 25.0000 0.0000 cm" in data
