"""Queries against plain functions of whole tables and whole texts."""

import duckdb

from quire.functions.text import TRANSLATE_CHARS
from quire.plans import catalogue, service


def _texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


def test_every_page_is_translated(spark, sf, duck):
    pages = {(d, i + 1) for d, t in _texts(duck).items() for i in range((max(len(t), 1) - 1) // 1000 + 1) if t[i * 1000 : i * 1000 + 1000].strip()}
    assert {(r["doc_id"], r["page"]) for r in service.translate_clean(spark, sf).select("doc_id", "page").collect()} == pages
    assert max(p for _, p in pages) > 2


def test_long_blocks_have_overlays(spark, tmp_path):
    def tr(x):
        parts = service._stub_slices([x[i : i + TRANSLATE_CHARS] for i in range(0, len(x), TRANSLATE_CHARS)])
        return None if None in parts else " ".join(parts)

    path = f"{tmp_path}/documents.parquet"
    lengths = [4500, 4501, 4502, 4507, 9001, 9003, 13_502, 13_510]
    spark.createDataFrame([(i, "short line\n" + f"{i} word "[:5] * 3000) for i in range(3)] + [(10 + n, ("ab" * n)[:n] + "\nb") for n in lengths], "doc_id long, text string").coalesce(1).write.parquet(path)
    blocks = {(r["doc_id"], k + 1): x.strip() for r in spark.read.parquet(path).collect() for k, x in enumerate(r["text"].split("\n")) if len(x.strip()) >= 2}
    want = {k: tr(x) for k, x in blocks.items() if tr(x) not in (None, x)}
    got = {(r["doc_id"], r["block"]): r["result"] for r in service.translate_overlay(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    sql = {(d, k): x for d, k, x in con.execute(f"select doc_id, block, result from ({catalogue.ORACLES['translate_overlay']})").fetchall()}
    assert got == want == sql and sum(len(blocks[k]) > TRANSLATE_CHARS for k in got) > 4


def test_every_language_code_is_checked(spark, sf, duck):
    got = {r["doc_id"]: r["valid"] for r in catalogue.language_validation(spark, sf).collect()}
    assert got == {d: d % 5 != 1 for d in _texts(duck)}


def test_layer_has_whole_pages(spark, sf, duck):
    got = {(r["doc_id"], r["page"]): r["text"] for r in catalogue.searchable_layer(spark, sf).collect()}
    want = {}
    for d, t in _texts(duck).items():
        for i in range((max(len(t), 1) - 1) // 1000 + 1):
            x = t[i * 1000 : i * 1000 + 1000]
            x = x if d % 2 else "  " if (i + 1) % 3 == 0 else "OCR " + x
            want |= {(d, i + 1): x} if x.strip() else {}
    assert got == want and max(map(len, got.values())) > 40
