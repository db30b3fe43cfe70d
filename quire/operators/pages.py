"""Operators on pages(doc_id, page, text, ...): merge, split, select, rotate, stamp, redact, describe.

A document is its pages in order. Requests are tables too, so one plan serves any number of documents. Joins are by
doc_id and page; numbers run over documents, not pages, wherever that suffices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout, text

# Fixed value: what stands between the pages of a document's text.
PAGE_BREAK = "\n\n--- עמוד חדש ---\n\n"
#: Rows that one task numbers in running_total().
BLOCK = 65_536


def running_total(df: DataFrame, key: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of `value` over all rows of the same key with a lesser `order` (a whole number, unique in its
    key). Sums go over blocks of order first, so a hot key is numbered by many tasks."""
    df = df.withColumn("_block", F.floor(F.col(order) / block))
    per = df.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    per = per.select(key, "_block", (F.sum("_sum").over(Window.partitionBy(key).orderBy("_block")) - F.col("_sum")).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(key, "_block").orderBy(order)) - F.col(value)
    return df.withColumn("_inside", inside).join(per, [key, "_block"]).withColumn(name, F.col("_base") + F.col("_inside")).drop("_block", "_inside", "_base")


def merge(sizes: DataFrame, request: DataFrame) -> DataFrame:
    """out_id, out_page, doc_id, page: documents put after one another. request: out_id, ordinal, doc_id, where a
    document may come twice; sizes: doc_id, n_pages."""
    parts = running_total(request.join(sizes, "doc_id"), "out_id", "ordinal", "n_pages", "before")
    rows = parts.select("out_id", "doc_id", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"))).alias("page"))
    return rows.select("out_id", (F.col("before") + F.col("page")).alias("out_page"), "doc_id", "page")


def merge_checked(request: DataFrame, known: DataFrame) -> DataFrame:
    """out_id and error of each merge request that can't be met: fewer than 2 or more than 20 files, a file that isn't
    known, or one whose name doesn't end in .pdf. request: out_id, doc_id; known: doc_id, name."""
    rows = request.join(known, "doc_id", "left").groupBy("out_id").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("missing"), F.count_if(text.suffix(F.col("name")) != ".pdf").alias("odd"))
    error = F.when(~F.col("n").between(2, 20), "count").when(F.col("missing") > 0, "missing").when(F.col("odd") > 0, "suffix")
    return rows.select("out_id", "n", error.alias("error"))


def split_every(sizes: DataFrame, n: int) -> DataFrame:
    """doc_id, part, first, last: parts of n pages, the last one short."""
    part = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n_pages") / n)))
    return sizes.select("doc_id", "n_pages", part.alias("part")).select("doc_id", "part", ((F.col("part") - 1) * n + 1).alias("first"), F.least(F.col("part") * n, "n_pages").alias("last"))


def split_ranges(sizes: DataFrame, request: DataFrame) -> DataFrame:
    """doc_id, part, first, last, error (null, "value" or "empty") for each range of a request (doc_id, ranges: a text
    like "1-3, 5"). An empty range is an error of its own row; others of the document still stand."""
    rows = request.join(sizes, "doc_id").select("doc_id", "n_pages", F.posexplode(text.term_list(F.col("ranges"))).alias("part", "range"))
    r = rows.select("doc_id", (F.col("part") + 1).cast("long").alias("part"), text.page_range(F.col("range"), F.col("n_pages")).alias("r"))
    error = F.when(F.col("r.error"), "value").when(F.col("r.first") > F.col("r.last"), "empty")
    return r.select("doc_id", "part", "r.first", "r.last", error.alias("error"))


def _wanted(request: DataFrame, sizes: DataFrame, all_if_empty: bool) -> DataFrame:
    asked = text.number_list(F.col("pages"))
    every = F.sequence(F.lit(1).cast("long"), F.col("n_pages"))
    rows = request.join(sizes, "doc_id").withColumn("_list", F.when(F.size(asked) == 0, every).otherwise(asked) if all_if_empty else asked)
    inside = F.filter("_list", lambda p: (p >= 1) & (p <= F.col("n_pages")))
    return rows.select("doc_id", F.posexplode(inside).alias("ordinal", "page")).select("doc_id", (F.col("ordinal") + 1).cast("long").alias("ordinal"), "page")


def select_pages(request: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, ordinal, page of the pages that a request (doc_id, pages: a text like "3,1,3") names, in its order and
    with repeats; pages outside are left out, and a list without any number means all pages."""
    return _wanted(request, sizes, True)


def extract_pages(request: DataFrame, sizes: DataFrame) -> DataFrame:
    """As select_pages, but a list without any number gives no page."""
    return _wanted(request, sizes, False)


def rotate(pages: DataFrame, request: DataFrame, sizes: DataFrame, angle: int) -> DataFrame:
    """pages with `rotation` set (not added) to angle on the selected ones, else as it was, 0 where there was none."""
    if angle not in (90, 180, 270):
        raise ValueError("angle must be 90, 180 or 270")
    chosen = select_pages(request, sizes).select("doc_id", "page").distinct().withColumn("_chosen", F.lit(True))
    old = F.col("rotation") if "rotation" in pages.columns else F.lit(0)
    return pages.join(chosen, ["doc_id", "page"], "left").withColumn("rotation", F.when(F.col("_chosen"), angle).otherwise(old)).drop("_chosen")


def stamp(pages: DataFrame, chosen: DataFrame, kind: str, box: Column, **attributes: Column) -> DataFrame:
    """One overlay row for each time that a page is chosen: doc_id, page, kind, box, attributes. chosen: doc_id, page;
    a page chosen twice is stamped twice."""
    return chosen.join(pages, ["doc_id", "page"]).select("doc_id", "page", F.lit(kind).alias("kind"), box.alias("box"), *[v.alias(k) for k, v in attributes.items()])


def watermark_text(pages: DataFrame, chosen: DataFrame, mark: str, font_size: float, colour: str) -> DataFrame:
    """pages need width_pt and height_pt."""
    anchor = layout.text_mark_anchor(F.col("width_pt"), F.col("height_pt"), F.lit(font_size), F.lit(mark))
    return stamp(pages, chosen, "text", anchor, mark=F.lit(mark), colour=layout.rgb(F.lit(colour)))


def watermark_image(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return stamp(pages, chosen, "image", layout.image_mark_rect(F.col("width_pt"), F.col("height_pt")))


def sign(pages: DataFrame, sizes: DataFrame, request: DataFrame) -> DataFrame:
    """One visible signature for each request (doc_id, page, x, y): doc_id, page (from 1) and box."""
    at = request.withColumnRenamed("page", "_page").join(sizes, "doc_id")
    at = at.withColumn("page", layout.signature_page(F.col("_page"), F.col("n_pages")) + 1)
    rows = at.join(pages, ["doc_id", "page"])
    return rows.select("doc_id", "page", layout.signature(F.col("width_pt"), F.col("height_pt"), F.col("x"), F.col("y")).alias("box"))


def redact(pages: DataFrame, terms: list[str], case_sensitive: bool = False, request: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """pages with every term masked in `text`, and n_redacted. With a request and sizes, as select_pages has them, on the
    selected pages alone; the others stay as they are, as do those of documents that the request doesn't have."""
    new, count = text.redact(F.col("text"), terms, case_sensitive)
    others = [c for c in pages.columns if c != "text"]
    if request is None:
        return pages.select(*others, new.alias("text"), count.alias("n_redacted"))
    chosen = select_pages(request, sizes).select("doc_id", "page").distinct().withColumn("_chosen", F.lit(True))
    rows = pages.join(chosen, ["doc_id", "page"], "left")
    return rows.select(*others, F.when(F.col("_chosen"), new).otherwise(F.col("text")).alias("text"), F.when(F.col("_chosen"), count).otherwise(0).cast("long").alias("n_redacted"))


def totals(parts: DataFrame) -> DataFrame:
    """doc_id, total_parts, total_pages of parts (doc_id, first, last); an empty part has no pages."""
    return parts.groupBy("doc_id").agg(F.count("*").alias("total_parts"), F.sum(F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))).cast("long").alias("total_pages"))


def info(pages: DataFrame) -> DataFrame:
    """doc_id, page_count and pages, an array of (page, width_pt, height_pt) with sizes to two places."""
    sizes = F.struct("page", F.round("width_pt", 2).alias("width_pt"), F.round("height_pt", 2).alias("height_pt"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sort_array(F.collect_list(sizes)).alias("pages"))


def document_text(pages: DataFrame, separator: str = PAGE_BREAK) -> DataFrame:
    """doc_id, text and char_count: all pages' text in order."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    rows = pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), separator).alias("text"))
    return rows.withColumn("char_count", F.length("text").cast("long"))


def search_layer(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """One-point text overlays that make scanned pages searchable: doc_id, page, x, y, size, text. recognised: doc_id,
    page, seq, text; of two texts for a page the last counts, and blank ones give no overlay."""
    last = recognised.groupBy("doc_id", "page").agg(F.max_by("text", "seq").alias("text")).where(text.strip(F.col("text")) != "")
    at = pages.select("doc_id", "page").join(last, ["doc_id", "page"])
    return at.select("doc_id", "page", F.lit(10).alias("x"), F.lit(20).alias("y"), F.lit(1).alias("size"), "text")


def render_sizes(pages: DataFrame, chosen: DataFrame, dpi: int) -> DataFrame:
    """Pixel size of each page to render, with the output's number and name: doc_id, ordinal, page, width_px, height_px,
    name. chosen: as select_pages gives it."""
    rows = chosen.join(pages, ["doc_id", "page"])
    px = lambda c: F.ceil(layout.pixels(F.col(c), F.lit(dpi))).cast("long")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_page"), F.col("ordinal").cast("string"), F.lit(".png"))
    return rows.select("doc_id", "ordinal", "page", px("width_pt").alias("width_px"), px("height_pt").alias("height_px"), name.alias("name"))
