"""Relations behind the office exports: sheets, cells, column widths, slides, translated blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import layout, text

# A sheet title's length and parts, and the only sheet of a workbook without any other.
SHEET_CHARS = 31
SHEET, TEXT_SHEET, TABLE_SHEET = "עמ' ", " טקסט", " טבלה "
EMPTY_SHEET, EMPTY_VALUE = "ריק", "לא נמצאו טבלאות"
# Languages that text may be translated to, and those written from right to left.
LANGUAGES = {
    "iw": "עברית", "en": "English", "ar": "العربية", "ru": "Русский", "fr": "Français", "de": "Deutsch", "es": "Español", "it": "Italiano", "pt": "Português", "zh": "中文",
    "ja": "日本語", "ko": "한국어", "tr": "Türkçe", "pl": "Polski", "nl": "Nederlands", "uk": "Українська", "ro": "Română", "sv": "Svenska", "fi": "Suomi", "da": "Dansk",
    "cs": "Čeština", "hu": "Magyar", "el": "Ελληνικά", "th": "ภาษาไทย", "vi": "Tiếng Việt", "id": "Bahasa Indonesia", "ms": "Bahasa Melayu", "fa": "فارسی", "hi": "हिन्दी", "bn": "বাংলা",
}
RTL = ["iw", "he", "ar", "fa", "ur", "yi"]


def table_cells(tables: DataFrame) -> DataFrame:
    """doc_id, page, tbl, row, col, value of tables (doc_id, page, tables: array of tables of rows of nullable cells);
    a null cell is empty."""
    t = tables.select("doc_id", "page", F.posexplode("tables").alias("tbl", "rows")).select("doc_id", "page", "tbl", F.posexplode("rows").alias("row", "cells"))
    t = t.select("doc_id", "page", "tbl", "row", F.posexplode("cells").alias("col", "value"))
    return t.select("doc_id", "page", *[(F.col(c) + 1).cast("long").alias(c) for c in ("tbl", "row", "col")], F.coalesce("value", F.lit("")).alias("value"))


def line_cells(pages: DataFrame) -> DataFrame:
    """The same for pages without tables: each line of text is a row of one cell."""
    rows = pages.select("doc_id", "page", F.posexplode(text.lines(F.col("text"))).alias("row", "value"))
    return rows.select("doc_id", "page", F.lit(0).cast("long").alias("tbl"), (F.col("row") + 1).cast("long").alias("row"), F.lit(1).cast("long").alias("col"), "value")


def sheet_name(page, tbl):
    """A sheet's title: the page, the table's number from the second on; a page's text has one of its own."""
    base = F.concat(F.lit(SHEET), page.cast("string"))
    return F.substring(F.when(tbl == 0, F.concat(base, F.lit(TEXT_SHEET))).when(tbl > 1, F.concat(base, F.lit(TABLE_SHEET), tbl.cast("string"))).otherwise(base), 1, SHEET_CHARS)


def column_widths(cells: DataFrame) -> DataFrame:
    """doc_id, page, tbl, col, width of the tables' sheets: the longest value and 4 more, 60 at most; of 10 characters
    where no cell has a value. A page's text (table 0) has no widths of its own."""
    width = F.least(F.coalesce(F.max(F.length("value")), F.lit(10)) + 4, F.lit(60)).cast("long")
    return cells.where("tbl > 0").groupBy("doc_id", "page", "tbl", "col").agg(width.alias("width"))


def empty_workbooks(documents: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, sheet, row, col, value of the documents that have no cell: a workbook needs a sheet."""
    one = F.lit(1).cast("long")
    rows = documents.select("doc_id").join(cells.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.select("doc_id", F.lit(EMPTY_SHEET).alias("sheet"), one.alias("row"), one.alias("col"), F.lit(EMPTY_VALUE).alias("value"))


def slides(pages: DataFrame) -> DataFrame:
    """doc_id, page, width_emu, height_emu: every slide has the first page's size. The first page is found by
    aggregation, so no document's pages have to meet in a window."""
    size = F.struct(layout.emu(F.col("width_pt")).alias("w"), layout.emu(F.col("height_pt")).alias("h"))
    first = pages.groupBy("doc_id").agg(F.min_by(size, "page").alias("s"))
    return pages.select("doc_id", "page").join(first, "doc_id").select("doc_id", "page", F.col("s.w").alias("width_emu"), F.col("s.h").alias("height_emu"))


def translatable(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block, text) worth translating: two characters or more once stripped."""
    return blocks.withColumn("text", text.strip(F.col("text"))).where(F.length("text") >= 2)


def translate(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """Blocks with their translation. translated: text, translation, one row for each distinct text, so that a repeated
    text costs one call; a missing, empty or unchanged translation leaves the block as it is. Rows meet by a digest of
    the text, so that translations move without it; a very common line is a skewed key of a join that Spark can split."""
    rows = blocks.withColumn("_digest", F.sha2("text", 256)).join(translated.select(F.sha2("text", 256).alias("_digest"), "translation"), "_digest", "left").drop("_digest")
    new = (F.coalesce("translation", F.lit("")) != "") & (F.col("translation") != F.col("text"))
    return rows.withColumn("changed", F.coalesce(new, F.lit(False))).withColumn("result", F.when(new, F.col("translation")).otherwise(F.col("text"))).drop("translation")


def distinct_chunks(texts: DataFrame) -> DataFrame:
    """The distinct slices to send to a translator."""
    return texts.select(F.explode(text.chunks(F.col("text"))).alias("chunk")).distinct()


def numbered_tables(cells: DataFrame) -> DataFrame:
    """doc_id, page, tbl, sheet of each table, numbered within its page."""
    t = cells.select("doc_id", "page", "tbl").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("tbl")).cast("long")
    return t.withColumn("n", n).select("doc_id", "page", "tbl", sheet_name(F.col("page"), F.col("n")).alias("sheet"))


def known_language(code: str) -> bool:
    return code in LANGUAGES or code == "auto"


def valid_language(code):
    return F.coalesce(code.isin(*LANGUAGES, "auto"), F.lit(False))
