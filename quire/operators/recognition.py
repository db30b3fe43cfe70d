"""What happens to a recogniser's words: filters, confidences, page and document records, exports.

Words come as parallel arrays (words, conf) for each page and stay so; filters are higher-order functions on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

NATIVE_CHARS, LEAST_WORD = 50, 20
# Headings of exports.
PAGE, TITLE = "עמוד ", "OCR"


def good_words(words: Column, conf: Column) -> Column:
    """Words that aren't blank and have a confidence above LEAST_WORD."""
    pairs = F.filter(F.arrays_zip(words.alias("w"), conf.alias("c")), lambda x: x["w"].rlike(text.NOT_BLANK) & (x["c"] > LEAST_WORD))
    return F.transform(pairs, lambda x: x["w"])


def _thousandths(total: Column, n: Column) -> Column:
    """total / n rounded half up to a whole number, in whole numbers, so that no tie hangs on a binary fraction."""
    return F.floor((2 * total + n) / (2 * n)).cast("double") / 1000


def confidence(conf: Column) -> Column:
    """Mean of the confidences above 0, as a share to three places; 0 if there is none."""
    some = F.filter(conf, lambda c: c > 0)
    total = F.aggregate(some, F.lit(0).cast("long"), lambda a, c: a + c)
    return F.when(F.size(some) == 0, F.lit(0.0)).otherwise(_thousandths(10 * total, F.size(some)))


def page_records(words: DataFrame) -> DataFrame:
    """doc_id, page, text, confidence, source = ocr."""
    return words.select("doc_id", "page", F.array_join(good_words(F.col("words"), F.col("conf")), " ").alias("text"), confidence(F.col("conf")).alias("confidence"), F.lit("ocr").alias("source"))


def native_records(pages: DataFrame) -> DataFrame:
    """Records of the pages whose own text is long enough to need no recogniser."""
    plain = text.strip(F.col("text"))
    return pages.where(F.length(plain) > NATIVE_CHARS).select("doc_id", "page", plain.alias("text"), F.lit(1.0).alias("confidence"), F.lit("native").alias("source"))


def needs_recogniser(pages: DataFrame) -> DataFrame:
    return pages.where(F.length(text.strip(F.coalesce("text", F.lit("")))) <= NATIVE_CHARS)


def routed(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Native records, and recogniser records for all other pages; the two branches are filtered before the costly one
    runs, which a conditional expression would not promise."""
    return native_records(pages).unionByName(page_records(words.join(needs_recogniser(pages).select("doc_id", "page"), ["doc_id", "page"], "left_semi")))


def document_records(records: DataFrame) -> DataFrame:
    """doc_id, text (pages in order, an empty line between), confidence (mean of the pages' rounded ones), page_count."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    return records.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), _thousandths(F.sum(F.round(F.col("confidence") * 1000).cast("long")), F.count("*")).alias("confidence"), F.count("*").alias("page_count"))


def text_export(records: DataFrame) -> DataFrame:
    """doc_id and the lines of a text file: a heading for each page, its text, an empty line."""
    block = F.concat(F.lit("=== " + PAGE), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text"), F.lit("\n"))
    parts = F.sort_array(F.collect_list(F.struct("page", block.alias("block"))))
    return records.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n").alias("content"))


def paragraphs(records: DataFrame) -> DataFrame:
    """doc_id, seq, style, text: a word-processor export as ordered paragraphs - a title, then for each page a heading,
    its lines and a blank one."""
    body = F.transform(text.lines(F.col("text")), lambda x: F.struct(F.lit("Body").alias("style"), x.alias("text")))
    head = F.array(F.struct(F.lit("Heading 2").alias("style"), F.concat(F.lit(PAGE), F.col("page").cast("string")).alias("text")))
    blank = F.array(F.struct(F.lit("Body").alias("style"), F.lit("").alias("text")))
    pages = records.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", F.concat(head, body, blank).alias("items")))).alias("p"))
    title = F.array(F.struct(F.lit("Heading 1").alias("style"), F.lit(TITLE).alias("text")))
    rows = pages.select("doc_id", F.posexplode(F.concat(title, F.flatten(F.transform("p", lambda x: x["items"])))).alias("seq", "item"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "item.style", "item.text")
