"""Registered queries over file formats: each writes bytes and reads them again, against SQL for what was written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.functions import raster
from quire.operators import convert, images, recognition
from quire.plans.catalogue import _LINE_CELLS, ORACLES, _docs, _words, query
from quire.sources import office
from quire.sources import tables as src
from quire.workers import reach


@query(ORACLES["ocr_docx_paragraphs"])
def docx_roundtrip(spark, sf):
    """The recogniser's export as word-processor files, read back."""
    return office.docx_paragraphs(office.docx_files(recognition.paragraphs(recognition.page_records(_words(spark, sf)))))


@query(f"with {_LINE_CELLS} select doc_id, 'עמ'' ' || page || ' טקסט' as sheet, row, col, value from cells")
def xlsx_roundtrip(spark, sf):
    """Pages without tables as sheets of workbooks, read back."""
    cells = convert.line_cells(src.doc_pages(_docs(spark, sf)))
    named = cells.select("doc_id", convert.sheet_name(F.col("page"), F.col("tbl")).alias("sheet"), F.col("page").alias("at"), F.lit(False).alias("header"), "row", "col", "value")
    widths = convert.column_widths(cells).select("doc_id", convert.sheet_name(F.col("page"), F.col("tbl")).alias("sheet"), "col", "width")
    return office.xlsx_cells(office.xlsx_files(named, widths))


def _flat(w: pd.Series, h: pd.Series, key: pd.Series) -> pd.Series:
    """PNG files of one colour each."""
    return pd.Series([raster.to_png(np.full((b, a, 3), (k % 256, k % 128, k % 64), np.uint8)) for a, b, k in zip(w, h, key, strict=True)])


def _pictures(spark, sf):
    reach(spark)
    make = F.pandas_udf(_flat, "binary")
    rows = src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 + 1).cast("long").alias("w"), (F.col("p_partkey") % 5 + 1).cast("long").alias("h"))
    return rows.select("id", make("w", "h", "id").alias("content"))


_SIZES = "pics as (select p_partkey as id, cast(p_size % 7 + 1 as bigint) as w, cast(p_partkey % 5 + 1 as bigint) as h from part)"


@query(f"with {_SIZES} select id, 'png' as format, w as width, h as height, 'RGB' as mode, cast(null as varchar) as error from pics")
def image_info(spark, sf):
    return images.info(_pictures(spark, sf))


@query(f"""with {_SIZES}, c as (select id, case when greatest(w, h) <= 4 then w else cast(trunc(w * (4::double / greatest(w, h))) as bigint) end as w, case when greatest(w, h) <= 4 then h else cast(trunc(h * (4::double / greatest(w, h))) as bigint) end as h from pics)
select id, case when id % 2 = 0 then w else h end as width, case when id % 2 = 0 then h else w end as height, cast(((id % 256) * 19595 + (id % 128) * 38470 + (id % 64) * 7471 + 32768) // 65536 as bigint) as level from c where w > 0 and h > 0""")
def image_prepared(spark, sf):
    """Images of one colour made ready for a recogniser, with a longest side of 4 and every other one turned."""
    done = images.prepared(_pictures(spark, sf).withColumn("angle", F.when(F.col("id") % 2 == 1, 90)), 4)

    def level(content: pd.Series) -> pd.Series:
        pixels = [raster.from_png(x) for x in content]
        return pd.Series([(p.shape[1], p.shape[0], int(p.max())) for p in pixels]).apply(pd.Series).set_axis(["width", "height", "level"], axis=1)

    made = F.pandas_udf(level, "width long, height long, level long")
    return done.where("content is not null").select("id", made("content").alias("p")).select("id", "p.*")


_NAMED = "['fit', 'A4', 'Letter', 'other']"


@query(f"""with {_SIZES}, p as (select id // 10 as out_id, id, w * 72.0 / 96 as w, h * 72.0 / 96 as h, {_NAMED}[id % 4 + 1] as s from pics)
select out_id, row_number() over (partition by out_id order by id) as page, cast(round(case s when 'fit' then w when 'Letter' then 612 else 595 end, 4) as double) as width, cast(round(case s when 'fit' then h when 'Letter' then 792 else 842 end, 4) as double) as height from p""")
def images_pdf(spark, sf):
    """Ten images to a PDF, read back as its page sizes."""
    p = _pictures(spark, sf)
    sizes = images.info(p).select("id", "width", "height")
    rows = p.join(sizes, "id").select(F.floor(F.col("id") / 10).cast("long").alias("out_id"), F.col("id").alias("ordinal"), "content", "width", "height", F.expr("element_at(array('fit', 'A4', 'Letter', 'other'), cast(id % 4 as int) + 1)").alias("page_size"))
    return images.pdf_pages(images.to_pdf(images.placed(rows)))


@query(f"with {_SIZES} select id as out_id, cast(1 as bigint) as page, cast(round(w * 72.0 / 150, 4) as double) as width, cast(round(h * 72.0 / 150, 4) as double) as height from pics")
def image_pdf(spark, sf):
    """Each image as a document of its own."""
    p = _pictures(spark, sf)
    rows = p.join(images.info(p).select("id", "width", "height"), "id").select(F.col("id").alias("out_id"), F.lit(1).alias("ordinal"), "content", "width", "height")
    return images.pdf_pages(images.to_pdf(images.single(rows)))
