"""Images as files: sizes from headers, preparation for a recogniser, pages of a PDF.

Pixels are worked on in Arrow batches at the edge of the plan; sizes and boxes are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import layout, raster
from quire.workers import reach

#: Dots in an inch of a page made from a single image.
DPI = 150


def info(files: DataFrame) -> DataFrame:
    """files (id, content) with format, width, height and mode from the header, and error where it isn't known."""
    reach(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, content in zip(b["id"], b["content"], strict=True):
                try:
                    rows.append((i, *raster.size(content), None))
                except Exception as e:  # one file's fault
                    rows.append((i, None, None, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["id", "format", "width", "height", "mode", "error"])
            yield out.astype({"width": "Int64", "height": "Int64"})

    return files.select("id", "content").mapInPandas(run, "id long, format string, width long, height long, mode string, error string")


def prepared(files: DataFrame, most: int = raster.LONGEST) -> DataFrame:
    """files (id, content, angle: as the recogniser's orientation model reports it, null for none) as grey PNG files of
    more contrast and sharpness: id, content, error."""
    reach(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, content, angle in zip(b["id"], b["content"], b["angle"], strict=True):
                try:
                    rows.append((i, raster.to_png(raster.prepare(raster.from_png(content), 0 if pd.isna(angle) else int(angle), most)), None))
                except Exception as e:  # one file's fault
                    rows.append((i, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", "content", "error"])

    return files.select("id", "content", "angle").mapInPandas(run, "id long, content binary, error string")


def placed(images: DataFrame) -> DataFrame:
    """images (width, height in pixels, page_size) with the page's page_w and page_h in points and the image's box on it:
    a page of size "fit" is as large as its image, any other is a named size or else A4."""
    w, h = layout.points(F.col("width")), layout.points(F.col("height"))
    side = lambda i: F.coalesce(*[F.when(F.col("page_size") == name, F.lit(float(s[i]))) for name, s in layout.PAGE_SIZES.items()], F.lit(float(layout.PAGE_SIZES["A4"][i])))
    rows = images.withColumns({"page_w": F.when(F.col("page_size") == "fit", w).otherwise(side(0)), "page_h": F.when(F.col("page_size") == "fit", h).otherwise(side(1))})
    return rows.withColumn("box", layout.fit_rect(w, h, F.col("page_w"), F.col("page_h")))


def single(images: DataFrame) -> DataFrame:
    """The same for an image that becomes a document by itself: DPI pixels to an inch, the whole page."""
    rows = images.withColumns({"page_w": F.col("width") * 72 / DPI, "page_h": F.col("height") * 72 / DPI})
    return rows.withColumn("box", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("page_w").alias("x1"), F.col("page_h").alias("y1")))


def to_pdf(images: DataFrame) -> DataFrame:
    """out_id, content: a PDF of the images (out_id, ordinal, content, page_w, page_h, box) of each out_id, in order."""
    reach(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [raster.pdf_of_images([(x["content"], x["page_w"], x["page_h"], tuple(x["box"][k] for k in ("x0", "y0", "x1", "y1"))) for x in pages]) for pages in b["pages"]]
            yield pd.DataFrame({"out_id": b["out_id"], "content": made})

    rows = images.groupBy("out_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content", "page_w", "page_h", "box"))).alias("pages"))
    return rows.mapInPandas(run, "out_id long, content binary")


def pdf_pages(files: DataFrame) -> DataFrame:
    """out_id, page, width, height of PDF files as to_pdf() makes them, by their uncompressed page objects."""
    reach(files.sparkSession)
    box = re.compile(rb"/Type /Page /Parent [^\n]*?/MediaBox \[0 0 ([0-9.]+) ([0-9.]+)\]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, float(m[1]), float(m[2])) for i, c in zip(b["out_id"], b["content"], strict=True) for n, m in enumerate(box.finditer(c), 1)]
            yield pd.DataFrame(rows, columns=["out_id", "page", "width", "height"])

    return files.mapInPandas(run, "out_id long, page long, width double, height double")
