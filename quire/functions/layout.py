"""Arithmetic on pages and boxes, in points unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page sizes in points.
PAGE_SIZES = {"A4": (595, 842), "Letter": (612, 792), "Legal": (612, 1008), "A3": (842, 1190)}
# Bits of the PDF permission mask.
PERMISSIONS = {"accessibility": 512, "print": 4, "print_hq": 2048, "copy": 16, "modify": 8, "annotate": 32}
EMU_PER_INCH = 914400
# A text watermark's width of a character, an image watermark's edges, a signature's width, height and the
# places of its text and date, an overlay's least and greatest font and its share of a line.
MARK_CHAR = 0.3
MARK_EDGES = (0.3, 0.7)
SIGN_WIDTH, SIGN_HEIGHT, SIGN_LEFT, SIGN_TEXT, SIGN_DATE = 0.25, 40, 6, 30, 54
FONT_LEAST, FONT_MOST, FONT_SHARE = 7.0, 13.0, 0.75


def pixels(points: Column, dpi: Column) -> Column:
    return points * dpi / 72


def points(px: Column) -> Column:
    return px * F.lit(72.0) / 96


def emu(pt: Column) -> Column:
    return (pt / 72 * EMU_PER_INCH).cast("bigint")


def fit_rect(w: Column, h: Column, width: Column, height: Column) -> Column:
    """Where a w x h box lies in a page of width x height, scaled to fit (also up) and centred."""
    scale = F.least(width / w, height / h)
    left, top = (width - w * scale) / 2, (height - h * scale) / 2
    return F.struct(left.alias("x0"), top.alias("y0"), (left + w * scale).alias("x1"), (top + h * scale).alias("y1"))


def text_mark_anchor(width: Column, height: Column, font_size: Column, text: Column) -> Column:
    """Where a centred text watermark begins."""
    return F.struct((width / 2 - font_size * F.length(text) * MARK_CHAR).alias("x"), (height / 2).alias("y"))


def image_mark_rect(width: Column, height: Column) -> Column:
    """The centred box of an image watermark: two fifths of the page each way."""
    low, high = MARK_EDGES
    return F.struct((width * low).alias("x0"), (height * low).alias("y0"), (width * high).alias("x1"), (height * high).alias("y1"))


def signature(width: Column, height: Column, x: Column, y: Column) -> Column:
    """A signature box at the fractions x, y of the page, with the anchors of its text and of its date."""
    left, top = width * x, height * y
    box = [left.alias("x0"), top.alias("y0"), (left + width * SIGN_WIDTH).alias("x1"), (top + SIGN_HEIGHT).alias("y1")]
    return F.struct(*box, (left + SIGN_LEFT).alias("text_x"), (top + SIGN_TEXT).alias("text_y"), (left + SIGN_LEFT).alias("date_x"), (top + SIGN_DATE).alias("date_y"))


def signature_page(page: Column, n: Column) -> Column:
    """0-based page to sign: -1 is the last, all others are clamped."""
    return F.when(page == -1, n - 1).otherwise(F.greatest(F.lit(0), F.least(page - 1, n - 1)))


def overlay_font_size(height: Column, n_lines: Column) -> Column:
    return F.greatest(F.lit(FONT_LEAST), F.least(height / n_lines * FONT_SHARE, F.lit(FONT_MOST)))


def capped_size(w: Column, h: Column, most: int = 3000) -> Column:
    """Image size with its longer side at `most`, cut to whole pixels."""
    ratio = F.lit(float(most)) / F.greatest(w, h)
    big = F.greatest(w, h) > most
    return F.struct(F.when(big, F.floor(w * ratio)).otherwise(w).cast("bigint").alias("w"), F.when(big, F.floor(h * ratio)).otherwise(h).cast("bigint").alias("h"))


def rgb(colour: Column) -> Column:
    """#rrggbb as three shares of one."""
    h = F.regexp_replace(colour, "^#", "")
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def permissions(allow_print: Column, allow_copy: Column, allow_edit: Column) -> Column:
    p = PERMISSIONS
    flag = lambda allowed, value: F.when(allowed, F.lit(value)).otherwise(F.lit(0))
    return F.lit(p["accessibility"]) + flag(allow_print, p["print"] + p["print_hq"]) + flag(allow_copy, p["copy"]) + flag(allow_edit, p["modify"] + p["annotate"])
