"""Translation of pages in two layouts, with the engine as a function at the edge of the plan.

Every distinct slice of text is sent once, however often it stands in the documents. An engine is a function from a
list of texts to a list of translations, None where one failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import layout, text
from quire.operators import convert
from quire.workers import reach

Engine = Callable[[list[str]], list[str | None]]


def translate_texts(texts: DataFrame, engine: Engine) -> DataFrame:
    """text, translation of the distinct `text`s: slices go to the engine, a text's translations are joined by one
    space, and one failed slice makes the whole translation null."""
    reach(texts.sparkSession)
    whole = texts.select("text").distinct()
    cut = whole.select("text", F.posexplode(text.chunks(F.col("text"))).alias("pos", "chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk": b["chunk"], "translated": engine(b["chunk"].tolist())})

    done = cut.select("chunk").distinct().mapInPandas(run, "chunk string, translated string")
    slices = cut.select("text", "pos", F.sha2("chunk", 256).alias("_digest"))
    rows = slices.join(done.select(F.sha2("chunk", 256).alias("_digest"), "translated"), "_digest").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("pos", "translated"))).alias("parts"))
    failed = F.exists("parts", lambda p: p["translated"].isNull())
    return rows.select("text", F.when(~failed, F.array_join(F.transform("parts", lambda p: p["translated"]), " ")).alias("translation"))


def _turned(column, target: str):
    return text.display(column, target) if target in convert.RTL else column


def overlay(blocks: DataFrame, engine: Engine, target: str) -> DataFrame:
    """Overlays over blocks (doc_id, page, block, text, y0, y1) whose text changed: the translation, its font size and
    alignment. All pages stay; a block without a translation has no overlay."""
    some = convert.translatable(blocks)
    rows = convert.translate(some, translate_texts(some, engine)).where("changed")
    n_lines = F.size(F.split("result", "\n"))
    align = F.lit("right" if target in convert.RTL else "left")
    return rows.select("doc_id", "page", "block", _turned(F.col("result"), target).alias("result"), layout.overlay_font_size(F.col("y1") - F.col("y0"), n_lines).alias("font_size"), align.alias("align"))


def translate(pages: DataFrame, blocks: DataFrame, engine: Engine, target: str, keep_layout: bool = True) -> DataFrame:
    """A document in another language: overlays on its blocks where the layout is kept, whole pages of text where not."""
    if not convert.known_language(target):
        raise ValueError(f"unknown language {target}")
    return overlay(blocks, engine, target) if keep_layout else clean(pages, engine, target)


def clean(pages: DataFrame, engine: Engine, target: str) -> DataFrame:
    """doc_id, page, text: whole pages in the other language, the original where the engine failed. Pass the selected
    pages alone: only they are kept."""
    rows = pages.withColumn("text", text.strip(F.col("text"))).where("text <> ''")
    done = convert.translate(rows, translate_texts(rows, engine))
    return done.select("doc_id", "page", _turned(F.col("result"), target).alias("text"))
