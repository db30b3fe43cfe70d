"""Pipeline stages: each takes (spark, docs, sf_dir) and, but for the last, returns the columns of documents, whatever
their names. An empty table stays empty; texts of any length are read whole; a null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import neardup
from . import packing as _packing
from . import pii as _pii
from . import quality as _quality
from . import toxicity as _toxicity
from .common import stored, table  # noqa: F401  stored is for the pipeline


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the learned list reject, so without null and empty texts. Repeated rows
    are judged alike and stay repeated; rows without a doc_id are judged like all others."""
    return _quality.keep(docs, _quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic; a score of exactly 0.5 is. Repeated rows are judged alike and stay repeated."""
    return _toxicity.keep(docs, _toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the least doc_id. Of rows repeated with id and set of shingles one stays;
    rows without a doc_id all stay, as do texts without words, one for each doc_id."""
    return neardup.keep(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind; a null text stays null."""
    return _pii.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, with each piece's ids; a null or empty text is its end id alone, and each of
    repeated rows is packed for itself."""
    return _packing.pack(docs)
