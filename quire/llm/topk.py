"""Exact top-k by inner product with a vector-approximation file.

Vectors become integers, floor(scale * x). The file holds, for each distinct vector, one byte for each component: the
number of its cell between the component's least and greatest value. A query's inner product with a vector lies between
two bounds that the cells give. The scan of the file keeps for each query the vectors whose upper bound reaches the k-th
best lower bound; exact vectors are then read in the order of upper bounds, which is that of lower distance bounds: the
first k, whose k-th score is the bar, then those whose upper bound reaches the bar. All others are certain to score less.

Queries and file are dealt out in blocks, each pair of blocks a cell of work with at most QUERY_BLOCK and FILE_BLOCK
rows. Equal vectors are one entry of the file with their k + 1 smallest ids: no query can use more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

K, SCALE = 10, 1024
CELLS = 256
QUERY_BLOCK, FILE_BLOCK = 1024, 8192
#: Shares in which a query's candidates are ranked first.
SALTS = 16


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector as array<long>. Vectors that are null, hold null or a non-finite component, have no
    component or no vec_id, take no part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    odd = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(fit & ~F.coalesce(odd, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(whole, lambda x: F.floor(x * scale)).alias("v"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: entry (the least id), v, and ids, the k + 1 smallest; ranks are cut before and after the
    exchange, so a vector of many copies moves k + 1 rows of each task."""
    least = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_rank") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("entry"), "v", "ids")


def _stack(column: pa.Array, dims: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, dims)


def approximate(entries: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """entry and code, a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _stack(b.column("v"), len(low), np.int64)
            codes = ((v - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("entry"), pa.array([x.tobytes() for x in codes], pa.binary())], ["entry", "code"])

    return entries.select("entry", "v").mapInArrow(run, "entry long, code binary")


def bounds(query: np.ndarray, code: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, vectors) of inner products. A component in cell c lies between low + c * width
    and width - 1 more. Sums below 2**53 are exact as doubles; beyond that the bounds are widened by what rounding can do."""
    q, cells = query.astype(np.float64), (low + code * width).astype(np.float64)
    middle = q @ cells.T
    spread = (width - 1).astype(np.float64)
    lower, upper = middle + (np.minimum(q, 0) @ spread)[:, None], middle + (np.maximum(q, 0) @ spread)[:, None]
    size = np.abs(q) @ (np.abs(cells).max(axis=0, initial=0) + spread)
    if len(size) and size.max() >= 2**53:
        slack = (size * (2 * q.shape[1] + 4) * 2.0**-52)[:, None]
        lower, upper = lower - slack, upper + slack
    return lower, upper


def best(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each query_id in an order. Rows are ranked in SALTS shares of a query before they meet, so that
    a query with very many rows is the work of many tasks, and n * SALTS of them at most meet in one."""
    share = F.pmod(F.xxhash64(F.struct(*[c for c in rows.columns if c != "query_id"])), F.lit(SALTS))
    rows = rows.withColumn("_share", share)
    for by in (["query_id", "_share"], ["query_id"]):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n)
    return rows.drop("_share")


def scan(queries: DataFrame, file: DataFrame, low: np.ndarray, width: np.ndarray, k: int, n_queries: int, n_file: int) -> DataFrame:
    """query_id, entry, lower, upper of the entries that a cell of work can't rule out. One entry may be the query's
    own vector alone, so k + 1 of them make the bar."""
    across, down = -(-n_queries // QUERY_BLOCK), -(-n_file // FILE_BLOCK)
    across, down = max(across, 1), max(down, 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col("vec_id").alias("id"), F.col("v").alias("v"), F.lit(None).cast("binary").alias("code"), deal("vec_id", across).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"))
    f = file.select(F.col("entry").alias("id"), F.lit(None).cast("array<bigint>").alias("v"), "code", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), deal("entry", down).alias("j"))

    def cell(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("code").is_null())
        empty = pa.table({"query_id": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "lower": pa.array([], pa.float64()), "upper": pa.array([], pa.float64())})
        ids = np.array(table.column("id"))
        if is_query.all() or not is_query.any():
            return empty
        v = _stack(table.column("v").combine_chunks().filter(pa.array(is_query)), len(low), np.int64)
        code = np.frombuffer(b"".join(table.column("code").combine_chunks().drop_null().to_pylist()), np.uint8).reshape(-1, len(low)).astype(np.int64)
        qid, eid = ids[is_query], ids[~is_query]
        out = []
        for s in range(0, len(qid), 64):
            lower, upper = bounds(v[s : s + 64], code, low, width)
            bar = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)] if lower.shape[1] > k + 1 else np.full(len(lower), -np.inf)
            a, b = np.nonzero(upper >= bar[:, None])
            out.append((qid[s : s + 64][a], eid[b], lower[a, b], upper[a, b]))
        return pa.table(dict(zip(("query_id", "entry", "lower", "upper"), map(np.concatenate, zip(*out)))))

    return q.unionByName(f).repartition(partitions(file), "i", "j").groupBy("i", "j").applyInArrow(cell, "query_id long, entry long, lower double, upper double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest inner products of each query with all rows of `vectors`
    but the one with its own id; ties go to the smaller vec_id, fewer rows give fewer results.

    Both tables have vec_id and embedding, all of one length; other columns are not looked at. Vectors that are null or
    hold a null or non-finite component take no part, nor do rows without a vec_id. Rows with equal vec_id count once for
    each distinct vector. An empty table on either side gives no rows. Components so large that an inner product might
    not fit in 64 bits are an error.
    """
    rows, asked = integers(vectors, scale).distinct(), stored(integers(queries, scale).distinct(), "queries")
    entries = stored(_entries(rows, k), "vectors")
    dims = entries.select(F.size("v").alias("n")).agg(F.min("n"), F.max("n")).first()
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if dims[0] is None or asked.isEmpty():
        return none
    if dims[0] != dims[1]:
        raise ValueError("vectors of different lengths")
    ends = entries.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("p").collect()
    low, high = (np.array([r[k] for r in ends], np.int64) for k in ("low", "high"))
    most = asked.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    if max(int(most), *map(abs, [*low.tolist(), *high.tolist()])) ** 2 * len(low) >= 2**62:
        raise ValueError("components are too large: inner products would not fit in 64 bits")
    width = (high - low) // CELLS + 1
    file = stored(approximate(entries, low, width), "approximation")
    left = stored(scan(asked, file, low, width, k, asked.count(), file.count()), "scan")
    # over all cells: the bar is the (k+1)-th best lower bound, or the least where there are fewer
    bar = best(left.select("query_id", "entry", "lower"), k + 1, F.desc("lower"), "entry").groupBy("query_id").agg(F.min("lower").alias("_bar"))
    left = stored(left.join(bar, "query_id").where(F.col("upper") >= F.col("_bar")).select("query_id", "entry", "upper"), "candidates")

    def read(some: DataFrame) -> DataFrame:
        """The exact scores of candidates."""
        both = some.join(entries, "entry").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
        return both.select("query_id", "entry", "ids", dot.alias("score"))

    first = stored(read(best(left, k + 1, F.desc("upper"), "entry").select("query_id", "entry")), "first")
    bar = first.groupBy("query_id").agg(F.min("score").alias("bar"))
    others = left.join(bar, "query_id").where(F.col("upper") >= F.col("bar")).join(first.select("query_id", "entry"), ["query_id", "entry"], "left_anti")
    scored = first.unionByName(read(others.select("query_id", "entry"))).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = best(scored, k, F.desc("score"), "vec_id")
    return final.select("query_id", F.col("_rank").alias("rank"), "vec_id", "score")
