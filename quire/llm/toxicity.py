"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents whose label says toxic, outside the held-out fifth; unlabelled text is every document outside
it, whatever its label. A linear model over hashed words and word beginnings is fitted in numpy to the risk

    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))

whose second part estimates the risk on negatives and is kept from going below zero; where a step would take it there,
the step goes the other way. No negative label is read but for the prior. A feature is one of presence: how often a
word comes doesn't count, so long texts score like short ones.

The corpus stays on the executors. Features are chosen by their shares of the positives and of all unlabelled texts,
counted by aggregation. The unlabelled texts' rows of chosen features are dealt out at random to blocks of about BLOCK
rows; each block fits a classifier with all positives, and the model is the mean of the blocks' weights. The driver gets
counts and weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import pieces, reach, stored, texts

#: The fit looks at so many labelled positive documents at most, the first by a hash of doc_id.
POSITIVE = 4_000
#: Unlabelled rows in a block.
BLOCK = 32_768
#: Size of the hashed feature space, features kept, positives that a feature must come in, and by how many standard
#: errors and how many times its share of them must exceed that of unlabelled texts.
SPACE_BITS, FEATURES, SEEN, SIGNIFICANT, LIFT = 18, 1024, 3, 3.0, 2.0
PREFIXES = (4, 5, 6)
STEPS, RATE, DECAY = 400, 0.1, 1e-4
FOLDS = 5


def _hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words - the word and its first 4, 5 and 6 bytes - and the text that each stands in."""
    found, at = hashing.beginnings(array, None, *PREFIXES)
    row = np.repeat(np.arange(len(array)), np.diff(at))
    mask = np.uint64(2**SPACE_BITS - 1)
    return np.concatenate([hashing.mix(x + np.uint64(i)) & mask for i, x in enumerate(found)]).astype(np.int64), np.tile(row, len(found))


def _distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row << SPACE_BITS | feature)
    return both & (2**SPACE_BITS - 1), both >> SPACE_BITS


@dataclass
class Model:
    """Feature numbers with their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, array: pa.Array, lookup: np.ndarray) -> np.ndarray:
        feature, row = _hashes(array)
        some = lookup[feature] != 0
        feature, row = _distinct(feature[some], row[some])
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(row, lookup[feature], len(array)), -40, 40)))

    def lookup(self) -> np.ndarray:
        out = np.zeros(2**SPACE_BITS)
        out[self.feature] = self.weight
        return out


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves no rest when divided by FOLDS; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


BANDS, WIDTH = 6, 3
_TIMES = np.random.default_rng(11).integers(0, 2**63, BANDS * WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def bands(row: np.ndarray) -> np.ndarray:
    """BANDS * WIDTH least hashes of a row of distinct feature numbers; of an empty row all zeros."""
    if not len(row):
        return np.zeros(BANDS * WIDTH, np.uint64)
    return (hashing.mix(row.astype(np.uint64))[:, None] * _TIMES).min(axis=0)


def founders(rows: list[np.ndarray]) -> list[int]:
    """Numbers of the first row of each family of near copies, by their bands(): a row goes if one band equals that of
    a row that stays. Else the words of a text that was copied often would pass for signs of its label."""
    seen: set[tuple] = set()
    kept = []
    for i, row in enumerate(rows):
        keys = [(k, *band) for k, band in enumerate(row.reshape(BANDS, WIDTH).tolist())]
        if seen.isdisjoint(keys):
            seen.update(keys)
            kept.append(i)
    return kept


def choose(candidates: np.ndarray, in_positive: np.ndarray, n: int, in_unlabelled: np.ndarray, m: int) -> np.ndarray:
    """The candidates that come in positives often enough more than in unlabelled texts, FEATURES at most; in_* count the
    texts that have them, of n and m."""
    n, m = max(n, 1), max(m, 1)
    p, u = (in_positive + 0.5) / (n + 1), (in_unlabelled + 0.5) / (m + 1)
    z = (p - u) / np.sqrt(p * (1 - p) / n + u * (1 - u) / m)
    z[in_positive < min(SEEN, n)] = 0
    best = np.lexsort((candidates, -np.abs(z)))[:FEATURES]
    return np.sort(candidates[best[(z[best] > SIGNIFICANT) & (p[best] > LIFT * u[best])]])


def _merged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one: the row's number of each feature, the features, and how many there are of each row."""
    times = Counter(rows)
    rows = sorted(times)
    parts = [np.frombuffer(x, "<u2") for x in rows]
    column = np.concatenate([*parts, np.zeros(0, "<u2")]).astype(np.int64)
    return np.repeat(np.arange(len(rows)), [len(x) for x in parts]), column, np.array([times[x] for x in rows], float)


def train(positive: list[bytes], unlabelled: list[bytes], features: int, prior: float) -> np.ndarray:
    """Weights of the features and the bias, by Adam on the risk above over all rows at once. A row is the sequence of
    its features as 16-bit numbers below `features`."""
    (row, column, yes), (row_u, column_u, free) = _merged(positive), _merged(unlabelled)
    row, column, n = np.concatenate([row, row_u + len(yes)]), np.concatenate([column, column_u]), len(yes)
    count = n + len(free)
    yes, free = yes / max(yes.sum(), 1), free / max(free.sum(), 1)
    weight = np.zeros(features + 1)
    weight[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        g = np.bincount(row, weight[column], count) + weight[-1]
        s = sigmoid(g)
        negative = free @ np.logaddexp(0, g[n:]) - prior * (yes @ np.logaddexp(0, g[:n])) if len(free) else 0.0
        # derivative by g of the part on positives, and of the estimate of the part on negatives
        of_p = np.concatenate([-prior * (1 - s[:n]) * yes, np.zeros(count - n)])
        of_n = np.concatenate([-prior * s[:n] * yes, s[n:] * free])
        slope = of_p + of_n if negative >= 0 else -of_n
        gradient = np.append(np.bincount(column, slope[row], features), slope.sum())
        gradient[:-1] += DECAY * weight[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        weight -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weight


def _described(positive: DataFrame) -> DataFrame:
    """doc_id, bands and all distinct features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                feature, row = _distinct(*_hashes(b.column("text")))
                ends = np.searchsorted(row, np.arange(b.num_rows + 1))
                parts = [feature[a:z] for a, z in zip(ends, ends[1:])]
                least = pa.array([bands(x).astype("<u8").tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), least, pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary())], ["doc_id", "bands", "features"])

    return positive.mapInArrow(run, "doc_id long, bands binary, features binary")


def _frequencies(rows: DataFrame, column: str, only: np.ndarray | None = None) -> DataFrame:
    """feature, n: in how many rows each feature comes (of `only`, if given); feature -1 has the number of rows. column is
    `features`, as of _described(), or `text`. Each task sums up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(2**SPACE_BITS, -1) if only is not None else np.arange(2**SPACE_BITS)
        names = np.arange(2**SPACE_BITS) if only is None else only
        if only is not None:
            place[only] = np.arange(len(only))
        counts, n = np.zeros(len(names), np.int64), 0
        for batch in batches:
            for b in pieces(batch, column):
                n += b.num_rows
                if column == "text":
                    feature, row = _hashes(b.column("text"))
                    some = place[feature] >= 0
                    feature, _ = _distinct(feature[some], row[some])
                else:
                    feature = hashing.buffers(b.column(column))[0].view("<u4")
                counts += np.bincount(place[feature][place[feature] >= 0], minlength=len(names))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names[some], -1)), pa.array(np.append(counts[some], n))], ["feature", "n"])

    return rows.select(column).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _arrays(found: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and counts as of _frequencies(), at most 2**SPACE_BITS, and the number of rows."""
    by = {r["feature"]: r["n"] for r in found.collect()}
    n = by.pop(-1, 0)
    return np.array(sorted(by), np.int64), np.array([by[k] for k in sorted(by)], np.int64), n


def _place(chosen: np.ndarray) -> np.ndarray:
    place = np.full(2**SPACE_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    return place


def _rows(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """row: the chosen features of each text as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _place(chosen)
        for batch in batches:
            for b in pieces(batch):
                feature, row = _hashes(b.column("text"))
                some = place[feature] >= 0
                feature, row = _distinct(feature[some], row[some])
                raw, at = place[feature].astype("<u2").tobytes(), 2 * np.searchsorted(row, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([raw[a:z] for a, z in zip(at, at[1:])], pa.binary())], ["doc_id", "row"])

    return docs.mapInArrow(run, "doc_id long, row binary")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model to docs with labels.toxic. Of a doc_id labelled twice the higher label counts; a null label is
    none. The prior is the share of toxic labels outside the held-out fifth, none of whose labels or texts is read.
    Without a toxic label, or without a text that has one, the model scores 0. Rows with a null doc_id take no part; of
    rows with one doc_id each is a text of its own. Other columns are not looked at."""
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = known.where(~held_out("_id"))
    share = known.agg(F.count("*").alias("n"), F.sum("_toxic").alias("toxic")).first()
    if not share["toxic"]:
        return nothing
    prior = min(max(share["toxic"] / share["n"], 1e-3), 0.5)
    free = texts(docs).where("doc_id is not null").where(~held_out())
    by = [F.xxhash64("doc_id"), "doc_id", "bands"]
    yes = known.where("_toxic = 1").select(F.col("_id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVE)
    told = stored(_described(free.join(F.broadcast(yes), "doc_id", "left_semi")).withColumn("number", F.monotonically_increasing_id()), "positive")
    first = told.orderBy(*by).limit(POSITIVE).select("number", "bands").collect()
    if not first:
        return nothing
    of_family = [first[i]["number"] for i in founders([np.frombuffer(r["bands"], "<u8") for r in first])]
    listed = lambda numbers: F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in numbers], "number long"))
    candidates, in_positive, n = _arrays(_frequencies(told.join(listed(of_family), "number", "left_semi"), "features").where(F.col("n") >= min(SEEN, len(of_family))))
    features, counts, m = _arrays(_frequencies(free, "text", candidates))
    in_unlabelled = np.zeros(len(candidates), np.int64)
    in_unlabelled[np.searchsorted(candidates, features)] = counts
    chosen = choose(candidates, in_positive, len(of_family), in_unlabelled, m)
    place = _place(chosen)
    rows_of = told.join(listed([r["number"] for r in first]), "number", "left_semi").select("features")

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [place[np.frombuffer(x, "<u4")] for x in b.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].astype("<u2").tobytes() for x in parts], pa.binary())], ["row"])

    positive = [bytes(r["row"]) for r in rows_of.mapInArrow(narrowed, "row binary").collect()]
    blocks = max(1, round(m / BLOCK))
    width = len(chosen)

    def block(rows: pa.Table) -> pa.Table:
        return pa.table({"at": pa.array(range(width + 1), pa.int32()), "weight": train(positive, rows.column("row").to_pylist(), width, prior)})

    dealt = _rows(free, chosen).select("row", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).alias("block"))
    means = dealt.groupBy("block").applyInArrow(block, "at int, weight double").groupBy("at").agg(F.avg("weight").alias("weight"))
    weight = np.zeros(width + 1)
    for r in means.collect():
        weight[r["at"]] = r["weight"]
    return Model(chosen, weight[:-1], float(weight[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row: a null text counts as empty, equal rows score
    alike, other columns are not looked at, an empty table gives no rows, texts of any length are read whole."""
    names = ["doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for batch in batches:
            for b in pieces(batch):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(b.column("text"), lookup))], names)

    rows = texts(docs).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score below 0.5, with all their columns; each row is judged by its own text, a null one as empty."""
    reach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for batch in batches:
            for b in pieces(batch):
                yield b.filter(pa.array(model.score(b.column("text").fill_null(""), lookup) < 0.5))

    return docs.mapInArrow(run, docs.schema)
