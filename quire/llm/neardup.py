"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature has CHUNKS * WIDTH components of 16 bits; its distance is the number of components that differ. By the
pigeonhole principle two signatures that differ in fewer than CHUNKS * (ERRORS + 1) components have a chunk with at most
ERRORS of them. Each chunk is indexed once for every way to leave out ERRORS components, so all pairs under that
distance meet under some key. (At similarity 0.75 a chunk of 5 components has at most one error with probability 0.63;
with 12 chunks one pair in 170,000 meets under no key.)

1. Rows with equal sets become one class (by size and 128-bit digest) with a number of its own, so copies cost no
   pairs, and rows that share a doc_id but not a text are apart.
2. Keys are sorted, by ranges of (key, class), so that a frequent key is the work of many tasks; each class is paired
   with the first class of its key. A key's classes stream by, none is gathered.
3. Pairs are confirmed on their full sets, and classes joined into components.
4. Keys whose classes are still in different components are looked at again. First each such key pairs another of its
   classes, one by a hash, with those of other components; as a family of near copies meets under dozens of keys, it
   has dozens of centres and grows together. Then what is left is compared in full: all pairs of classes from different
   components under a key, in cells of at most two blocks of BLOCK classes, a pair under the first of its keys alone.
   Both times a pair skips step 3 only where it is certain to fall short: by the sizes of the sets, or by their
   sketches, the SKETCH least elements of each, even if all elements beyond were shared. After that every pair that meets
   under a key is confirmed, refuted or within one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import partitions, pieces, stored, texts

#: Words in a shingle, and the similarity in hundredths from which documents are linked.
SHINGLE, SIMILAR = 5, 75
CHUNKS, WIDTH, ERRORS = 12, 5, 1
COMPONENTS = CHUNKS * WIDTH
SKETCH = 512
BLOCK, HELD = 1024, 65_536
#: Pairs of one class that a task confirms.
STAR = 128

_RNG = np.random.default_rng(65537)
_FLIP = _RNG.integers(0, 2**32, COMPONENTS, dtype=np.uint64).astype(np.uint32)
_TIMES = _RNG.integers(0, 2**31, COMPONENTS, dtype=np.uint64).astype(np.uint32) << np.uint32(1) | np.uint32(1)
_NUMBER = (1 << (CHUNKS * WIDTH - 1).bit_length()) - 1
_SALT = _RNG.integers(0, 2**63, (CHUNKS * WIDTH, WIDTH), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted, without repeats, and their ranges."""
    if not len(values):
        return values, at
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.concatenate([np.sort(values[a:z]) for a, z in zip(at, at[1:]) if z > a])
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(at) - 1))])


def sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit hashes."""
    return distinct(*hashing.shingles(*hashing.words(array), SHINGLE))


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, COMPONENTS) of 16 bits from the least value of each set under COMPONENTS hash functions; empty sets 0."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, COMPONENTS), np.uint16)
    if len(full):
        x = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(COMPONENTS):
            least = np.minimum.reduceat((x ^ _FLIP[i]) * _TIMES[i], at[full])
            out[full, i] = hashing.mix(least.astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of mixed elements, mixed."""
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mix(values ^ salt), dtype=np.uint64)])
        out.append(hashing.mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, the signature and the sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                values, at = sets(b.column("text"))
                d1, d2 = digests(values, at)
                raw = pa.array([x.tobytes() for x in signatures(values, at)], pa.binary())
                high = (values >> np.uint64(32)).astype("<u4")
                sketch = pa.array([high[a : min(z, a + SKETCH)].tobytes() for a, z in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), raw, sketch], ["doc_id", "n", "d1", "d2", "signature", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, signature binary, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return hashing.buffers(column)[0].view(np.uint16).reshape(-1, COMPONENTS)


def index(classes: DataFrame) -> DataFrame:
    """key, id: for each class and chunk the keys that leave out ERRORS (one) of its components. The low bits of a key
    are its number: the chunk times WIDTH plus the component left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                b = batch.slice(low, 4096)
                matrix = _matrix(b.column("signature")).astype(np.uint64)
                keys = []
                for chunk in range(CHUNKS):
                    part = matrix[:, chunk * WIDTH : (chunk + 1) * WIDTH] + np.uint64(1)
                    for out in range(WIDTH):
                        number = chunk * WIDTH + out
                        rest = np.delete(np.arange(WIDTH), out)
                        hashed = hashing.mix((part[:, rest] * _SALT[number, rest]).sum(axis=1, dtype=np.uint64))
                        keys.append(hashed & ~np.uint64(_NUMBER) | np.uint64(number))
                ids = np.array(b.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def shared(keys: DataFrame, n: int) -> DataFrame:
    """key, first, id of all keys with two classes or more, first being the least class of the key; dealt out to about n
    parts by ranges of (key, id). A range knows all classes of a key that begins and ends in it; of its first and last key
    it may know some, and these are settled afterwards: two keys a range at most, and those with more classes than HELD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun, known = None, False, []  # the key at hand, whether its rows are settled afterwards, its ids so far

        def give(key: np.ndarray, first: np.ndarray, ident: np.ndarray, edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(first), pa.array(ident), pa.array(np.full(len(key), edge))], ["key", "first", "id", "edge"])

        def alone(ids: np.ndarray, edge: bool) -> pa.RecordBatch:
            return give(np.full(len(ids), held), np.full(len(ids), ids[0]), ids, edge)

        for batch in batches:
            key, ident = np.array(batch.column("key")), np.array(batch.column("id"))
            if not len(key):
                continue
            if held is None:
                held, begun = key[0], True
            more = int(np.searchsorted(key, held, side="right")) if key[0] == held else 0
            if more:
                if begun:
                    yield alone(ident[:more], True)
                else:
                    known.append(ident[:more])
                    if sum(map(len, known)) > HELD:  # too many to hold: settled afterwards as well
                        yield alone(np.concatenate(known), True)
                        begun, known = True, []
            key, ident = key[more:], ident[more:]
            if not len(key):
                continue
            if not begun and sum(map(len, known)) > 1:
                yield alone(np.concatenate(known), False)
            last = int(np.searchsorted(key, key[-1], side="left"))  # the batch's last key may go on
            starts = _starts(key[:last]) if last else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, last))
            many = np.repeat(sizes > 1, sizes)
            if many.any():
                yield give(key[:last][many], np.repeat(ident[starts], sizes)[many], ident[:last][many], False)
            held, begun, known = key[-1], False, [ident[last:]]
        if held is not None and not begun:
            yield alone(np.concatenate(known), True)

    told = stored(keys.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(run, "key long, first long, id long, edge boolean"), "ranges")
    whole, edge = told.where("not edge").select("key", "first", "id"), told.where("edge").select("key", "id")
    settled = edge.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("_n")).where("_n > 1").select("key", "first")
    return whole.unionByName(edge.join(F.broadcast(settled), "key").select("key", "first", "id"))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= similar * union.

    Pairs are dealt out by (a, part), a part holding about STAR pairs of a; a's text goes to each part, where the other
    texts stream by it. A class's text is that of the row `doc` whose set has the class's digests.
    """
    sizes = classes.select("id", "n")
    pairs = pairs.join(sizes.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"id": "b", "n": "nb"}), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= similar * F.greatest("na", "nb"))
    # written, as are other sums over a key that rows of the key are joined with: Spark splits a skewed key of a join only
    # where both sides come from a shuffle as they are
    pairs = stored(pairs, "sized")
    stars = stored(pairs.groupBy("a").agg(F.count("*").alias("_pairs")).withColumn("_parts", F.ceil(F.col("_pairs") / STAR)), "stars")
    pairs = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"))
    members = pairs.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("_member"))
    centres = pairs.select("a", "part").distinct().select("a", "part", F.col("a").alias("id"), F.lit(0).alias("_member"))
    wanted = members.unionByName(centres).join(classes.select("id", "doc", "d1", "d2"), "id")
    rows = wanted.join(docs.withColumnRenamed("doc_id", "doc"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            for b in pieces(batch):
                values, at = sets(b.column("text"))
                own_digests = digests(values, at)
                own = (own_digests[0] == np.array(b.column("d1"))) & (own_digests[1] == np.array(b.column("d2")))
                found = []
                for i, (a, part, ident, member) in enumerate(zip(*(b.column(k).to_pylist() for k in ("a", "part", "id", "_member")), strict=True)):
                    if not own[i]:  # another row of this doc_id, with another text
                        continue
                    those = values[at[i] : at[i + 1]]
                    if not member:
                        centre, of = (a, part), those.copy()
                    elif (a, part) == centre:
                        both = len(np.intersect1d(of, those, assume_unique=True))
                        if 100 * both >= similar * (len(of) + len(those) - both):
                            found.append((a, ident))
                    else:
                        raise ValueError(f"class {a} has no text")
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    rows = rows.repartition(partitions(docs), "a", "part").sortWithinPartitions("a", "part", "_member", "id")
    return rows.select("a", "part", "id", "_member", "d1", "d2", "text").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of all ids in links (a, b), by alternating large and small stars; each
    round is written to the shared folder, and nothing but whether it was the last comes to the driver. It was if no id
    hangs on one that hangs on another: then each star is a component, as rounds never part or join components."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    while not edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty() or not edges.groupBy("u").count().where("count > 1").isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        # large star: every greater neighbour of u hangs on the least of u's neighbourhood
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its lesser neighbours hang on the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels as of components() with the links of further pairs (a, b): only components that these join are looked at."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
    over = stored(components(ends), "over")
    old = labels.join(over.select(F.col("id").alias("component"), F.col("component").alias("_over")), "component", "left").select("id", F.coalesce("_over", "component").alias("component"))
    return old.unionByName(over.join(labels, "id", "left_anti").select("id", "component"))


def _mixed(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, component, _n, centre of the keys that have classes of different components: _n of them, and one by a
    hash as the key's centre."""
    rows = keys.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    by = rows.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"), F.min_by("id", F.xxhash64("id", "key")).alias("centre"))
    mixed = stored(by.where("_low < _high").select("key", "_n", "centre"), "mixed")
    return stored(rows.join(mixed, "key"), "rows")


def _with_sets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes.select("id", "n", "signature", "sketch"), "id")


class Sets:
    """What a batch of rows knows of its classes' sets."""

    def __init__(self, batch: pa.RecordBatch):
        self.n = np.array(batch.column("n"))
        self.signature = _matrix(batch.column("signature"))
        data, at = hashing.buffers(batch.column("sketch"))
        self.sketch, self.at = data.view("<u4"), at // 4

    def row(self, i: int) -> tuple[int, np.ndarray]:
        return int(self.n[i]), self.sketch[self.at[i] : self.at[i + 1]].copy()

    def alike(self, one: tuple[int, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Those of the rows whose sets may reach the similarity with one row's; all others are certain not to."""
        n, sketch = one
        rows = rows[100 * np.minimum(self.n[rows], n) >= SIMILAR * np.maximum(self.n[rows], n)]
        if not len(rows):
            return rows
        size = np.diff(self.at)[rows]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        values = self.sketch[np.repeat(self.at[rows] - start, size) + np.arange(size.sum())]
        # below the lesser of their ends both sketches hold all of their sets; one that is the whole set has no end
        whole = 1 << 32
        end = np.minimum(np.where(self.n[rows] > SKETCH, values[start + size - 1].astype(np.int64), whole), int(sketch[-1]) if n > SKETCH else whole)
        below = values < np.repeat(end, size)
        shared = (sketch[np.minimum(np.searchsorted(sketch, values), len(sketch) - 1)] == values) & below
        # half hashes only make this count too large; beyond the end all elements may be shared
        beyond = np.minimum(n - np.searchsorted(sketch.astype(np.int64), end), self.n[rows] - np.add.reduceat(below, start, dtype=np.int64))
        most = np.add.reduceat(shared, start, dtype=np.int64) + beyond
        return rows[100 * most >= SIMILAR * (n + self.n[rows] - most)]

    def first_met(self, i: int, rows: np.ndarray, number: int) -> np.ndarray:
        """Those of the rows that share no key of a lesser number with row i."""
        same = (self.signature[rows] == self.signature[i]).reshape(-1, CHUNKS, WIDTH)
        met = same.sum(axis=2) >= WIDTH - ERRORS
        chunk = met.argmax(axis=1)
        left_out = np.where(same[np.arange(len(rows)), chunk].all(axis=1), 0, (~same[np.arange(len(rows)), chunk]).argmax(axis=1))
        return rows[chunk * WIDTH + left_out == number]


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _centred(rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of each key's centre with its classes of other components; rows as of _mixed. A key is dealt out in
    parts of about BLOCK classes, each with the centre before them."""
    parts = F.ceil(F.col("_n") / BLOCK).cast("int")
    others = rows.where("id <> centre").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("_member"), "id", "component")
    centres = rows.where("id = centre").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("_member"), "id", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # id, component and sets of the centre
        for batch in batches:
            ids, comp = (np.array(batch.column(k)) for k in ("id", "component"))
            if not len(ids):
                continue
            known, a, b = Sets(batch), [], []
            starts = np.flatnonzero(np.array(batch.column("_member")) == 0)
            ends = np.append(starts, len(ids))
            for i in range(-1, len(starts)):
                s, e = (0 if i < 0 else starts[i]), ends[i + 1]
                if i >= 0:
                    last = (ids[s], comp[s], known.row(s))
                if s < e:
                    near = known.alike(last[2], s + np.flatnonzero(comp[s:e] != last[1]))
                    a.append(np.full(len(near), last[0]))
                    b.append(ids[near])
            yield _pairs(a, b)

    dealt = _with_sets(others.unionByName(centres), classes).select("key", "part", "_member", "id", "component", "n", "signature", "sketch")
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "_member", "id").mapInArrow(run, "a long, b long").distinct()


def _crossing(rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of classes of different components under one key that may reach the similarity; rows as of _mixed."""
    rows = _with_sets(rows, classes)
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    rows = rows.withColumn("_blocks", blocks)
    own = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "component", "id", "n", "signature", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, x, y, own, comp, ids = (np.array(batch.column(k)) for k in ("key", "x", "y", "own", "component", "id"))
            known, a, b = Sets(batch), [], []
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            for s, e in zip(starts, np.append(starts[1:], len(key))):
                for i in range(s, e - 1):
                    fit = comp[i + 1 : e] != comp[i]
                    if x[s] != y[s]:
                        fit &= own[i + 1 : e] != own[i]
                    rest = i + 1 + np.flatnonzero(fit)
                    if len(rest):
                        near = known.alike(known.row(i), known.first_met(i, rest, int(key[s]) & _NUMBER))
                        a.append(np.full(len(near), ids[i]))
                        b.append(ids[near])
            return _pairs(a, b)

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            key, x, y = (np.array(batch.column(k)) for k in ("key", "x", "y"))
            cut = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))[-1])
            if held and cut == 0 and all(held[-1].column(k)[-1].as_py() == v for k, v in (("key", key[0]), ("x", x[0]), ("y", y[0]))):
                held.append(batch)
                continue
            held.append(batch.slice(0, cut))
            if sum(b.num_rows for b in held):
                yield give(whole())
            held = [batch.slice(cut)]
        if held:
            yield give(whole())

    rows = rows.select("key", "x", "y", "own", "component", "id", "n", "signature", "sketch")
    return rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "id").mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, similar: int) -> DataFrame:
    """doc_id, n, d1, d2, class (null: the set is empty), group (of classes that are linked) and component_id of the rows
    of texts()."""
    if similar < SIMILAR:
        raise ValueError(f"similar must be {SIMILAR} or more")
    told = stored(describe(docs), "signatures")
    same = ["n", "d1", "d2"]
    grouped = told.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    dealt = partitions(classes)
    live = stored(shared(index(classes), dealt), "keys")
    pairs = live.where("first <> id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    labels = stored(components(confirm(pairs, classes, docs, similar)), "labels")
    for more in (_centred, _crossing):
        new = stored(more(_mixed(live.select("key", "id"), labels), classes, dealt).join(pairs, ["a", "b"], "left_anti"), "more")
        if not new.isEmpty():
            pairs = pairs.unionByName(new)
            labels = stored(joined(labels, stored(confirm(new, classes, docs, similar), "links")), "labels")
    placed = classes.select("id", "doc", *same).join(labels, "id", "left").select("id", "doc", *same, F.coalesce("component", "id").alias("group"))
    least = stored(placed.groupBy("group").agg(F.min("doc").alias("least")), "least-documents")
    placed = stored(placed.join(least, "group").select(F.col("id").alias("class"), *same, "group", "least"), "placed")
    # a row whose set no class has can only be one without words
    named = told.where("doc_id is not null").select("doc_id", *same).join(placed, same, "left")
    named = named.select("doc_id", *same, "class", "group", F.coalesce("least", "doc_id").alias("component_id"))
    none = F.lit(None).cast("long")
    return named.unionByName(told.where("doc_id is null").select("doc_id", *same, none.alias("class"), none.alias("group"), none.alias("component_id")))


def link(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links, itself included) and kept (doc_id =
    component_id) of every row.

    Texts without words and null texts have an empty set and no link. Repeated rows each get their row; rows with one
    doc_id and different texts are judged each by its own text, and are linked by nothing but their texts. A row with a
    null doc_id is linked with nothing: component_id null, kept true. Ties don't arise, as components don't depend on
    the order of links. Other columns are not looked at; an empty table gives no rows; very long texts are hashed in
    pieces. similar must be 75 or more, for which the signature's size is chosen.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _linked(texts(docs), similar).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def keep(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row of each component, with all its columns: of its least doc_id, and where that has several texts in the
    component, the one with the least digest.

    Rows with one doc_id and one set count as one document, and one of them stays. Rows with one doc_id and texts of
    different components stay beside each other. A text without words is a component of its own. Rows with a null doc_id
    all stay. An empty table stays empty.
    """
    whole = stored(_linked(texts(docs), similar).where("doc_id is not null"), "linked")
    best = F.min(F.struct("n", "d1", "d2")).alias("set")
    kept = whole.where("doc_id = component_id").groupBy("doc_id", "group").agg(best).select(F.col("doc_id").alias("_doc"), "set.*")
    several = stored(whole.groupBy(F.col("doc_id").alias("_doc")).count().where("count > 1").select("_doc"), "several")
    ident = docs["doc_id"].cast("long")
    if several.isEmpty():
        out = docs.join(kept, ident == kept["_doc"], "left_semi")
    else:
        alone = kept.join(several, "_doc", "left_anti")
        out = docs.join(alone, ident == alone["_doc"], "left_semi")
        rest = docs.join(several, ident == several["_doc"], "left_semi").select(F.struct("*").alias("row"), ident.alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in pieces(batch):
                    values, at = sets(b.column("text"))
                    d1, d2 = digests(values, at)
                    yield pa.RecordBatch.from_arrays([b.column("row"), b.column("_doc"), pa.array(np.diff(at)), pa.array(d1), pa.array(d2)], ["row", "_doc", "n", "d1", "d2"])

        row = rest.select("row").schema.simpleString().removeprefix("struct<row:").removesuffix(">")
        told = rest.mapInArrow(run, f"row {row}, _doc long, n long, d1 long, d2 long")
        same = ["_doc", "n", "d1", "d2"]
        out = out.unionByName(told.join(kept, same, "left_semi").dropDuplicates(same).select("row.*"))
    return out.unionByName(docs.where("doc_id is null"))
