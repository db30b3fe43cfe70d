import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from quire.llm import hashing, neardup, queries, topk, warc


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def brute_top(vectors, asked, k):
    out = []
    for q, v in asked:
        best = sorted(((-int(np.dot(v, w)), i) for i, w in vectors if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "few"])
def test_top_k_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "FILE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    n = 6 if kind == "few" else 300
    data = rng.standard_normal((n, 5)) if kind == "random" else rng.integers(-1, 2, (n, 5)) / 2
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(data)], "vec_id long, embedding array<double>, score int")
    exact = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in enumerate(data)]
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0")).collect()))
    assert got == brute_top(exact, [x for x in exact if x[0] % 10 == 0], 10)


def test_top_k_leaves_out_broken_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, nan]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 5, 512 * 1024), (0, 2, 6, 512 * 1024)]
    assert topk.top_k(df.limit(0), df).count() == 0 == topk.top_k(df, df.limit(0)).count()


def test_shares_of_a_query_change_nothing(spark, monkeypatch):
    """Near-equal vectors: a query with more candidates than a share of it holds."""
    monkeypatch.setattr(topk, "SALTS", 3)
    monkeypatch.setattr(topk, "FILE_BLOCK", 50)
    rng = np.random.default_rng(5)
    data = 0.5 + rng.integers(0, 30, (400, 4)) / 1024
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    exact = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in enumerate(data)]
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 40 = 0")).collect()))
    assert got == brute_top(exact, [x for x in exact if x[0] % 40 == 0], 10)


def test_large_components(spark):
    data = [(i, [float(3e5 + i), -2e3 * i]) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    exact = [(i, np.array([int(1024 * x) for x in v], dtype=object)) for i, v in data]
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id = 7")).collect())) == brute_top(exact, [exact[7]], 10)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(1, [3e6]), (2, [3e9])], "vec_id long, embedding array<double>"), df.limit(1).selectExpr("vec_id", "array(1d) as embedding"))


@pytest.mark.parametrize("size", [5000, 1 << 27, 1 << 29])
def test_bounds_hold(size):
    rng = np.random.default_rng(4)
    v, q = rng.integers(-size, size, (200, 7)), rng.integers(-size, size, (30, 7))
    low = v.min(axis=0)
    width = (v.max(axis=0) - low) // topk.CELLS + 1
    code = (v - low) // width
    assert code.max() < topk.CELLS
    lower, upper = topk.bounds(q, code, low, width)
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()


def shingle_set(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)) and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def near_copies(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(n):
        base = list(rng.choice(words, rng.integers(3, 120)))
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for _ in range(rng.integers(0, 6)):
                copy[rng.integers(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
        docs.append(" ".join(base[:60] + list(rng.choice(words, 40))))
    return list(enumerate(docs))


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STAR", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    docs = near_copies(40)
    got = neardup.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(docs)


def test_rows_with_one_id_and_different_texts(spark):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (5, a), (9, ""), (9, None), (None, a), (4, b + " x y")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n long")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(df).collect())
    assert got == [(0, 56, None, True), (4, 58, 4, True), (5, 56, 4, False), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (8, 57, 4, False), (9, 0, 9, True), (9, 0, 9, True)]
    kept = neardup.keep(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0), (r["text"] or "")[:4]) for r in kept.collect()) == [(0, "alph"), (4, "beta"), (5, "alph"), (9, "")]


def test_near_copies_with_one_id(spark):
    """Of several texts of the least document one stays."""
    a = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(3, a), (3, a + " x"), (4, a + " y")], "doc_id long, text string")
    assert [(r["component_id"], r["kept"]) for r in neardup.link(df).orderBy("doc_id").collect()] == [(3, True), (3, True), (3, False)]
    assert [r["doc_id"] for r in neardup.keep(df).collect()] == [3]


def test_words_with_one_polynomial_hash(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    words = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]
    got = neardup.link(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1)]
    short = {w[a : a + n] for w in words for a in range(0, 900, 7) for n in range(1, 80)}
    import pyarrow as pa

    value, _ = hashing.words(pa.array([" ".join(sorted(short))]))
    assert len(set(value.tolist())) == len(short)


def test_recall_against_sql(spark, sf):
    """Every link of the larger table, by brute-force SQL."""
    import duckdb

    sf = sf.replace("0.01", "0.1")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = dict(con.execute(f"select doc_id, component_id from ({queries.ORACLES['op6_minhash_hamming']})").fetchall())
    got = {r["doc_id"]: r["component_id"] for r in queries.op6_minhash_hamming(spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_only_certain_pairs_are_left_out(monkeypatch):
    """A pair that reaches the similarity is never dropped before it is confirmed, nor are most others kept."""
    import pyarrow as pa

    monkeypatch.setattr(neardup, "SKETCH", 32)
    rng = np.random.default_rng(2)
    texts = []
    for n in (10, 40, 200):
        base = [f"w{i}" for i in rng.integers(0, 5000, n)]
        for share in (0.0, 0.02, 0.05, 0.1, 0.3, 1.0):
            texts.append(" ".join(w if rng.random() > share else f"x{rng.integers(5000)}" for w in base))
    values, at = neardup.sets(pa.array(texts))
    high = (values >> np.uint64(32)).astype("<u4")
    batch = pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array([x.tobytes() for x in neardup.signatures(values, at)], pa.binary()), pa.array([high[a : min(z, a + 32)].tobytes() for a, z in zip(at, at[1:])], pa.binary())], ["n", "signature", "sketch"])
    known, dropped = neardup.Sets(batch), 0
    for i in range(len(texts)):
        near = set(known.alike(known.row(i), np.arange(len(texts))).tolist())
        for j in range(len(texts)):
            a, b = set(values[at[i] : at[i + 1]].tolist()), set(values[at[j] : at[j + 1]].tolist())
            assert j in near or 100 * len(a & b) < 75 * len(a | b)
            dropped += j not in near
    assert dropped > len(texts) ** 2 / 2


@pytest.mark.parametrize(("parts", "held"), [(1, 65_536), (7, 65_536), (7, 2)])
def test_keys_that_several_classes_share(spark, monkeypatch, parts, held):
    """Whatever ranges keys are dealt out to, frequent keys over several of them too."""
    monkeypatch.setattr(neardup, "HELD", held)
    rng = np.random.default_rng(6)
    pairs = {(int(k), int(i)) for k, i in zip(rng.integers(0, 120, 600), rng.integers(0, 10_000, 600))} | {(50, i) for i in range(400)} | {(1000, 5), (-7, 9), (-7, 3)}
    by = {}
    for k, i in pairs:
        by.setdefault(k, []).append(i)
    got = sorted(map(tuple, neardup.shared(spark.createDataFrame(sorted(pairs), "key long, id long").repartition(3), parts).select("key", "first", "id").collect()))
    assert got == sorted((k, min(v), i) for k, v in by.items() if len(v) > 1 for i in v)


def test_labels_grow_with_links(spark):
    rng = np.random.default_rng(3)
    for count in (4, 30, 60):
        edges = [tuple(map(int, rng.integers(0, 50, 2))) for _ in range(count)]
        df = spark.createDataFrame(edges, "a long, b long")
        root = list(range(50))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {r["id"]: r["component"] for r in neardup.components(df).collect()} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
        half = neardup.components(spark.createDataFrame(edges[: count // 2], "a long, b long"))
        got = {r["id"]: r["component"] for r in neardup.joined(half, spark.createDataFrame(edges[count // 2 :], "a long, b long")).collect()}
        assert all(got.get(x, x) == find(x) for x in range(50))


def test_one_large_family(spark, monkeypatch):
    """Copies of copies: links that no common centre shows."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(300)]
    text, docs = list(rng.choice(words, 60)), []
    for i in range(120):
        text = list(text)
        text[rng.integers(60)] = rng.choice(words)
        docs.append((200 - i, " ".join(text)))
    got = neardup.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(docs)


def test_pigeonhole_finds_every_pair_under_the_distance(spark):
    """Two signatures that differ in fewer than CHUNKS * (ERRORS + 1) components share a key, wherever they differ."""
    rng = np.random.default_rng(1)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    base = rng.integers(0, 2**16, (200, neardup.COMPONENTS)).astype(np.uint16)
    other = base.copy()
    for r in other:
        r[rng.choice(neardup.COMPONENTS, most, replace=False)] ^= 1
    rows = [(2 * i + j, x.tobytes()) for i, (a, b) in enumerate(zip(base, other)) for j, x in enumerate((a, b))]
    keys = neardup.index(spark.createDataFrame(rows, "id long, signature binary")).collect()
    by = {}
    for r in keys:
        by.setdefault(r["key"], set()).add(r["id"])
    met = {tuple(sorted(v)) for v in by.values() if len(v) > 1}
    assert met == {(2 * i, 2 * i + 1) for i in range(200)}


def test_signature_follows_similarity():
    import pyarrow as pa

    a = " ".join(f"x{i}" for i in range(400))
    b = " ".join(f"x{i}" if i != 200 else "other" for i in range(400))
    sig = neardup.signatures(*neardup.sets(pa.array([a, b, a])))
    assert (sig[0] == sig[2]).all() and (sig[0] != sig[1]).sum() < 12


def test_odd_documents(spark, odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(odd).collect()), key=str)
    plain = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").distinct().collect()]
    want = dict((d, (n, c, k)) for d, n, c, k in brute_components(plain))
    assert [(n, c, k) for d, n, c, k in got if d is None] == [(1, None, True)] and len(got) == odd.count()
    assert all((n, c, k) == want[d] for d, n, c, k in got if d is not None)
    assert want[3][1] == want[4][1] == 3 and want[7][1] == want[8][1] == 7
    assert neardup.link(empty).count() == 0
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 9, 10]


def test_words_are_whole(monkeypatch):
    """Hashes don't hang on how bytes are blocked."""
    import pyarrow as pa

    texts = ["", "a bc  d", " x\ny\t", "é中 A", "word " * 3000, "y" * 9000, "b c"]
    whole, at = hashing.words(pa.array(texts))
    monkeypatch.setattr(hashing, "CHUNK_BYTES", 64)
    small, at2 = hashing.words(pa.array(texts))
    assert whole.tolist() == small.tolist() and at.tolist() == at2.tolist()
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]


def _trees(spark, records, changed, fanout):
    return warc.audit(warc.tree(warc.leaves(records), "a", fanout), warc.tree(warc.leaves(changed), "b", fanout), fanout)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_audit_finds_what_was_changed(spark, fanout):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"), F.lit(1).alias("file"))
    records = warc.warc_records(pages).withColumn("file", F.col("page_id") % 3)
    bad = records.withColumn("data", F.when(F.col("page_id").isin(0, 77, 199), F.concat(F.expr("substring(data, 1, octet_length(data) - 5)"), F.lit("#\r\n\r\n").cast("binary"))).otherwise(F.col("data")))
    got = _trees(spark, records, bad, fanout).collect()
    assert sorted(r["page_id"] for r in got) == [0, 77, 199] and {r["kind"] for r in got} == {"corrupt"}
    assert _trees(spark, records, records, fanout).count() == 0
    lost = _trees(spark, records, records.where("page_id <> 199"), fanout).collect()
    assert [(r["page_id"], r["kind"]) for r in lost] == [(199, "missing")]


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_tells_lost_records_from_moved_ones(spark, fanout):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("html"))
    records = warc.warc_records(pages)
    size = {r["page_id"]: r["n"] for r in records.select("page_id", F.octet_length("data").alias("n")).collect()}
    lost = _trees(spark, records, records.where("page_id not in (3, 20)"), fanout).collect()
    assert sorted((r["page_id"], r["pos"], r["kind"], r["records"], r["shift"]) for r in lost) == [
        (3, 3, "missing", 1, 0), (4, 4, "moved", 16, -size[3]), (20, 20, "missing", 1, 0), (21, 21, "moved", 19, -size[3] - size[20])]
    extra = _trees(spark, records.where("page_id <> 3"), records, fanout).collect()
    assert sorted((r["page_id"], r["kind"], r["records"], r["shift"]) for r in extra) == [(3, "extra", 1, 0), (4, "moved", 36, size[3])]
    longer = records.withColumn("data", F.when(F.col("page_id") == 9, F.concat("data", F.lit("!!").cast("binary"))).otherwise(F.col("data")))
    assert sorted((r["page_id"], r["kind"], r["records"], r["shift"]) for r in _trees(spark, records, longer, fanout).collect()) == [(9, "corrupt", 1, 0), (10, "moved", 30, 2)]


def test_audit_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "u", None), (None, "u", "b"), (3, "u", "c"), (3, "u", "c")], "page_id long, url string, html string")
    records = warc.warc_records(pages)
    assert records.count() == 4
    assert _trees(spark, records, records, 2).count() == 0
    assert _trees(spark, records.limit(0), records.limit(0), 2).count() == 0
    assert {r["kind"] for r in _trees(spark, records, records.limit(0), 2).collect()} == {"missing"}
