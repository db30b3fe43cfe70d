import random
import zlib

import numpy as np
import pytest

from quire.llm import counts, packing, records, tokens, treebpe

BYTE, WORD, PIECE = (lambda: tokens.vocabulary("byte_bpe_50k.json")), (lambda: tokens.vocabulary("word_bpe_49k.json")), (lambda: tokens.vocabulary("piece_bpe_32k.model"))
WEIRD = ["", " ", "  a  b", " a", "a ", "a\n", "\n\na\n b", "don't\n\nstop", "a<|endoftext|> b <|endoftext|>", "é́ x", "A\tB\x85c\xa0d", "漢字 かな", "it's he'll 'S 12ab _x_--y", "a" * 900, "ÿ İ ŉ ǰ ſ", "\x01 \x00"]


@pytest.mark.parametrize(("kind", "path"), [(tokens.ByteEncoder, BYTE), (tokens.WordEncoder, WORD)])
def test_encoders_equal_library(kind, path, texts):
    encoder = kind(path())
    sample = [*WEIRD, *(t for _, t in texts)]
    for low in range(0, len(sample), 200):
        part = sample[low : low + 200]
        for a, b, t in zip(encoder.encode(part), encoder.library(part), part, strict=True):
            assert a.tolist() == b.tolist(), t[:80]


def test_small_cache_changes_nothing(texts, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(counts, "CACHE", 50)
    lengths, model = counts.Lengths(PIECE(), {"the": 1}), sentencepiece.SentencePieceProcessor(model_file=PIECE())
    for _, t in [*texts[:60], *texts[:20]]:
        assert lengths.count([t]) == [len(model.encode(t))]


@pytest.mark.parametrize(("kind", "path"), [(tokens.ByteEncoder, BYTE), (tokens.WordEncoder, WORD)])
def test_encoders_on_random_texts(kind, path):
    encoder, rng = kind(path()), random.Random(4)
    letters = "ab'st mdrevl  \nABZ09.,!?-\u00bf\u00e9\u00c9\u00df\u00ff\u0100\u0101\u0130\u0131\u0149\u01c5\u01c6\u023a\u024f\u00bd\u00b2\u00aa\u00ba\u00d7\u00f7"
    sample = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    for a, b, t in zip(encoder.encode(sample), encoder.library(sample), sample, strict=True):
        assert a.tolist() == b.tolist(), t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_token_encodes_itself(path):
    """The condition under which ranks of merged bytes stand for ranks of pairs: merging the parts of a token's bytes by
    pairs ends in the token alone."""
    import json

    with open(path(), encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
    suffix = model["end_of_word_suffix"] or ""
    for merged in {a + b for a, b in pairs}:
        end = bool(suffix) and merged.endswith(suffix)
        parts = list(merged.removesuffix(suffix) if end else merged)
        if end:
            parts[-1] += suffix
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (pairs.get((parts[i], parts[i + 1]), 1 << 30), i))
            assert (parts[best], parts[best + 1]) in pairs, merged
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [merged]


def test_tree_equals_library_on_any_cut(texts):
    tree = treebpe.TreeEncoder(BYTE(), leaf=40, window=6)
    rng = random.Random(5)
    alphabets = ["ab", "abcdefghij", "etaoin shrdlu", "a b\n  '", "é中a😀 b1", " 1aB.<|endoftext|>"]
    for k in range(600):
        text = "".join(rng.choice(alphabets[k % 6]) for _ in range(rng.randint(0, 500)))
        text = text if k % 6 != 5 else f"{text}<|endoftext|>{text}"
        ids = tree.encode([text])[0]
        assert ids.tolist() == tree.encoder.library([text])[0].tolist(), text
        assert tree.decode(ids) == tree.encoder.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    for _, text in texts[:200]:
        assert tree.encode([text])[0].tolist() == tree.encoder.library([text])[0].tolist()


def test_tree_on_long_unsplit_text():
    tree = treebpe.TreeEncoder(BYTE())
    rng = random.Random(6)
    for letters in ("ab", "etaoinshrdlu"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert tree.encode([text])[0].tolist() == tree.encoder.library([text])[0].tolist()


def test_tree_query(spark, odd, empty):
    got = treebpe.encode(odd).collect()
    assert len(got) == odd.count()
    assert treebpe.encode(empty).count() == 0
    tokenizer = tokens.load(BYTE())
    want = sorted(((r["doc_id"] or 0), tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted(((r["doc_id"] or 0), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) and r["n_tokens"] == len(ids)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}


def test_threads_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(treebpe, "LEAVES", 2)
    text = " ".join(t for _, t in texts[:40])
    for threads in (1, 3):
        tree = treebpe.TreeEncoder(BYTE(), leaf=500, threads=threads)
        assert tree.encode([text, "a", text])[2].tolist() == tree.encoder.library([text])[0].tolist()


def test_counts_equal_library(spark, odd, empty, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE())
    lengths = counts.Lengths(PIECE(), {"the": len(model.encode("the"))})
    sample = [*WEIRD, " ▁ a▁b", "<s> </s> <unk>", *(t for _, t in texts[:300])]
    assert lengths.additive
    assert lengths.count(sample) == [len(model.encode(t)) for t in sample]
    got = counts.count_tokens(odd, limit=100).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(
        ((r["doc_id"] or 0), len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 100) for r in odd.collect()
    )
    assert counts.count_tokens(empty).count() == 0


def _whole(pieces, length):
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"] > 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length
    return docs


def test_packing_is_whole_and_unpadded(spark, odd, empty, texts):
    assert packing.pack(empty).count() == 0
    got = packing.pack(odd, length=64).collect()
    docs = _whole(got, 64)
    tokenizer = tokens.load(BYTE())
    want = {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], []).append(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    assert {k: sum(n for _, n, _ in v) for k, v in docs.items()} == {k: sum(v) for k, v in want.items()}


def test_packed_ids_are_the_documents(spark, texts, sf):
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    _whole(got, 2048)
    tokenizer = tokens.load(BYTE())
    joined = {}
    for p in sorted(got, key=lambda p: p["start"]):
        joined[p["doc_id"]] = joined.get(p["doc_id"], b"") + p["ids"]
    encoded = tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)
    assert joined == {d: np.array([*e.ids, 1], "<u4").tobytes() for (d, _), e in zip(texts, encoded, strict=True)}


def test_hilbert_is_a_curve():
    """Over a whole grid each place comes once, and neighbours on the curve are neighbours in the grid."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_record_files_round_trip(spark, odd, empty, tmp_path):
    out = f"file://{tmp_path}/r"
    records.write(odd, out)
    got = records.read(spark, out, with_ids=True).collect()
    tokenizer = tokens.load(WORD())
    want = sorted((r["doc_id"], *tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1) for r in odd.where("doc_id is not null").collect())
    assert sorted((r["doc_id"], *np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    numbered = records.numbered(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in numbered] == sorted(r["doc_id"] for r in numbered)
    at = 0
    for r in numbered:
        assert r["start"] == at
        at += r["n_tokens"]
    found = records.fetch(spark, out, spark.createDataFrame([(9,), (3,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], *np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == [w for w in want if w[0] in (3, 9)]
    records.write(empty, f"file://{tmp_path}/e")
    assert records.numbered(spark, f"file://{tmp_path}/e").count() == 0


def test_damaged_records_are_found():
    data = bytearray(records.frame(7, np.arange(300, dtype="<u4")) + b"\n" + records.frame(8, np.array([1, 70_000], "<u4")) + b"\n")
    assert [(d, ids.tolist()) for d, _, _, ids in records.parse(bytes(data))] == [(7, list(range(300))), (8, [1, 70_000])]
    for i in range(len(data)):
        broken = bytearray(data)
        broken[i] ^= 4
        with pytest.raises(records.CorruptRecord):
            list(records.parse(bytes(broken)))
    with pytest.raises(records.CorruptRecord):
        list(records.parse(bytes(data[:-3])))


def test_small_files(spark, texts, tmp_path, monkeypatch):
    """A task's records in several files; numbers run on over them."""
    monkeypatch.setattr(records, "FILE_BYTES", 1000)
    out = f"file://{tmp_path}/r"
    df = spark.createDataFrame(texts[:100], "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/docs")
    records.write(spark.read.parquet(f"{tmp_path}/docs"), out)
    assert records.files(spark, out).count() > 8
    at, tokenizer = 0, tokens.load(WORD())
    for r, (d, t) in zip(records.numbered(spark, out).orderBy("start").collect(), sorted(texts[:100]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, at, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)
        at += r["n_tokens"]
    found = records.fetch(spark, out, spark.createDataFrame([(texts[5][0],), (texts[5][0],), (-1,), (None,)], "doc_id long")).collect()
    assert [r["doc_id"] for r in found] == [texts[5][0]]


def test_rows_of_one_id_are_packed_apart(spark):
    rows = [(1, f"text {i} " * 5) for i in range(300)] + [(None, "x y z")] * 50
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=128).collect()
    _whole(got, 128)
    tokenizer = tokens.load(BYTE())
    assert sum(p["length"] for p in got) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_counts_query_on_whole_table(spark, sf, texts):
    import sentencepiece

    from quire.llm import queries

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE())
    got = {r["doc_id"]: tuple(r) for r in queries.op5_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {d: (d, len(t.encode()), n := len(model.encode(t)), n > 4096) for d, t in texts}


def test_tree_query_on_whole_table(spark, sf, texts):
    import hashlib

    from quire.llm import queries

    tokenizer = tokens.load(BYTE())
    got = {r["doc_id"]: tuple(r) for r in queries.op7_tree_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for (d, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        back = tokenizer.decode(e.ids, skip_special_tokens=False)
        assert got[d] == (d, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert len(got) == len(texts)


def test_queries_on_whole_table(spark, sf, texts):
    from quire.llm import queries

    tokenizer = tokens.load(WORD())
    got = {r["doc_id"]: r for r in queries.op8_record_files(spark, sf).collect()}
    at = 0
    for (d, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
