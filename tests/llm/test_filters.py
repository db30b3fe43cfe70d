import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import pii, quality, queries, toxicity

SPACE = "[^\x20\x09-\x0d]+"


def brute_counts(text):
    w, seen, cover = re.findall(SPACE, text or ""), {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(p for i in at for p in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_statistics_equal_brute_force(spark, odd, empty, sf):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality.judge(docs, quality.DecisionList()).collect()
        want = sorted(((r["doc_id"] or 0), *brute_counts(r["text"])) for r in docs.collect())
        assert sorted(((r["doc_id"] or 0), *(r[k] for k in quality.BASE), r["base_failed"]) for r in got) == want
    assert quality.judge(empty, quality.DecisionList()).count() == 0


def _corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        w = [f"word{rng.integers(10_000)}" for _ in range(60)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + ("###" if bad and i % 8 == 0 else "") if not (bad and i % 8) else x.upper() for x in w), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", F.lit(1).alias("_quality"), F.lit("x").alias("_id"))


def test_list_is_learned_and_holds(spark, odd):
    docs, labels = _corpus(spark)
    rules = quality.fit(docs, labels)
    assert 1 <= len(rules.rules) <= 4 and "bad if" in str(rules)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert all(kept == (i % 4 != 0) for i, kept in got.items())
    kept = quality.keep(odd, rules)
    assert kept.columns == odd.columns
    plain = "no Python on executors"
    text = kept._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text), plain


def test_no_labels_no_rules(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 0), (3, 7)], "doc_id long, quality int")
    assert quality.fit(odd, none).rules == [] == quality.fit(empty, none.limit(0)).rules


def test_pruning_drops_noise():
    grow = [((0, 0), 50, 0), ((1, 0), 1, 30), ((1, 1), 0, 5)]
    assert quality.cover(grow, grow, [1, 1]) == [[(0, True, 1)]]


def test_held_out_quality(spark, sf):
    """On labelled documents of the larger table the list keeps good ones and drops junk."""
    sf = sf.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    share = dict(map(tuple, got.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()))
    assert share[1] > 0.97 and share[0] < 0.1


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to joe@mail.example.com now", {"email:9:29"}),
        ("write to joe [at] mail (dot) example {dot} com now", {"email:9:46"}),
        ("write to joe at mail dot example dot com now", {"email:9:40"}),
        ("joe＠mail．example．com", {"email:0:20"}),
        ("jоe@mаil.example.com", {"email:0:20"}),
        ("j​oe@mail​.com", {"email:0:14"}),
        ("call plus one two three four five six seven eight nine zero ok", {"phone:5:59"}),
        ("card four one one one one one one one one one one one one one one one end", {"card:5:69"}),
        ("host 10.0.0.300 and 10.0.0.3", {"ip:20:28"}),
        ("host one nine two dot one six eight dot one dot two five", {"ip:5:56"}),
        ("joe_at_mail_dot_example_dot_com", {"email:0:31"}),
        ("＋１ ５５５ １２３ ４５６７", {"phone:0:15"}),
        ("plus one 555 double two one four five six seven", {"phone:0:47"}),
        ("+49–30–1234–5678", {"phone:0:16"}),
        ("joe [  at ] mail.com", {"email:0:20"}),
        ("call plus one oh one oh one one oh one one", {"phone:5:42"}),
        ("carte quatre un un un un un un un un un un un un un un un fin", {"card:6:57"}),
        ("plus uno dos tres cuatro cinco seis siete ocho nueve cero", {"phone:0:57"}),
        ("ruf plus vier neun acht sieben sechs fünf vier drei zwei eins null an", {"phone:4:66"}),
        ("appel plus trois trois un deux trois quatre cinq six sept huit neuf zéro.", {"phone:6:72"}),
        ("card 4111 1111 1111 11l1 x", {"card:5:24"}),
        ("host 1O.0.0.1", {"ip:5:13"}),
        ("host l0.0.0.1", {"ip:5:13"}),
        ("+1 555 O12 3456", {"phone:0:15"}),
        ("oil lol 10 Io oO l l l", set()),
        ("look at the dot on the map", set()),
        ("one of two or three, four at five and six - seven", set()),
        ("three or four of seven", set()),
        ("", set()),
    ],
)
def test_disguises(text, found):
    plain, every = pii.find(text)
    assert set(plain) <= set(every)
    got = {f"{k}:{a}:{b}" for k, a, b in every}
    assert found <= got if found else not got


@pytest.mark.parametrize(
    ("text", "base", "added"),
    [
        ("write jo\u043ee@mail.example.com now", ("email", 9, 27), ("email", 6, 27)),
        ("write jo\u200be@mail.example.com now", ("email", 9, 27), ("email", 6, 27)),
        ("write joe@mail.example[dot]com now", ("email", 6, 22), ("email", 6, 30)),
    ],
)
def test_partly_disguised(text, base, added):
    """A base span of a part stays, and the whole is added beside it and masked."""
    plain, every = pii.find(text)
    assert plain == [base] and set(every) == {base, added}
    assert pii.redact(text, every) == "write <EMAIL> now"


@pytest.mark.parametrize(
    "address",
    [
        "joe at example.com",
        "joe at mail.example.ch",
        "joe [at] example dot com",
        "joe at example[dot]com",
        "joe at example[.]com",
        "joe@example dot com",
        "joe@mail.example dot com",
        "joe @ example dot com",
        "joe_at_example dot com",
        *(f"joe at mail dot example dot {x}" for x in ("ch", "nl", "ca", "biz", "at", "in", "museum")),
        "joe chez exemple point ch",
        "joe dot smith at example dot co dot uk",
        "JOE AT EXAMPLE DOT COM",
        "j\u043ee at example.com",
    ],
)
def test_spoken_signs(address):
    """Each sign is found in words, in brackets or as it is, before any last label."""
    assert f"email:6:{6 + len(address)}" in pii.joined(pii.find(f"write {address}, now")[1])


@pytest.mark.parametrize(
    "text",
    ["at this point in time", "look at the dot on the map", "look at example.com now", "he was at home.Then he left", "go to us at www.example.com", "some at gun point she", "joe at example.com/page", "at 3.5 or at 4.25", "up at that point the"],
)
def test_plain_words_are_no_address(text):
    assert not pii.find(text)[1]


def test_base_spans_equal_patterns(spark, texts, sf, odd, empty):
    def brute(text):
        out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
                out.append((m.start(), 2, "card", m.end()))
        out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out)

    got = {r["doc_id"]: r for r in queries.op9_disguised_pii(spark, sf).collect()}
    for d, text in texts:
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]
        assert set(filter(None, joined.split(","))) <= set(got[d]["spans"].split(","))
    assert pii.detect(odd).count() == odd.count() and pii.detect(empty).count() == 0


def test_spans_of_random_disguises(rng=np.random.default_rng(8)):
    """Base patterns equal plain ones on any text, base spans stay, and added spans lie in the text and are new."""
    parts = ["one ", "two ", "seven ", "at ", " dot ", "[at]", "(dot)", "joe", "@", "mail", ".com", " ", "1", "4", "\u043e", "\uff20", "\u200b", "l", "O", ".", "192", "+", "-", "cinq ", "\u0663", "_x"]
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert [m.span() for m in email.finditer(text)] == list(pii._emails(text)), text
        assert [m.span() for m in ip.finditer(text)] == [m.span() for m in pii.IP.finditer(text)], text
        plain, every = pii.find(text)
        assert set(plain) <= set(every) and len(set(every)) == len(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_long_runs_take_linear_time():
    import time

    start = time.perf_counter()
    pii.find("x" * 300_000 + " a@b.co " + "1" * 300_000 + ".1" * 1000 + "a@" * 50_000)
    assert time.perf_counter() - start < 20


def test_tape_maps_back():
    tape = pii.Tape("abcdefgh")
    tape.rewrite([(1, 3, "X"), (4, 5, "")])  # aXdfgh
    tape.rewrite([(0, 1, "long"), (2, 3, "")])  # longXfgh
    assert tape.text == "longXfgh"
    assert tape.source(0, 4) == (0, 1, True) and tape.source(4, 5) == (1, 3, True)
    assert tape.source(5, 8) == (5, 8, False) and tape.source(4, 6) == (1, 6, True)


def test_mask(spark, odd):
    df = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1!", 3, "k"), (2, None, 4, "k"), (3, "none", 4, "k")], "doc_id long, text string, n_chars long, spans string")
    got = pii.mask(df).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["mail <EMAIL> or <IP>!", None, "none"] and got[0]["n_chars"] == len(got[0]["text"])
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == odd.count()


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    n1, n0 = label.sum(), (~label).sum()
    return (order[label].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_toxicity_on_held_out(spark, sf):
    sf = sf.replace("0.01", "0.1")
    got = queries.op10_nnpu_toxicity(spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both.toxic.to_numpy() == 1) > 0.95
    assert (both.predicted == both.toxic).mean() > 0.95


def test_labels_of_the_held_out_fifth_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    gone = labels.where(~toxicity.held_out())
    for d, other in ((docs, turned), (docs, gone), (docs.where(~toxicity.held_out()), gone)):
        again = toxicity.fit(d, other)
        assert model.bias == again.bias and (model.feature == again.feature).all() and (model.weight == again.weight).all()
    assert len(model.feature) > 5


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    row = lambda *x: np.unique(np.append(rng.integers(10, 400, 5), x)).astype("<u2").tobytes()
    yes, mixed = [row(7) for _ in range(40)], [row(*([7] if i % 10 == 0 else [])) for i in range(400)]
    weight = toxicity.train(yes, mixed, 400, 0.1)
    assert weight[7] == max(weight) > 1 and weight[-1] < 0
    # rows that come several times weigh as often
    twice = toxicity.train(yes + yes, mixed + mixed, 400, 0.1)
    assert np.allclose(weight, twice)


def test_features_are_chosen_by_counts():
    candidates = np.array([3, 5, 8, 9])
    assert toxicity.choose(candidates, np.array([90, 50, 2, 60]), 100, np.array([90, 900, 1, 90]), 1000).tolist() == [3, 9]


def test_blocks_of_unlabelled_text(spark, sf, monkeypatch):
    """Many blocks give about the model that one block gives, and every text is in one of them."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "BLOCK", 200)
    many = toxicity.fit(docs, labels)
    assert (one.feature == many.feature).all()
    both = toxicity.score(docs, one).join(toxicity.score(docs, many).selectExpr("doc_id", "predicted as other"), "doc_id")
    assert both.where("predicted = other").count() > 0.97 * both.count()


def test_scores_equal_plain_sums(spark, sf, texts):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    lookup = dict(zip(model.feature.tolist(), model.weight.tolist()))
    known = {}

    def features(word):
        if word not in known:
            known[word] = set(toxicity._hashes(pa.array([word]))[0].tolist())
        return known[word]

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for d, text in texts:
        words = set(re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
        total = model.bias + sum(lookup.get(f, 0) for f in set().union(*map(features, words)))
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(total, -40, 40)))) < 1e-9


def test_toxicity_of_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert toxicity.keep(odd, model).columns == odd.columns
