"""Edge cases of expressions against small sequential models."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import layout, text
from quire.operators import accounts, billing, pages, recognition, storage
from quire.sources import codecs

few = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'bigint'}" for k, v in values.items()))
    return row.select(*names, column.alias("_out")).first()["_out"]


def parse_range(r, total):
    r = r.strip()
    if "-" in r:
        a, b = r.split("-", 1)
        a, b = int(a), int(b)
        return list(range(max(1, a), min(total, b) + 1))
    p = int(r)
    return [p] if 1 <= p <= total else []


@pytest.mark.parametrize("r", ["1-3", "4", "0-2", "2-99", "7-3", "0", "99", "11-12", "3-", "-3", "a", "1-2-3", "", " 2 - 4 ", "10", "٣"])
def test_range(spark, r):
    got = one(spark, text.page_range(F.col("r"), F.lit(10).cast("long")), r=r)
    try:
        want = parse_range(r, 10) if r != "٣" else None
    except ValueError:
        want = None
    assert got["error"] == (want is None)
    if want is not None:
        assert list(range(got["first"], got["last"] + 1)) == want


@few
@given(st.text("0123456789 ,-x\t", max_size=20))
def test_number_list(spark, s):
    want = [min(int(p.strip()), 2**63 - 1) for p in s.split(",") if p.strip().isdigit()]
    assert one(spark, text.number_list(F.col("s")), s=s) == want


def test_numbers_of_any_length_and_script(spark):
    asked = ["99999999999", "9" * 30, "٣, ७,1", "0" * 30 + "2", "1.5,+1,-1, ,x"]
    got = [one(spark, text.number_list(F.col("s")), s=s) for s in asked]
    assert got == [[99999999999], [2**63 - 1], [3, 7, 1], [2], []]
    request = spark.createDataFrame(list(enumerate(asked)), "doc_id long, pages string")
    sizes = spark.createDataFrame([(i, 3) for i in range(5)], "doc_id long, n_pages long")
    chosen = [(r["doc_id"], r["page"]) for r in pages.select_pages(request, sizes).orderBy("doc_id", "ordinal").collect()]
    assert chosen == [(2, 3), (2, 1), (3, 2), (4, 1), (4, 2), (4, 3)]  # a number that no page has selects none


@few
@given(st.text("ab \t\n \u001f\u0085 ", max_size=12))
def test_strip(spark, s):
    assert one(spark, text.strip(F.col("s")), s=s) == s.strip()


@few
@given(st.text("ab \n\r", max_size=14))
def test_lines_and_reversal(spark, s):
    lines = s.splitlines()
    assert one(spark, text.lines(F.col("s")), s=s) == lines
    want = "\n".join(x if not x.strip() else " ".join(reversed(x.split())) for x in lines)
    assert one(spark, text.reverse_words(F.col("s")), s=s) == want


@pytest.mark.parametrize("n", [0, 1, 4500, 4501, 9001])
def test_chunks(spark, n):
    s = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, text.chunks(F.col("s")), s=s)
    assert "".join(got) == s and all(len(x) <= 4500 for x in got) and len(got) == max(1, math.ceil(n / 4500))


@pytest.mark.parametrize(("name", "stem", "suffix"), [("a.PDF", "a", ".pdf"), (".pdf", ".pdf", ""), ("a.tar.gz", "a.tar", ".gz"), ("x/y.b/c", "c", ""), ("a", "a", ""), ("/p/q.Doc", "q", ".doc")])
def test_names(spark, name, stem, suffix):
    assert one(spark, text.stem(F.col("n")), n=name) == stem
    assert one(spark, text.suffix(F.col("n")), n=name) == suffix


def test_safe_filename(spark):
    assert one(spark, text.safe_filename(F.col("n")), n="/a/b/שלום wörld?*.pdf") == "שלום wörld__.pdf"
    assert len(one(spark, text.safe_filename(F.col("n")), n="x" * 300)) == 200


def test_gateway_and_form(spark):
    got = one(spark, text.gateway_reply(F.col("b")), b="Response=001&Num=1=2&bad&Response=000")
    assert {(x["k"], x["v"]) for x in got} == {("Response", "000"), ("Num", "1=2")}
    assert one(spark, text.form_fields(F.col("b")), b="a=1+2&a=3&b=%2B&c=&d") == {"a": "1 2", "b": "+"}


@few
@given(st.text("abAB.\\E*", max_size=15), st.sampled_from(["a", "B.", "\\E", "*"]))
def test_redact(spark, s, term):
    new, count = text.redact(F.col("s"), [term])
    found = re.findall(re.escape(term), s, re.I)
    assert one(spark, count, s=s) == len(found)
    assert one(spark, new, s=s) == re.sub(re.escape(term), "█" * len(term), s, flags=re.I)


def test_layout(spark):
    assert one(spark, layout.rgb(F.col("c")), c="#CC0033").asDict() == {"r": 0.8, "g": 0.0, "b": 0.2}
    assert [one(spark, layout.signature_page(F.col("p"), F.lit(5)), p=p) for p in (-1, 0, 1, 3, 9)] == [4, 0, 0, 2, 4]
    assert one(spark, layout.permissions(F.lit(True), F.lit(True), F.lit(True)), p=1) == 512 + 4 + 2048 + 16 + 8 + 32


@pytest.mark.parametrize(("words", "conf", "kept", "mean"), [([], [], [], 0.0), (["a", " ", "b", "c"], [90, 95, 20, 21], ["a", "c"], 0.565), (["a"], [-1], [], 0.0), (["a"], [1], [], 0.01)])
def test_recognised_words(spark, words, conf, kept, mean):
    row = spark.createDataFrame([(words, conf)], "w array<string>, c array<int>")
    got = row.select(recognition.good_words(F.col("w"), F.col("c")), recognition.confidence(F.col("c"))).first()
    assert (got[0], got[1]) == (kept, mean)


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=25), st.integers(1, 4))
def test_quota_equals_counter(spark, calls, limit):
    rows = [(i, u, f"2024-01-0{d + 1} 10:00:00") for i, (u, d) in enumerate(calls)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: (r["allowed"], r["count_after"]) for r in accounts.check_quota(df, limit).collect()}
    counts, want = {}, {}
    for i, u, ts in rows:
        n = counts.get((u, ts), 0)
        counts[u, ts] = min(n + 1, limit)
        want[i] = (n < limit, counts[u, ts])
    assert got == want


@few
@given(st.lists(st.sampled_from(["success", "notify_ok", "notify_bad", "fail"]), max_size=6))
def test_order_fold(spark, events):
    status, n = "pending", 0
    for e in events:
        if e == "success" or (e == "notify_ok" and status != "completed"):
            n, status = n + 1, "completed"
        elif e == "fail":
            status = "failed"
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(["create", *events])], "order_id long, seq long, event string")
    assert billing.order_states(df).first()[1:] == (status, n)


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([(k, o, o % 5) for k in "ab" for o in range(40)], "k string, o long, v long")
    got = {(r["k"], r["o"]): r["t"] for r in pages.running_total(df, "k", "o", "v", "t", block=7).collect()}
    assert got == {(k, o): sum(x % 5 for x in range(o)) for k in "ab" for o in range(40)}


def test_upload_limits(spark):
    mb = 1048576
    rows = [(1, "application/pdf", 100 * mb, None), (2, "application/pdf", 100 * mb + 1, "free"), (3, "application/pdf", 500 * mb, "pro"), (4, "a/b", 1, "pro"), (5, None, 1, None)]
    df = spark.createDataFrame(rows, "file_id long, content_type string, length long, plan string")
    got = {r["file_id"]: r["status"] for r in storage.validate_uploads(df, list(storage.PDF)).collect()}
    assert got == {1: 200, 2: 413, 3: 200, 4: 415, 5: 415}


def test_upload_types_default_to_known_ones(spark):
    rows = [(1, "text/x-evil", 1, None), (2, None, 1, None), (3, "text/plain", 1, None), (4, "application/pdf", 104910029, None), (5, "application/pdf", 1048576 * 600 + 262144, "pro")]
    df = spark.createDataFrame(rows, "file_id long, content_type string, length long, plan string")
    for allowed in (None, []):
        got = {r["file_id"]: r for r in storage.validate_uploads(df, allowed).collect()}
        assert {k: r["status"] for k, r in got.items()} == {1: 415, 2: 415, 3: 200, 4: 413, 5: 413}
        assert got[2]["detail"] == f"סוג קובץ לא נתמך: . נתמך: {', '.join(sorted(storage.KNOWN))}" and got[3]["detail"] is None
        assert got[4]["detail"] == f"הקובץ גדול מדי ({104910029 / 1048576:.1f}MB). מקסימום: 100MB"
        assert got[5]["detail"] == f"הקובץ גדול מדי ({600.25:.1f}MB). מקסימום: 500MB"
    assert storage.validate_uploads(df, ["application/pdf"], max_mb=700).where("status = 413").count() == 0


def test_renewal_order_id_has_an_iso_date(spark):
    df = spark.sql("select 'abcdefghijk' as user_id, 'pro' as plan, 39 as amount, timestamp_ntz'2001-07-31 00:00:00' as next_charge, 't' as token, false as cancelled")
    assert billing.renewals_due(df, F.lit("2001-08-01").cast("date")).first()["order_id"] == "REN-abcdefgh-2001-08-01"


def test_redaction_of_selected_pages(spark):
    p = spark.createDataFrame([(1, 1, "the end"), (1, 2, "The The"), (2, 1, "the"), (3, 1, "the")], "doc_id long, page long, text string")
    sizes = p.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    request = spark.createDataFrame([(1, "2,2,99"), (2, "99999999999")], "doc_id long, pages string")
    got = {(r["doc_id"], r["page"]): (r["text"], r["n_redacted"]) for r in pages.redact(p, ["the"], request=request, sizes=sizes).collect()}
    assert got == {(1, 1): ("the end", 0), (1, 2): ("███ ███", 2), (2, 1): ("the", 0), (3, 1): ("the", 0)}


def test_widths_of_table_sheets(spark):
    from quire.operators import convert

    cells = spark.createDataFrame([(1, 1, 1, 1, 1, "x" * 80), (1, 1, 1, 2, 2, ""), (1, 1, 1, 1, 3, "abc"), (1, 2, 0, 1, 1, "a line")], "doc_id long, page long, tbl long, row long, col long, value string")
    assert {(r["page"], r["col"]): r["width"] for r in convert.column_widths(cells).collect()} == {(1, 1): 60, (1, 2): 4, (1, 3): 7}
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [tuple(r) for r in convert.empty_workbooks(docs, cells).collect()] == [(2, "ריק", 1, 1, "לא נמצאו טבלאות")]


def test_broken_escapes_do_not_fail_a_form(spark):
    assert one(spark, text.form_fields(F.col("s")), s="a=%zz&b=1%202") == {"a": "%zz", "b": "1 2"}
    assert one(spark, text.query_fields(F.col("s")), s="a=1&a=&b&&c=x%3Dy=z") == {"a": "", "b": "", "c": "x=y=z"}


def test_translation_dispatch(spark):
    from quire.operators import translation

    p = spark.createDataFrame([(1, 1, "some words\nhere")], "doc_id long, page long, text string")
    b = spark.createDataFrame([(1, 1, 1, "some words", 0.0, 12.0)], "doc_id long, page long, block long, text string, y0 double, y1 double")
    upper = lambda ts: [t.upper() for t in ts]
    assert translation.translate(p, b, upper, "en").first()["result"] == "SOME WORDS"
    assert translation.translate(p, b, upper, "iw", keep_layout=False).first()["text"] == "WORDS SOME\nHERE"
    with pytest.raises(ValueError, match="unknown"):
        translation.translate(p, b, upper, "xx")


def test_unlocking(spark):
    from quire.operators import protection

    rows = [(1, b"plain", "pw", None, 516), (2, b"", "pw", "boss", 512), (3, b"x" * 100, "pw", "", 4)]
    locked = protection.protect(spark.createDataFrame(rows, "id long, content binary, password string, owner_password string, mask long"))
    asked = {1: ["pw", "pw_owner", "other", ""], 2: ["pw", "boss", "pw_owner", None], 3: ["pw", "pw_owner", "boss", "PW"]}
    tries = spark.createDataFrame([(i, k, p) for i, ps in asked.items() for k, p in enumerate(ps)], "id long, k int, password string")
    got = protection.unlock(locked.join(tries, "id").withColumn("id", F.col("id") * 10 + F.col("k"))).collect()
    for r in got:
        content, mask = rows[r["id"] // 10 - 1][1], rows[r["id"] // 10 - 1][4]
        assert (r["content"], r["error"], r["mask"]) == ((bytes(content), None, mask) if r["id"] % 10 < 2 else (None, "Incorrect password", mask))
    free = protection.unlock(spark.createDataFrame([(1, b"never locked", "x"), (2, None, "x")], "id long, content binary, password string")).collect()
    assert [(r["content"], r["error"]) for r in sorted(free, key=lambda r: r["id"])] == [(b"never locked", None), (None, None)]


def test_files_are_listed_without_bytes(spark, tmp_path):
    from quire.sources import tables

    for name, size in (("a/x.bin", 10), ("a/y.bin", 5), ("b/c/z.bin", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * size)
    files = tables.files(spark, str(tmp_path))
    assert "content" not in files.columns
    top = F.regexp_extract("path", f"{tmp_path.name}/([^/]+)/", 1)
    got = storage.disk_usage(files.select(top.alias("directory"), F.col("length").alias("size"))).collect()
    assert {r["directory"]: (r["n_files"], r["bytes"]) for r in got} == {"a": (2, 15), "b": (1, 7), "total": (3, 22)}


def test_display_without_the_library(spark):
    if __import__("importlib.util").util.find_spec("bidi"):
        pytest.skip("the library is installed")
    assert one(spark, text.display(F.col("s"), "ar"), s="a b\n\nc d") == "b a\n\nd c"


def test_registry_suffix_and_expiry(spark):
    df = spark.sql("select 1L as file_id, 'x' as original_name, 5L as size, timestamp_ntz'2024-01-01 00:00:00' as created_at")
    r = storage.register(df).first()
    assert (r["suffix"], r["download_url"]) == (".bin", "/files/1.bin")
    assert storage.expired(storage.register(df), F.expr("timestamp_ntz'2024-01-01 01:00:00'")).count() == 0


@given(st.lists(st.text("ab\\\f\n", max_size=6), min_size=1, max_size=4))
def test_text_codec(parts):
    codec = codecs.TextCodec()
    assert codec.decode(codec.encode(parts)) == parts


def test_missing_codec_says_so():
    if __import__("importlib.util").util.find_spec("fitz"):
        pytest.skip("PyMuPDF is installed")
    with pytest.raises(codecs.CodecMissing):
        codecs.PdfCodec().decode(b"")


def test_streams_end_like_batches(spark, sf):
    from quire.plans import catalogue

    stream = sorted(map(tuple, catalogue.QUERIES["stream_usage"](spark, sf).select("user_id", "day", "n").collect()))
    assert stream == sorted(map(tuple, catalogue.QUERIES["usage_daily"](spark, sf).select("user_id", "day", "n").collect()))


def test_page_source_round_trip(spark, tmp_path):
    from quire.sources import datasource

    datasource.register(spark)
    rows = [(1, 1, "a\fb"), (1, 2, None), (2, 1, "x\\f"), (2, 2, "שלום"), (2, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, page long, text string").repartition(2, "doc_id").sortWithinPartitions("doc_id", "page")
    df.write.format("quire_pages").mode("append").save(str(tmp_path))
    got = spark.read.format("quire_pages").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(d, p, t or "") for d, p, t in rows]
    some = spark.read.format("quire_pages").option("pages", "1,3").load(str(tmp_path))
    assert sorted((r["doc_id"], r["page"]) for r in some.collect()) == [(1, 1), (2, 1), (2, 3)]


def test_a_document_in_two_partitions_fails_and_leaves_nothing(spark, tmp_path):
    from quire.sources import datasource

    datasource.register(spark)
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "doc_id long, page long, text string").repartition(1)
    twice = df.unionByName(df)
    with pytest.raises(Exception, match="more than one partition"):
        twice.write.format("quire_pages").mode("append").save(str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    """Commit and rollback: a table write that fails half way isn't there for readers."""
    path = f"{tmp_path}/t"
    spark.range(10).write.parquet(path)
    with pytest.raises(Exception, match="broken"):
        spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id")).write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 10


def test_streams_without_input(spark, tmp_path):
    from quire.streaming import streams

    spark.range(0).selectExpr("id as event_id", "id as user_id", "timestamp_ntz'2024-01-01' as ts", "'a' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0).selectExpr("id as o_orderkey", "date'2024-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    for x in (tmp_path / "events.parquet", tmp_path / "orders.parquet"):
        schema = spark.read.parquet(str(x)).schema
        for f in x.glob("part*"):
            f.unlink()
        assert streams.run(spark.readStream.schema(schema).parquet(str(x)), [schema.fieldNames()[0]]).count() == 0


def test_stream_state_is_bounded(spark, sf):
    """Every stateful operator has a watermark, so none of its state stays for ever."""
    from quire.streaming import streams

    seen = []
    real, streams.run = streams.run, lambda stream, *a, **k: seen.append(stream._jdf.queryExecution().logical().toString())
    try:
        streams.daily_usage(spark, sf), streams.hourly_rate(spark, sf, 1), streams.first_payments(spark, sf)
    finally:
        streams.run = real
    assert len(seen) == 3 and all("EventTimeWatermark" in x for x in seen)


def test_no_machine_local_folder_on_a_cluster():
    from quire import workers

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workers.work_root(Session)


def test_entry_hides_no_broken_import(tmp_path):
    """Without the subpackage the entry has its other queries; a broken import inside it is an error."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    for name in ("quire", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len([x for x in e.queries() if x.startswith('op') and x[2].isdigit()]))"], cwd=tmp_path, capture_output=True, text=True)
    if (tmp_path / "quire/llm").exists():
        assert run().stdout.strip() == "10"
        (tmp_path / "quire/llm/topk.py").write_text("import no_such_module\n")
        assert "no_such_module" in run().stderr
        shutil.rmtree(tmp_path / "quire/llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run().stdout.strip() == "0"


def test_tokens():
    from quire.operators import requests

    good = requests.token("u1", 100, 200, "k")
    assert requests.subject(good, 150, "k") == "u1"
    assert [requests.subject(*x) for x in ((good, 200, "k"), (good, 150, "other"), (good[:-2], 150, "k"), ("", 1, "k"), (None, 1, "k"), ("a.b.c", 1, "k"))] == [None] * 6


def test_failed_slices_leave_text_alone(spark):
    from quire.operators import translation

    df = spark.createDataFrame([("a" * 4500 + "bad",), ("ok",), ("ok",)], "text string")
    got = dict(map(tuple, translation.translate_texts(df, lambda ts: [None if t == "bad" else t.upper() for t in ts]).collect()))
    assert got == {"a" * 4500 + "bad": None, "ok": "OK"}


def test_languages_fall_back(spark):
    from quire.operators import requests

    some = spark.createDataFrame([("osd",), ("eng",)], "code string")
    assert [r[0] for r in requests.languages(some, ["heb"]).collect()] == ["eng"]
    assert [r[0] for r in requests.languages(some.where("code = 'osd'"), ["heb"]).collect()] == ["heb"]


def test_clean_removes_intermediate_tables(spark):
    from quire import workers

    path = workers.shared_dir(spark)
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    workers.clean(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
