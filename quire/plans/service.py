"""More of the document engine's registered queries: requests, tokens, translated pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import requests, translation
from quire.plans.catalogue import _FILES, _LINES, _PAGES, _docs, _strip, query
from quire.sources import tables as src
from quire.workers import reach

_SETTINGS = """select event_id as id, element_at(array('level', 'angle', 'dpi', 'quality', 'mode', 'other', 'n_images', 'n_files', 'every_n'), cast(event_id % 9 as int) + 1) as setting,
  element_at(array('high', '90', '72', '101', 'pages', '0', 'best', '45', 'x', '10', null, '1'), cast(event_id % 12 as int) + 1) as value from {events}"""
_RANGE = "case setting when 'dpi' then n between 72 and 300 when 'quality' then n between 10 and 100 when 'n_images' then n between 0 and 50 when 'n_files' then n between 2 and 20 when 'every_n' then n between 1 and 10000 end"


@query(f"""with s as (select event_id as id, ['level', 'angle', 'dpi', 'quality', 'mode', 'other', 'n_images', 'n_files', 'every_n'][event_id % 9 + 1] as setting,
  ['high', '90', '72', '101', 'pages', '0', 'best', '45', 'x', '10', null, '1'][event_id % 12 + 1] as value from events), v as (select *, try_cast(value as bigint) as n from s)
select id, setting, value, cast(case when setting = 'other' then 404 when setting = 'level' then if(value is not distinct from 'high', 200, 400) when setting = 'angle' then if(value is not distinct from '90', 200, 400)
  when setting = 'mode' then if(value is not distinct from 'pages', 200, 400) else if(coalesce({_RANGE}, false), 200, 422) end as int) as status from v""")
def settings_check(spark, sf):
    return requests.check_settings(spark.sql(_SETTINGS, events=src.table(spark, sf, "events")))


@query("""select doc_id as id, level, true as deflate, true as clean, cast(case level when 'low' then 1 when 'high' then 3 when 'extreme' then 4 else 2 end as int) as garbage, level is distinct from 'low' as linear,
  cast(case level when 'low' then 40 when 'high' then 40 when 'extreme' then 25 else 60 end as int) as quality
  from (select doc_id, ['low', 'medium', 'high', 'extreme', 'best', null][doc_id % 6 + 1] as level from documents)""")
def compression_plan(spark, sf):
    level = F.expr("element_at(array('low', 'medium', 'high', 'extreme', 'best', null), cast(doc_id % 6 as int) + 1)")
    return requests.compression_plan(_docs(spark, sf).select(F.col("doc_id").alias("id"), level.alias("level")))


@query(f"with {_FILES}, w as (select doc_id * 2 as file_id from documents) select w.file_id, original_name, size, cast(case when size is null then 404 else 200 end as int) as status from w left join files on files.file_id = w.file_id")
def file_lookup(spark, sf):
    return requests.look_up(src.stored_files(_docs(spark, sf)), _docs(spark, sf).selectExpr("doc_id * 2 as file_id"))


@query("select distinct lang as code from documents where lang <> 'fr'")
def ocr_languages(spark, sf):
    installed = _docs(spark, sf).selectExpr("case lang when 'fr' then 'osd' else lang end as code").distinct()
    return requests.languages(installed, ["heb", "eng", "ara"])


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || 'Z' as iso, 'תאריך: ' || strftime(ts, '%d/%m/%Y') as date_line from events")
def response_times(spark, sf):
    return src.table(spark, sf, "events").select("event_id", requests.iso_z(F.col("ts")).alias("iso"), requests.date_line(F.col("ts")).alias("date_line"))


_MD5 = "md5(cast(o_orderkey as varchar))"
_UUID = f"substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-' || substr({_MD5}, 13, 20)"


@query(f"select o_orderkey as id, upper(substr({_UUID}, 1, 12)) as order_id, 'merged_' || substr(replace({_UUID}, '-', ''), 1, 8) || '.pdf' as temp_name from orders")
def generated_names(spark, sf):
    rows = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    uuid = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 20))
    return rows.select("id", requests.order_id(uuid).alias("order_id"), requests.temp_name("merged", uuid, ".pdf").alias("temp_name"))


@query("select doc_id, 'T' || doc_id as title, case when doc_id % 2 = 0 then lang else '' end as author, '' as subject, '' as creator, source as producer, '' as creation_date from documents")
def document_metadata(spark, sf):
    fields = F.create_map(F.lit("title"), F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.lit("author"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.lit("producer"), F.col("source"))
    return requests.metadata(_docs(spark, sf).select("doc_id", F.map_filter(fields, lambda _, v: v.isNotNull()).alias("meta")))


@query("select o_custkey as id, min(o_orderkey) filter (o_orderkey % 3 = 0)::varchar as path from orders group by o_custkey")
def first_candidate(spark, sf):
    """Each customer's orders as places to look at, of which a third are there."""
    rows = src.table(spark, sf, "orders")
    return requests.first_existing(rows.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 3 == 0).alias("found")))


@query("select doc_id, cast(to_json({'doc_id': doc_id, 'lang': lang, 'n': n_chars}) as varchar) as body from documents")
def response_json(spark, sf):
    return _docs(spark, sf).select("doc_id", F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("n"))).alias("body"))


def _token(i: int) -> str:
    good = requests.token(str(i), 500, 900 if i % 4 == 0 else 2_000, "other" if i % 4 == 1 else "secret")
    return good[:-3] if i % 4 == 2 else good


@query("select c_custkey as id, case when c_custkey % 4 = 3 then c_custkey::varchar end as subject from customer")
def token_subjects(spark, sf):
    """Tokens of four kinds: expired, signed with another secret, broken, good."""
    reach(spark)
    make = F.pandas_udf(lambda s: s.map(_token), "string")
    return requests.verify_tokens(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), make("c_custkey").alias("token")), "secret", 1_000)


def _stub(texts: list[str]) -> list[str | None]:
    """Stands for a translation engine: marks a text, fails on some, leaves some as they are."""
    return [None if len(t) % 5 == 0 else t if len(t) % 5 == 1 else f"[{t}]" for t in texts]


_STUB = "case when length(text) % 5 = 0 then null when length(text) % 5 = 1 then text else '[' || text || ']' end"


@query(rf"""with {_PAGES}, p as (select doc_id, page, {_strip('text')} as text from doc_pages), t as (select *, coalesce({_STUB}, text) as r from p where text <> '')
select doc_id, page, array_to_string(list_transform(list_transform({_LINES}, lambda x: x[1]),
  lambda y: case when {_strip('y')} = '' then y else array_to_string(list_reverse(list_filter(string_split_regex(y, '\s+'), lambda w: w <> '')), ' ') end), chr(10)) as text
from (select doc_id, page, string_split_regex(r, '\r\n|[\n\x0b\f\r\x85\x{{2028}}\x{{2029}}]') as l from t)""")
def translate_clean(spark, sf):
    return translation.clean(src.doc_pages(_docs(spark, sf)), _stub, "iw")


def _stub_slices(texts: list[str]) -> list[str | None]:
    """As _stub, by sevenths: a full slice of 4500 characters is translated, where _stub fails on it."""
    return [None if len(t) % 7 == 0 else t if len(t) % 7 == 1 else f"[{t}]" for t in texts]


@query(rf"""with b as (select doc_id, cast(k as bigint) as block, {_strip('l[k]')} as text from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) u(k)),
s as (select *, list_transform(range(0, (length(text) - 1) // 4500 + 1), lambda i: substr(text, cast(i * 4500 + 1 as bigint), 4500)) as slices from b where length(text) >= 2),
p as (select *, list_transform(slices, lambda x: case when length(x) % 7 = 0 then null when length(x) % 7 = 1 then x else '[' || x || ']' end) as parts from s),
t as (select *, case when len(list_filter(parts, lambda x: x is null)) = 0 then array_to_string(parts, ' ') end as tr from p)
select doc_id, cast(1 as bigint) as page, block, tr as result, greatest(7.0, least(cast(block % 7 + 8 as double) * 0.75, 13.0)) as font_size, 'left' as align from t where tr <> text""")
def translate_overlay(spark, sf):
    b = _docs(spark, sf).select("doc_id", F.lit(1).cast("long").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("block", (F.col("i") + 1).cast("long"))
    return translation.overlay(b.withColumns({"y0": F.lit(0.0), "y1": (F.col("block") % 7 + 8).cast("double")}), _stub_slices, "en")
