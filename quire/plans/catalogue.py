"""The document engine's registered queries, each with SQL for the same rows where SQL can express it.

Requests that a user would send are derived from the tables' keys, by the same text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout, text
from quire.operators import accounts, billing, convert, pages, protection, recognition, storage
from quire.sources import codecs
from quire.sources import tables as src
from quire.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PAGES = """doc_pages as (select doc_id, cast(i + 1 as bigint) as page, substr(text, cast(i * 1000 + 1 as bigint), 1000) as text
  from documents, unnest(range(0, (greatest(length(text), 1) - 1) // 1000 + 1)) u(i))"""
_SIZES = "sizes as (select doc_id, cast((greatest(length(text), 1) - 1) // 1000 + 1 as bigint) as n_pages from documents)"
_USERS = """users as (select c_custkey as id, 'user' || c_custkey || '@mail.test' as email, c_name as full_name,
  case c_mktsegment when 'BUILDING' then 'pro' when 'MACHINERY' then 'enterprise' else 'free' end as plan, c_acctbal >= 0 as is_active from customer)"""
_ORDERS = """pay as (select o_orderkey as order_id, o_custkey as user_id, case when o_orderkey % 3 = 0 then 'enterprise' else 'pro' end as plan,
  case when o_orderkey % 3 = 0 then 129 else 39 end as amount, case o_orderstatus when 'F' then 'failed' when 'O' then 'completed' else 'pending' end as status,
  o_orderdate as created_at from orders)"""
_SUBS = f"""{_ORDERS}, subs as (select user_id, plan, amount, created_at + interval 30 day as next_charge,
  case when user_id % 7 = 0 then '' else 'tok' || user_id end as token, user_id % 11 = 0 as cancelled
  from (select *, row_number() over (partition by user_id order by created_at desc, order_id desc) as k from pay where status = 'completed') where k = 1)"""
_FILES = """files as (select doc_id as file_id, 'Report ' || doc_id || ' (v1)' || suffix as original_name, suffix, cast(strlen(text) as bigint) as size,
  timestamp '2024-01-01' + to_seconds(doc_id * 7) as created_at, timestamp '2024-01-01' + to_seconds(doc_id * 7 + 3600) as expires_at
  from (select *, ['.pdf', '.docx', '.png', '.txt'][doc_id % 4 + 1] as suffix from documents))"""
_BOXES = """boxes as (select p_partkey as id, cast(p_size + 100 as double) as w, cast(p_retailprice as double) as h from part)"""
_WORDS = f"""{_PAGES}, words as (select doc_id, page, w, list_transform(range(1, len(w) + 1), lambda i: cast((doc_id * 31 + page * 13 + (i - 1) * 17) % 102 - 1 as int)) as c
  from (select *, string_split(text, ' ') as w from doc_pages))"""
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "documents")


def _sized(p: DataFrame) -> DataFrame:
    """Pages with a size that depends on the document."""
    return p.withColumns({"width_pt": F.expr("cast(case when doc_id % 3 = 0 then 612 else 595.276 end as double)"), "height_pt": F.expr("cast(case when doc_id % 3 = 0 then 792 else 841.89 end as double)")})


_SIZED = "select *, cast(case when doc_id % 3 = 0 then 612 else 595.276 end as double) as width_pt, cast(case when doc_id % 3 = 0 then 792 else 841.89 end as double) as height_pt from"
_LIST = """case doc_id % 10 when 0 then '3,1,3' when 1 then '-1,x' when 2 then '9' when 3 then '0,2' when 4 then '' when 5 then ' 2 , 1' when 6 then '99999999999' when 7 then '99999999999999999999,x'
  when 8 then '٢,١' else '00000000000000000001' end"""
_ASKED = f"""{_SIZES}, asked as (select doc_id, n_pages, list_transform(list_filter(string_split({_LIST}, ','), lambda p: regexp_full_match(trim(p), '\\p{{Nd}}+')), lambda p: coalesce(try_cast(translate(trim(p), '١٢', '12') as bigint), 9223372036854775807)) as l
  from sizes), chosen as (select doc_id, n_pages, list_filter(@@, lambda p: p >= 1 and p <= n_pages) as l from asked),
  picked as (select doc_id, cast(k as bigint) as ordinal, l[k] as page from chosen, unnest(range(1, len(l) + 1)) u(k))"""
_ALL = _ASKED.replace("@@", "case when len(l) = 0 then range(1, n_pages + 1) else l end")
_NONE = _ASKED.replace("@@", "l")


def _request(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.expr(_LIST).alias("pages"))


# ---- pages


@query(f"with {_SIZES} select source as out_id, row_number() over (partition by source order by d.doc_id, i) as out_page, d.doc_id, cast(i as bigint) as page from documents d join sizes s on s.doc_id = d.doc_id, unnest(range(1, n_pages + 1)) u(i)")
def merge_documents(spark, sf):
    request = _docs(spark, sf).select(F.col("source").alias("out_id"), F.col("doc_id").alias("ordinal"), "doc_id")
    return pages.merge(src.doc_sizes(_docs(spark, sf)), request)


@query("""with r as (select doc_id // 3 as out_id, doc_id from documents union all select doc_id // 50 + 1000000, doc_id from documents where doc_id % 50 < 25
  union all select 2000000 + doc_id, doc_id + 100000000 from documents where doc_id % 100 < 2),
k as (select doc_id, 'f' || doc_id || case when doc_id % 17 = 0 then '.PNG' else '.PDF' end as name from documents),
j as (select out_id, count(*) as n, count(*) filter (k.name is null) as missing, count(*) filter (k.name like '%.PNG') as odd from r left join k on k.doc_id = r.doc_id group by out_id)
select out_id, n, case when n < 2 or n > 20 then 'count' when missing > 0 then 'missing' when odd > 0 then 'suffix' end as error from j""")
def merge_checked(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    request = docs.selectExpr("doc_id div 3 as out_id", "doc_id").unionAll(docs.where("doc_id % 50 < 25").selectExpr("doc_id div 50 + 1000000", "doc_id")).unionAll(docs.where("doc_id % 100 < 2").selectExpr("2000000 + doc_id", "doc_id + 100000000"))
    known = docs.selectExpr("doc_id", "concat('f', doc_id, case when doc_id % 17 = 0 then '.PNG' else '.PDF' end) as name")
    return pages.merge_checked(request, known)


_RANGES = "case doc_id % 8 when 0 then '1-3' when 1 then '4, 1' when 2 then '0-2,2-99' when 3 then '7-3' when 4 then '3-,1' when 5 then 'a' when 6 then '1-2-3,-3' else ' 2 - 4 ,,99' end"


@query(f"""with {_SIZES}, r as (select doc_id, n_pages, list_filter(list_transform(string_split({_RANGES}, ','), lambda x: trim(x)), lambda x: x <> '') as l from sizes),
p as (select doc_id, n_pages, cast(k as bigint) as part, l[k] as r from r, unnest(range(1, len(l) + 1)) u(k)),
q as (select *, contains(r, '-') as dash, try_cast(trim(split_part(r, '-', 1)) as bigint) as a, try_cast(trim(substr(r, position('-' in r) + 1)) as bigint) as b, try_cast(r as bigint) as one from p),
s as (select *, case when dash then a is null or b is null else one is null end as bad,
  case when dash then greatest(1, a) else one end as f, case when dash then least(n_pages, b) when one between 1 and n_pages then one else one - 1 end as l from q)
select doc_id, part, case when not bad then f end as first, case when not bad then l end as last, case when bad then 'value' when f > l then 'empty' end as error from s""")
def split_ranges(spark, sf):
    return pages.split_ranges(src.doc_sizes(_docs(spark, sf)), _docs(spark, sf).select("doc_id", F.expr(_RANGES).alias("ranges")))


@query(f"with {_SIZES} select doc_id, cast(i as bigint) as part, cast((i - 1) * 4 + 1 as bigint) as first, cast(least(i * 4, n_pages) as bigint) as last from sizes, unnest(range(1, (n_pages + 3) // 4 + 1)) u(i)")
def split_every_n(spark, sf):
    return pages.split_every(src.doc_sizes(_docs(spark, sf)), 4)


@query(f"with {_ALL} select doc_id, ordinal, page from picked")
def select_pages_default_all(spark, sf):
    return pages.select_pages(_request(spark, sf), src.doc_sizes(_docs(spark, sf)))


@query(f"with {_NONE} select doc_id, ordinal, page from picked")
def extract_pages(spark, sf):
    return pages.extract_pages(_request(spark, sf), src.doc_sizes(_docs(spark, sf)))


@query(f"""with {_SIZES}, p as (select doc_id, n_pages, cast(i as bigint) as part from sizes, unnest(range(1, (n_pages + 3) // 4 + 1)) u(i))
select doc_id, count(*) as total_parts, cast(sum(least(part * 4, n_pages) - (part - 1) * 4) as bigint) as total_pages from p group by doc_id""")
def split_totals(spark, sf):
    return pages.totals(split_every_n(spark, sf))


@query(f"with {_PAGES}, {_ALL} select p.doc_id, p.page, case when exists (select 1 from picked k where k.doc_id = p.doc_id and k.page = p.page) then 90 else 0 end as rotation from doc_pages p")
def rotate_pages(spark, sf):
    docs = _docs(spark, sf)
    return pages.rotate(src.doc_pages(docs).select("doc_id", "page"), _request(spark, sf), src.doc_sizes(docs), 90)


def _chosen(spark, sf):
    return pages.select_pages(_request(spark, sf), src.doc_sizes(_docs(spark, sf)))


@query(f"with {_ALL} select doc_id, page, width_pt / 2 - 48.0::double * 12 * 0.3::double as x, height_pt / 2 as y, 'CONFIDENTIAL' as mark, cast(204 as double) / 255 as r, cast(0 as double) as g, cast(51 as double) / 255 as b from ({_SIZED} picked)")
def watermark_text(spark, sf):
    rows = pages.watermark_text(_sized(src.doc_pages(_docs(spark, sf)).select("doc_id", "page")), _chosen(spark, sf), "CONFIDENTIAL", 48.0, "#CC0033")
    return rows.select("doc_id", "page", "box.x", "box.y", "mark", "colour.r", "colour.g", "colour.b")


@query(f"with {_ALL} select doc_id, page, width_pt * 0.3 as x0, height_pt * 0.3 as y0, width_pt * 0.7 as x1, height_pt * 0.7 as y1 from ({_SIZED} picked)")
def watermark_image(spark, sf):
    return pages.watermark_image(_sized(src.doc_pages(_docs(spark, sf)).select("doc_id", "page")), _chosen(spark, sf)).select("doc_id", "page", "box.*")


@query(f"""with {_SIZES}, s as ({_SIZED} (select doc_id, n_pages, case when doc_id % 4 = 0 then n_pages when doc_id % 4 = 1 then 1 else least(greatest(doc_id % 9 - 1, 0), n_pages - 1) + 1 end as page from sizes))
select doc_id, page, width_pt * 0.5 as x0, height_pt * 0.75 as y0, width_pt * 0.5 + width_pt * 0.25 as x1, height_pt * 0.75 + 40 as y1,
  width_pt * 0.5 + 6 as text_x, height_pt * 0.75 + 30 as text_y, width_pt * 0.5 + 6 as date_x, height_pt * 0.75 + 54 as date_y from s""")
def sign_layout(spark, sf):
    docs = _docs(spark, sf)
    request = docs.selectExpr("doc_id", "case when doc_id % 4 = 0 then -1 when doc_id % 4 = 1 then 0 else doc_id % 9 end as page", "cast(0.5 as double) as x", "cast(0.75 as double) as y")
    return pages.sign(_sized(src.doc_pages(docs).select("doc_id", "page")), src.doc_sizes(docs), request).select("doc_id", "page", "box.*")


_TERMS = ["the", "de.", "und"]
_RED = "text"
for _t in _TERMS:
    _RED = f"regexp_replace({_RED}, '(?i)' || regexp_escape('{_t}'), '{'█' * len(_t)}', 'g')"


@query(f"with {_PAGES} select doc_id, page, {_RED} as text from doc_pages")
def redact_text(spark, sf):
    return pages.redact(src.doc_pages(_docs(spark, sf)), _TERMS).drop("n_redacted")


@query(f"""with {_PAGES}, {_ALL}, m as (select p.doc_id, p.page, text, exists (select 1 from picked k where k.doc_id = p.doc_id and k.page = p.page) as chosen from doc_pages p)
select doc_id, page, case when chosen then {_RED} else text end as text, cast(case when chosen then len(regexp_extract_all(text, '(?i)the|de\\.|und')) else 0 end as bigint) as n_redacted from m""")
def redact_selected(spark, sf):
    docs = _docs(spark, sf)
    return pages.redact(src.doc_pages(docs), _TERMS, request=_request(spark, sf), sizes=src.doc_sizes(docs))


@query(f"""with {_PAGES}, m as (select doc_id, list_transform(regexp_extract_all(text, '(?i)the|de\\.|und'), lambda x: 1) as l from doc_pages)
select doc_id, cast(sum(len(l)) as bigint) as n_redacted from m group by doc_id""")
def redact_counts(spark, sf):
    return pages.redact(src.doc_pages(_docs(spark, sf)), _TERMS).groupBy("doc_id").agg(F.sum("n_redacted").alias("n_redacted"))


@query(f"with {_PAGES} select doc_id, count(*) as page_count, min(page) as first_page, max(page) as last_page, sum(round(width_pt, 2)) / count(*) as width_pt, max(round(height_pt, 2)) as height_pt from ({_SIZED} doc_pages) group by doc_id")
def document_info(spark, sf):
    i = pages.info(_sized(src.doc_pages(_docs(spark, sf)).select("doc_id", "page")))
    p = F.col("pages")
    width = F.aggregate(p, F.lit(0.0), lambda a, x: a + x["width_pt"]) / F.size(p)
    return i.select("doc_id", "page_count", F.element_at(p, 1)["page"].alias("first_page"), F.element_at(p, -1)["page"].alias("last_page"), width.alias("width_pt"), F.element_at(p, 1)["height_pt"].alias("height_pt"))


_BREAK = "chr(10) || chr(10) || '--- עמוד חדש ---' || chr(10) || chr(10)"


@query(f"with {_PAGES} select doc_id, string_agg(text, {_BREAK} order by page) as text, length(string_agg(text, {_BREAK} order by page)) as char_count from doc_pages group by doc_id")
def document_text(spark, sf):
    return pages.document_text(src.doc_pages(_docs(spark, sf)))


@query(f"""with {_PAGES}, r as (select doc_id, page, 1 as seq, text from doc_pages union all select doc_id, page, 2, case when page % 3 = 0 then '  ' else 'OCR ' || text end from doc_pages where doc_id % 2 = 0),
l as (select *, row_number() over (partition by doc_id, page order by seq desc) as k from r) select doc_id, page, 10 as x, 20 as y, 1 as size, text from l where k = 1 and {_strip('text')} <> ''""")
def searchable_layer(spark, sf):
    """Each page's whole text; the second text has a word before it."""
    p = src.doc_pages(_docs(spark, sf))
    r = p.selectExpr("doc_id", "page", "1 as seq", "text").unionAll(p.where("doc_id % 2 = 0").selectExpr("doc_id", "page", "2", "case when page % 3 = 0 then '  ' else 'OCR ' || text end"))
    return pages.search_layer(p, r)


@query(f"with {_ALL} select doc_id, ordinal, page, cast(ceil(width_pt * 150 / 72) as bigint) as width_px, cast(ceil(height_pt * 150 / 72) as bigint) as height_px, 'doc' || doc_id || '_page' || ordinal || '.png' as name from ({_SIZED} picked)")
def render_sizes(spark, sf):
    return pages.render_sizes(_sized(src.doc_pages(_docs(spark, sf)).select("doc_id", "page")), _chosen(spark, sf), 150)


# ---- recognition

_GOOD = f"list_transform(list_filter(list_zip(w, c), lambda x: {_strip('x[1]')} <> '' and x[2] > 20), lambda x: x[1])"
_CONF = """case when len(list_filter(c, lambda x: x > 0)) = 0 then 0.0 else
  cast((20 * list_sum(list_filter(c, lambda x: x > 0)) + len(list_filter(c, lambda x: x > 0))) // (2 * len(list_filter(c, lambda x: x > 0))) as double) / 1000 end"""
_REC = f"{_WORDS}, rec as (select doc_id, page, array_to_string({_GOOD}, ' ') as text, cast({_CONF} as double) as confidence, 'ocr' as source from words)"


def _words(spark, sf):
    return src.words(src.doc_pages(_docs(spark, sf)))


@query(f"with {_WORDS} select doc_id, page, cast(len(l) as bigint) as n_words, array_to_string(l, ' ') as text from (select doc_id, page, {_GOOD} as l from words)")
def ocr_words_filtered(spark, sf):
    good = recognition.good_words(F.col("words"), F.col("conf"))
    return _words(spark, sf).select("doc_id", "page", F.size(good).cast("long").alias("n_words"), F.array_join(good, " ").alias("text"))


@query(f"with {_REC} select * from rec")
def ocr_page_records(spark, sf):
    return recognition.page_records(_words(spark, sf))


@query(f"with {_REC} select doc_id, string_agg(text, chr(10) || chr(10) order by page) as text, cast((2 * sum(cast(round(confidence * 1000) as bigint)) + count(*)) // (2 * count(*)) as double) / 1000 as confidence, count(*) as page_count from rec group by doc_id")
def ocr_document(spark, sf):
    return recognition.document_records(recognition.page_records(_words(spark, sf)))


@query(f"with {_REC} select doc_id, string_agg('=== עמוד ' || page || ' ===' || chr(10) || text || chr(10), chr(10) order by page) as content from rec group by doc_id")
def ocr_txt_export(spark, sf):
    return recognition.text_export(recognition.page_records(_words(spark, sf)))


@query(f"""with {_REC}, n as (select doc_id, page, {_strip('text')} as text from doc_pages)
select doc_id, page, text, cast(1.0 as double) as confidence, 'native' as source from n where length(text) > 50 union all
select r.* from rec r join n on n.doc_id = r.doc_id and n.page = r.page where length(n.text) <= 50""")
def native_or_ocr_routing(spark, sf):
    return recognition.routed(src.doc_pages(_docs(spark, sf)), _words(spark, sf))


_LINES = r"""list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: x[2] < len(l) or x[1] <> '')"""


@query(rf"""with {_REC}, b as (select doc_id, page, 0 as part, cast(0 as bigint) as k, 'Heading 2' as style, 'עמוד ' || page as text from rec union all
select doc_id, page, 1, x[2], 'Body', x[1] from (select doc_id, page, unnest({_LINES}) as x from (select *, string_split_regex(text, '\r\n|[\n\x0b\f\r\x85\x{{2028}}\x{{2029}}]') as l from rec)) union all
select doc_id, page, 2, 0, 'Body', '' from rec union all select distinct doc_id, 0, 0, 0, 'Heading 1', 'OCR' from rec)
select doc_id, row_number() over (partition by doc_id order by page, part, k) - 1 as seq, style, text from b""")
def ocr_docx_paragraphs(spark, sf):
    return recognition.paragraphs(recognition.page_records(_words(spark, sf)))


# ---- conversions


_LINE_CELLS = rf"""{_PAGES}, cells as (select doc_id, page, cast(0 as bigint) as tbl, x[2] as row, cast(1 as bigint) as col, x[1] as value
  from (select doc_id, page, unnest({_LINES}) as x from (select *, string_split_regex(text, '\r\n|[\n\x0b\f\r\x85\x{{2028}}\x{{2029}}]') as l from doc_pages)))"""


@query(f"with {_LINE_CELLS} select * from cells")
def text_line_cells(spark, sf):
    return convert.line_cells(src.doc_pages(_docs(spark, sf)))


_TABLE_CELLS = """with c as (select o_orderkey as doc_id, cast(1 as bigint) as page, cast(1 as bigint) as tbl, cast(1 as bigint) as row, unnest([1, 2, 3]) as k, o_orderstatus, o_orderpriority, o_custkey from orders union all
select o_orderkey, 1, 2, 1, unnest([1, 2]), o_orderpriority, null, 0 from orders where o_orderkey % 2 = 0)
select doc_id, page, tbl, row, cast(k as bigint) as col, case when k = 1 then o_orderstatus when k = 2 then coalesce(o_orderpriority, '') when o_custkey % 2 = 0 then '' else cast(o_custkey as varchar) end as value from c"""


@query(_TABLE_CELLS)
def table_cells(spark, sf):
    one = F.expr("array(array(o_orderstatus, o_orderpriority, case when o_custkey % 2 = 0 then null else cast(o_custkey as string) end))")
    two = F.expr("array(array(o_orderpriority, cast(null as string)))")
    t = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("tables"))
    return convert.table_cells(t)


@query(f"select doc_id, page, tbl, col, cast(least(max(length(value)) + 4, 60) as bigint) as width from ({_TABLE_CELLS}) group by all")
def column_widths(spark, sf):
    """Of the tables; the lines of pages without tables go in, and have none."""
    return convert.column_widths(table_cells(spark, sf).unionByName(convert.line_cells(src.doc_pages(_docs(spark, sf)))))


@query("select doc_id, 'ריק' as sheet, cast(1 as bigint) as row, cast(1 as bigint) as col, 'לא נמצאו טבלאות' as value from documents where doc_id not in (select o_orderkey from orders)")
def empty_workbooks(spark, sf):
    return convert.empty_workbooks(_docs(spark, sf), table_cells(spark, sf))


@query("""select o_orderkey as doc_id, cast(1 as bigint) as page, cast(1 as bigint) as tbl, 'עמ'' 1' as sheet from orders union all select o_orderkey, 1, 2, 'עמ'' 1 טבלה 2' from orders where o_orderkey % 2 = 0""")
def sheet_names(spark, sf):
    return convert.numbered_tables(table_cells(spark, sf))


@query(f"with {_PAGES} select doc_id, page, cast(trunc(w / 72 * 914400) as bigint) as width_emu, cast(trunc(h / 72 * 914400) as bigint) as height_emu from (select doc_id, page, first_value(width_pt) over (partition by doc_id order by page) as w, first_value(height_pt) over (partition by doc_id order by page) as h from ({_SIZED} doc_pages))")
def pptx_slides(spark, sf):
    return convert.slides(_sized(src.doc_pages(_docs(spark, sf)).select("doc_id", "page")))


@query(f"""with {_BOXES}, s as (select id, w * 72.0 / 96 as w, h * 72.0 / 96 as h, case id % 5 when 0 then 595 when 1 then 612 when 2 then 612 when 3 then 842 else 595 end as pw,
  case id % 5 when 0 then 842 when 1 then 792 when 2 then 1008 when 3 then 1190 else 842 end as ph from boxes), t as (select *, least(pw / w, ph / h) as k from s)
select id, (pw - w * k) / 2 as x0, (ph - h * k) / 2 as y0, (pw - w * k) / 2 + w * k as x1, (ph - h * k) / 2 + h * k as y1 from t""")
def image_fit_layout(spark, sf):
    names = ["A4", "Letter", "Legal", "A3", "Unknown"]
    sizes = [layout.PAGE_SIZES.get(n, layout.PAGE_SIZES["A4"]) for n in names]
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in sizes]), (F.col("id") % 5 + 1).cast("int"))
    b = _boxes(spark, sf).select("id", layout.points(F.col("w")).alias("w"), layout.points(F.col("h")).alias("h"))
    return b.select("id", layout.fit_rect(F.col("w"), F.col("h"), pick(0), pick(1)).alias("r")).select("id", "r.*")


def _boxes(spark, sf):
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).cast("double").alias("w"), F.col("p_retailprice").cast("double").alias("h"))


@query("""with b as (select p_partkey as id, cast(p_size * 150 as bigint) as w, cast(floor(p_retailprice * 3) as bigint) as h from part)
select id, cast(case when greatest(w, h) > 3000 then floor(w * (3000.0::double / greatest(w, h))) else w end as bigint) as w, cast(case when greatest(w, h) > 3000 then floor(h * (3000.0::double / greatest(w, h))) else h end as bigint) as h from b""")
def image_cap(spark, sf):
    b = src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 150).cast("long").alias("w"), F.floor(F.col("p_retailprice") * 3).cast("long").alias("h"))
    return b.select("id", layout.capped_size(F.col("w"), F.col("h")).alias("s")).select("id", "s.*")


@query("select p_partkey as id, cast(512 + case when p_partkey % 2 = 0 then 2052 else 0 end + case when p_partkey % 3 = 0 then 16 else 0 end + case when p_partkey % 5 = 0 then 40 else 0 end as int) as mask from part")
def permission_mask(spark, sf):
    flag = lambda n: F.col("p_partkey") % n == 0
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), layout.permissions(flag(2), flag(3), flag(5)).alias("mask"))


@query("select p_partkey as id, cast(p_partkey % 256 as double) / 255 as r, cast(p_size % 256 as double) / 255 as g, cast(204 as double) / 255 as b from part")
def hex_color(spark, sf):
    colour = F.expr("concat('#', lpad(hex(p_partkey % 256), 2, '0'), lpad(hex(p_size % 256), 2, '0'), 'cc')")
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), layout.rgb(colour).alias("c")).select("id", "c.*")


# ---- translation


@query("select doc_id, cast(i + 1 as bigint) as chunk, substr(text, cast(i * 4500 + 1 as bigint), 4500) as text from documents, unnest(range(0, (greatest(length(text), 1) - 1) // 4500 + 1)) u(i)")
def translate_chunks(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("chunk"), "text")


_L = rf"list_transform({_LINES}, lambda x: x[1])"


@query(rf"""select doc_id, array_to_string(list_transform({_L}, lambda y: case when {_strip('y')} = '' then y else array_to_string(list_reverse(list_filter(string_split_regex(y, '\s+'), lambda w: w <> '')), ' ') end), chr(10)) as text
from (select doc_id, string_split_regex(text, '\r\n|[\n\x0b\f\r\x85\x{{2028}}\x{{2029}}]') as l from documents)""")
def rtl_reverse_words(spark, sf):
    return _docs(spark, sf).select("doc_id", text.reverse_words(F.col("text")).alias("text"))


@query(rf"""with b as (select doc_id, cast(k as bigint) as block, {_strip('l[k]')} as text from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) u(k)),
t as (select *, case when length(text) % 3 = 0 then '' when length(text) % 3 = 1 then concat('T: ', text) else text end as tr from b where length(text) >= 2)
select doc_id, block, text, tr <> '' and tr <> text as changed, case when tr <> '' and tr <> text then tr else text end as result,
  greatest(7.0, least(cast(length(text) % 40 + 5 as double) / 2 * 0.75, 13.0)) as font_size from t""")
def translate_blocks(spark, sf):
    b = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("block"), "text")
    b = convert.translatable(b)
    once = b.select("text").distinct().withColumn("translation", F.expr("case when length(text) % 3 = 0 then '' when length(text) % 3 = 1 then concat('T: ', text) else text end"))
    size = layout.overlay_font_size((F.length("text") % 40 + 5).cast("double"), F.lit(2))
    return convert.translate(b, once).select("doc_id", "block", "text", "changed", "result", size.alias("font_size"))


_CODES = ", ".join(f"'{c}'" for c in [*convert.LANGUAGES, "auto"])


@query(f"select doc_id, code, code is not null and code in ({_CODES}) as valid from (select doc_id, case doc_id % 5 when 0 then 'en' when 1 then 'he' when 2 then 'iw' when 3 then 'auto' else lang end as code from documents)")
def language_validation(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.expr("case doc_id % 5 when 0 then 'en' when 1 then 'he' when 2 then 'iw' when 3 then 'auto' else lang end").alias("code"))
    return rows.withColumn("valid", convert.valid_language(F.col("code")))


@query("select lang, case lang when 'en' then 'English' when 'fr' then 'Français' when 'de' then 'Deutsch' when 'es' then 'Español' else lang end as name, count(*) as n_documents from documents group by 1, 2")
def language_names(spark, sf):
    dim = spark.createDataFrame(list(convert.LANGUAGES.items()), "lang string, name string")
    return _docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n_documents")).join(F.broadcast(dim), "lang", "left").select("lang", F.coalesce("name", "lang").alias("name"), "n_documents")


# ---- files


_UPLOADS = """select doc_id as file_id, case doc_id % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/csv' when 3 then 'application/msword' end as content_type,
  (doc_id % 7) * 100 * 1048576 + doc_id % 2 as length, case doc_id % 3 when 0 then 'pro' when 1 then 'free' end as plan from documents"""


def _upload_sql(types: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in sorted(types))
    return f"""with u as (select *, coalesce(content_type, '') not in ({listed}) as wrong, case when plan = 'pro' then 500 else 100 end as mb from ({_UPLOADS}))
select file_id, content_type, length, case when wrong then 415 when length / 1048576 > mb then 413 else 200 end as status,
  case when wrong then '{storage.WRONG_TYPE}' || coalesce(content_type, '') || '{storage.ALLOWED_TYPES}{', '.join(sorted(types))}'
    when length / 1048576 > mb then '{storage.TOO_LARGE}' || printf('%.1f', length / 1048576) || '{storage.AT_MOST}' || mb || 'MB' end as detail from u"""


def _uploads(spark, sf):
    return _docs(spark, sf).selectExpr("doc_id as file_id", "case doc_id % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/csv' when 3 then 'application/msword' end as content_type", "(doc_id % 7) * 100 * 1048576 + doc_id % 2 as length", "case doc_id % 3 when 0 then 'pro' when 1 then 'free' end as plan")


@query(_upload_sql([*storage.PDF, *storage.IMAGE]))
def upload_validation(spark, sf):
    return storage.validate_uploads(_uploads(spark, sf), [*storage.PDF, *storage.IMAGE])


@query(_upload_sql(list(storage.KNOWN)))
def upload_validation_known(spark, sf):
    return storage.validate_uploads(_uploads(spark, sf))


@query(r"""select page_id, left(regexp_replace(regexp_extract(url, '[^/]*$', 0), '[^\p{L}\p{N}_\-. ]', '_', 'g'), 200) as name from pages""")
def safe_filename(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query(f"with {_FILES} select file_id, 'Report ' || file_id || ' (v1)' as stem, suffix, 'Report ' || file_id || ' (v1)_compressed.pdf' as compressed_name, 'Report ' || file_id || ' (v1)_part' || (file_id % 3 + 1) || '.pdf' as part_name from files")
def output_names(spark, sf):
    f = src.stored_files(_docs(spark, sf))
    stem = text.stem(F.col("original_name"))
    part = F.concat(stem, F.lit("_part"), (F.col("file_id") % 3 + 1).cast("string"), F.lit(".pdf"))
    return f.select("file_id", stem.alias("stem"), text.suffix(F.col("original_name")).alias("suffix"), F.concat(stem, F.lit("_compressed.pdf")).alias("compressed_name"), part.alias("part_name"))


_NOW = "timestamp '2024-01-01 02:00:00'"
_NOW_SPARK = "timestamp_ntz'2024-01-01 02:00:00'"


@query(f"with {_FILES} select file_id, expires_at from files where expires_at < {_NOW}")
def file_expiry(spark, sf):
    return storage.expired(src.stored_files(_docs(spark, sf)), F.expr(_NOW_SPARK)).select("file_id", "expires_at")


@query(f"with {_FILES} select count(*) as removed, count(*) filter (file_id % 5 <> 0) as deleted from files where expires_at < {_NOW}")
def cleanup_counts(spark, sf):
    f = src.stored_files(_docs(spark, sf))
    return storage.cleanup(f, f.where("file_id % 5 <> 0").select("file_id"), F.expr(_NOW_SPARK))[1]


@query(f"with {_FILES}, d as (select case when file_id % 2 = 0 then 'uploads' else 'outputs' end as directory, size from files) select coalesce(directory, 'total') as directory, count(*) as n_files, cast(sum(size) as bigint) as bytes from d group by rollup (directory)")
def disk_usage(spark, sf):
    return storage.disk_usage(src.stored_files(_docs(spark, sf)).select(F.expr("case when file_id % 2 = 0 then 'uploads' else 'outputs' end").alias("directory"), "size"))


@query(f"with {_FILES} select file_id, original_name as filename, '/files/' || file_id || suffix as download_url, size as size_bytes, {_NOW} + interval 3600 second as expires_at, 1500 as processing_time_ms from files")
def file_result(spark, sf):
    registry = storage.register(src.stored_files(_docs(spark, sf)).drop("suffix", "expires_at"))
    return storage.file_results(registry, F.expr(_NOW_SPARK), F.expr("timestamp_ntz'2024-01-01 01:59:58.5'"))


@query(f"with {_FILES} select file_id, size as original, size * (file_id % 13) // 10 as compressed, case when size = 0 then 0.0 else round((1 - (size * (file_id % 13) // 10) / size) * 100, 1) end as saved_pct from files")
def compress_stats(spark, sf):
    return storage.compression(src.stored_files(_docs(spark, sf)).select("file_id", F.col("size").alias("original"), F.expr("size * (file_id % 13) div 10").alias("compressed")))


@query("""select doc_id, cast(strlen(text) as bigint) as n_bytes, md5(text) as digest, cast(doc_id % 4 * 4 + 512 as bigint) as mask, true as same, true as by_owner, 'Incorrect password' as refused, true as passed from documents""")
def protect_unlock_roundtrip(spark, sf):
    """Opened with the user's password, with the owner's, with a wrong one, and content that was never protected."""
    secret, given = F.concat(F.lit("secret"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.lit("master"))
    rows = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("content"), secret.alias("password"), given.alias("owner_password"), (F.col("doc_id") % 4 * 4 + 512).alias("mask"))
    locked = protection.protect(rows).join(rows.select("id", F.col("content").alias("plain"), "password", "owner_password"), "id")
    opened = lambda name, password, content="content": protection.unlock(locked.select("id", F.col(content).alias("content"), password.alias("password"))).select("id", *[F.col(c).alias(f"{name}_{c}") for c in ("content", "mask", "error")])
    owner = F.coalesce("owner_password", F.concat("password", F.lit(protection.OWNER)))
    both = locked.select("id", "plain").join(opened("user", F.col("password")), "id").join(opened("owner", owner), "id").join(opened("wrong", F.lit("wrong")), "id").join(opened("free", F.lit("x"), "plain"), "id")
    content = F.col("user_content")
    return both.select(F.col("id").alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), F.md5(content).alias("digest"), F.col("user_mask").alias("mask"), (content == F.col("plain")).alias("same"),
                       (F.col("owner_content") == F.col("plain")).alias("by_owner"), F.col("wrong_error").alias("refused"), (F.col("free_content").eqNullSafe(F.col("plain")) & F.col("free_mask").isNull()).alias("passed"))


# ---- accounts


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all")
def usage_daily(spark, sf):
    return accounts.daily_usage(src.usage_events(src.table(spark, sf, "events")))


@query("""with e as (select *, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id) as k from events)
select event_id, user_id, k <= 5 as allowed, least(k, 5) as count_after from e""")
def quota_check(spark, sf):
    return accounts.check_quota(src.usage_events(src.table(spark, sf, "events")), 5).select("event_id", "user_id", "allowed", "count_after")


@query(f"""with {_USERS}, e as (select event_id, user_id, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id) as k from events),
l as (select e.*, case u.plan when 'pro' then 1000 when 'enterprise' then 999999 else 5 end as n from e left join users u on u.id = e.user_id)
select event_id, user_id, k <= n as allowed, least(k, n) as count_after from l""")
def quota_by_plan(spark, sf):
    e = src.usage_events(src.table(spark, sf, "events"))
    u = src.users(src.table(spark, sf, "customer")).select(F.col("id").alias("user_id"), "plan")
    return accounts.check_quota(e.join(u, "user_id", "left"), accounts.daily_limit(F.col("plan"))).select("event_id", "user_id", "allowed", "count_after")


@query(f"""with {_USERS}, n as (select user_id, count(*) as n from events where strftime(ts, '%Y-%m-%d') = '2024-01-10' group by user_id)
select id, email, full_name, plan, is_active, coalesce(n, 0) as conversions_today from users left join n on user_id = id""")
def user_profile(spark, sf):
    usage = accounts.daily_usage(src.usage_events(src.table(spark, sf, "events")))
    return accounts.profiles(src.users(src.table(spark, sf, "customer")), usage, "2024-01-10")


@query("select event_id, user_id, event_type as endpoint, date_trunc('hour', ts) as hour, row_number() over (partition by user_id, event_type, date_trunc('hour', ts) order by ts, event_id) <= 1 as allowed from events")
def rate_limit_hourly(spark, sf):
    return accounts.check_rate(src.usage_events(src.table(spark, sf, "events")), 1).select("event_id", "user_id", "endpoint", "hour", "allowed")


@query(f"""with {_USERS}, a as (select event_id as attempt_id, 'user' || (user_id * 20 + 1) || '@mail.test' as email from events)
select attempt_id, a.email, id, case when id is null then 'unknown' when not is_active then 'inactive' else 'ok' end as status from a left join users u on u.email = a.email""")
def login_lookup(spark, sf):
    tries = src.table(spark, sf, "events").selectExpr("event_id as attempt_id", "concat('  USER', user_id * 20 + 1, '@mail.test ') as email")
    return accounts.login(src.users(src.table(spark, sf, "customer")), tries)


@query(f"""with {_USERS}, r as (select event_id as seq, 'user' || (user_id * 20) || '@mail.test' as email, 'Name ' || event_id as full_name from events),
f as (select *, row_number() over (partition by email order by seq) as k from r)
select seq, email, full_name, 'free' as plan, true as is_active from f where k = 1 and email not in (select email from users)""")
def register_dedup(spark, sf):
    asked = src.table(spark, sf, "events").selectExpr("event_id as seq", "concat('User', user_id * 20, '@Mail.test') as email", "concat('Name ', event_id) as full_name")
    return accounts.register(src.users(src.table(spark, sf, "customer")), asked)


@query(f"with {_USERS} select id, case when id % 9 = 0 then 'enterprise' else plan end as plan from users")
def plan_upgrade(spark, sf):
    u = src.users(src.table(spark, sf, "customer"))
    return accounts.upgrade(u, u.where("id % 9 = 0").select("id", F.lit("enterprise").alias("plan"))).select("id", "plan")


# ---- billing


@query("""select o_orderkey as order_id, case o_orderkey % 5 when 0 then 'completed' when 1 then 'failed' when 2 then 'completed' when 3 then 'failed' else 'pending' end as status,
  cast(case o_orderkey % 5 when 0 then 2 when 2 then 1 when 3 then 1 else 0 end as bigint) as activations from orders""")
def order_state(spark, sf):
    return billing.order_states(src.order_events(src.table(spark, sf, "orders")))


@query(f"""with {_SUBS}, p as (select user_id, max(order_id) as order_id from pay where status = 'pending' group by user_id), q as (select p.user_id, plan, amount from p join pay on pay.order_id = p.order_id)
select coalesce(q.user_id, s.user_id) as user_id, coalesce(q.plan, s.plan) as plan, coalesce(q.amount, s.amount) as amount, case when q.user_id is not null then timestamp '2001-08-31' else next_charge end as next_charge,
  case when q.user_id is not null then false else cancelled end as cancelled from subs s full join q on q.user_id = s.user_id""")
def activation(spark, sf):
    o = src.table(spark, sf, "orders")
    return billing.activate(src.subscriptions(o), src.payment_orders(o).where("status = 'pending'"), F.expr("timestamp_ntz'2001-08-01'"))


@query(f"with {_SUBS} select user_id, plan, amount, 'REN-' || left(user_id::varchar, 8) || '-2001-08-01' as order_id, cancelled from subs where cast(next_charge as date) <= date '2001-08-01' and token <> ''")
def renewals_due(spark, sf):
    return billing.renewals_due(src.subscriptions(src.table(spark, sf, "orders")), F.lit("2001-08-01").cast("date"))


@query(f"with {_SUBS} select user_id, plan, amount, 'REN-' || left(user_id::varchar, 8) || '-2001-08-01' as order_id, cancelled from subs where cast(next_charge as date) <= date '2001-08-01' and token <> '' and not cancelled")
def renewals_due_fixed(spark, sf):
    return billing.renewals_due(src.subscriptions(src.table(spark, sf, "orders")), F.lit("2001-08-01").cast("date"), fixed=True)


def _outcomes(spark, sf):
    return renewals_due(spark, sf).select("user_id", (F.col("user_id") % 4 != 0).alias("ok"))


@query(f"""with {_SUBS} select user_id, plan, case when cast(next_charge as date) <= date '2001-08-01' and token <> '' and user_id % 4 <> 0 then timestamp '2001-08-31' else next_charge end as next_charge from subs""")
def renewal_outcome(spark, sf):
    return billing.renew(src.subscriptions(src.table(spark, sf, "orders")), _outcomes(spark, sf), F.expr("timestamp_ntz'2001-08-01'")).select("user_id", "plan", "next_charge")


@query(f"with {_SUBS} select count(*) filter (user_id % 4 <> 0) as charged, count(*) filter (user_id % 4 = 0) as failed from subs where cast(next_charge as date) <= date '2001-08-01' and token <> ''")
def renewal_counts(spark, sf):
    return billing.charge_counts(_outcomes(spark, sf))


@query(f"with {_SUBS} select user_id, plan, user_id % 10 = 0 or cancelled as cancelled, case when user_id % 10 = 0 then timestamp '2001-08-01' end as cancel_date from subs")
def subscription_cancel(spark, sf):
    s = src.subscriptions(src.table(spark, sf, "orders"))
    return billing.cancel(s, s.where("user_id % 10 = 0"), F.expr("timestamp_ntz'2001-08-01'")).select("user_id", "plan", "cancelled", "cancel_date")


@query(f"with {_USERS}, {_SUBS} select id, coalesce(s.plan, 'free') as plan, coalesce(not cancelled, false) as active from users left join subs s on s.user_id = id")
def subscription_status(spark, sf):
    return billing.status(src.users(src.table(spark, sf, "customer")), src.subscriptions(src.table(spark, sf, "orders")))


@query(f"""with {_ORDERS} select order_id, 'https://gateway.test/pay?sum=' || amount || '&currency=1&cred_type=1&description=Plan+' || plan || '&tranmode=AK&txId=' || order_id || '&pdesc=Plan+' || plan
  || '&success_url=https%3A%2F%2Fapp.test%2Fapi%2Fpayments%2Fsuccess%3Forder_id%3D' || order_id || '&fail_url=https%3A%2F%2Fapp.test%2Fapi%2Fpayments%2Ffail%3Forder_id%3D' || order_id
  || '&notify_url=https%3A%2F%2Fapp.test%2Fapi%2Fpayments%2Fnotify&store_card=1' as url from pay""")
def checkout_url(spark, sf):
    return billing.checkout_url(src.payment_orders(src.table(spark, sf, "orders")), "https://gateway.test/pay", "https://app.test")


@query("select o_orderkey as id, case o_orderkey % 4 when 3 then null when 2 then '' when 1 then '004' else '000' end as response, case o_orderkey % 4 when 0 then '1=2' else o_orderkey::varchar end as num, o_orderkey % 4 = 0 as ok from orders")
def gateway_reply_parse(spark, sf):
    body = F.expr("case o_orderkey % 4 when 0 then 'Response=001&Num=1=2&bad&Response=000' when 1 then concat('Num=', o_orderkey, '&Response=004') when 2 then concat('Response=&Num=', o_orderkey) else concat('x&Num=', o_orderkey) end")
    return billing.gateway_results(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body")))


@query("select o_orderkey as id, 'A B' || o_orderkey as order_id, case when o_orderkey % 2 = 0 then '000' end as response, case when o_orderkey % 3 = 0 then 'own' else 'tk+1' end as token, cast(null as varchar) as num from orders")
def webhook_parse(spark, sf):
    body = F.expr("concat('txId=A+B', o_orderkey, '&txId=second', case when o_orderkey % 2 = 0 then '&Response=000' else '&Response=' end, '&TranzilaTK=tk%2B1', case when o_orderkey % 3 = 0 then '&token=own' else '' end, '&Num')")
    return billing.webhook_orders(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body")))


@query("""select o_orderkey as id, case when o_orderkey % 3 = 0 then 'own' when o_orderkey % 3 = 1 then 'tk+1 ' || o_orderkey else '' end as token,
  case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then 'n%zz' when o_orderkey % 4 = 2 then 'a' || o_orderkey else '' end as auth_number, case when o_orderkey % 2 = 0 then '2' else '' end as transaction_id from orders""")
def success_redirect(spark, sf):
    query_string = F.expr("""concat('order_id=', o_orderkey, case o_orderkey % 3 when 0 then '&token=first&token=own&TranzilaTK=x' when 1 then concat('&TranzilaTK=tk%2B1+', o_orderkey) else '&&token=&TranzilaTK=x' end,
      case o_orderkey % 4 when 0 then '&Num&authNr=7' when 1 then '&Num=n%zz' when 2 then concat('&authNr=a', o_orderkey) else '' end, case when o_orderkey % 2 = 0 then '&index=1&index=2' else '' end)""")
    return billing.success_redirects(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), query_string.alias("query")))


# ---- streams and codecs


@query("select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all")
def stream_usage(spark, sf):
    return streams.daily_usage(spark, sf)


@query("""select user_id, event_type as endpoint, date_trunc('hour', ts) as hour, count(*) as n, greatest(count(*) - 1, 0) as denied from events group by all""")
def stream_rate_limit(spark, sf):
    return streams.hourly_rate(spark, sf, 1)


@query(f"with {_FILES} select file_id, expires_at from files where expires_at < {_NOW}")
def stream_cleanup(spark, sf):
    return streams.expiry(spark, sf, _NOW.split("'")[1])


@query("""select 'o' || o_orderkey as order_id, cast(case when o_orderkey % 5 in (0, 2, 3) then 1 else 0 end as bigint) as activations from orders where o_orderkey % 5 in (0, 3)""")
def stream_payments(spark, sf):
    return streams.first_payments(spark, sf)


@query(f"with {_PAGES} select doc_id, page, text from doc_pages")
def codec_text_roundtrip(spark, sf):
    """Documents encoded to bytes by the text codec and decoded to pages again."""
    whole = src.doc_pages(_docs(spark, sf)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    return codecs.decode(codecs.encode(whole, codecs.TextCodec()), codecs.TextCodec())
