"""The registered queries of this subpackage: each reads a whole table, calls its operator with production parameters
and derives the columns of its contract. ORACLES has DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.workers import shared_dir

from . import counts, neardup, packing, pii, quality, records, topk, toxicity, treebpe, warc
from .common import table


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica in which one record of 97 has a wrong byte."""
    kept = warc.warc_records(table(spark, sf_dir, "pages"))
    first = warc.tree(warc.leaves(kept), "first")
    second = warc.tree(warc.leaves(warc.damaged(kept)), "second")
    return warc.audit(first, second)


def op3_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treebpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    records.write(table(spark, sf_dir, "documents"), out)
    return records.numbered(spark, out)


def op9_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_packing, op2_merkle_audit, op3_va_file_top_k, op4_decision_list, op5_token_counts,
        op6_minhash_hamming, op7_tree_bpe, op8_record_files, op9_disguised_pii, op10_nnpu_toxicity,
    )
}

#: The replica of op2 differs in one byte of a record, so only in its leaf.
_OP2 = r"""
with r as (
  select page_id, page_id // 1024 as file, sha256(cast(page_id as varchar)) as u, coalesce(url, '') as url, coalesce(html, '') as html
  from pages where page_id is not null
), d as (
  select page_id, file, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:uuid:',
    substr(u, 1, 8), '-', substr(u, 9, 4), '-', substr(u, 13, 4), '-', substr(u, 17, 4), '-', substr(u, 21, 12), '>', chr(13), chr(10),
    'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'WARC-Payload-Digest: sha256:', sha256(html), chr(13), chr(10), 'Content-Length: ', cast(strlen(html) as varchar), chr(13), chr(10), chr(13), chr(10)) as head, html
  from r
), l as (
  select page_id, file, row_number() over (partition by file order by page_id) - 1 as pos, strlen(head) + strlen(html) + 4 as n,
    sha256(concat(head, html, chr(13), chr(10), chr(13), chr(10))) as a,
    sha256(concat(head, left(html, length(html) - 1), '#', chr(13), chr(10), chr(13), chr(10))) as b
  from d
), o as (select *, sum(n) over (partition by file order by pos) as high from l)
select file, pos, page_id, cast(high - n as bigint) as low, cast(high as bigint) as high,
  sha256(concat('leaf:', cast(high - n as bigint), ':', cast(high as bigint), ':', a)) as hash,
  sha256(concat('leaf:', cast(high - n as bigint), ':', cast(high as bigint), ':', b)) as other_hash, 'corrupt' as kind, cast(1 as bigint) as records, cast(0 as bigint) as shift
from o where page_id % 97 = 48 and a <> b
"""

_OP3 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

_OP6 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), t as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from w),
g as (
  select doc_id, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o as x
  from t window o as (partition by doc_id order by p)
), e as (select distinct doc_id, x from g where x is not null union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select w.doc_id, count(e.x) as n from w left join e on e.doc_id = w.doc_id group by w.doc_id),
l as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), c as (select doc_id, doc_id as root from n union select l.b, c.root from c join l on l.a = c.doc_id)
select n.doc_id, n.n as n_shingles, min(c.root) as component_id, min(c.root) = n.doc_id as kept
from n join c on c.doc_id = n.doc_id group by n.doc_id, n.n
"""

ORACLES: dict[str, str] = {"op2_merkle_audit": _OP2, "op3_va_file_top_k": _OP3, "op6_minhash_hamming": _OP6}
