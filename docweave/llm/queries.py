"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.llm import bpe, decontaminate, gif, html, jaccard, quality, rans, substring, toxicity, warc
from docweave.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle(sql: str):
    """The SQL that gives the same rows as the query below it."""

    def add(f):
        ORACLES[f.__name__] = sql
        return f

    return add


@query
def op10_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"))


@query
def op2_rans(spark, sf_dir):
    return rans.store(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_substring(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents"), report=True)


@query
@oracle(
    """
    with recursive words as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from documents where doc_id is not null),
    grams as (select doc_id, list_sort(list_distinct(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as g from words where len(w) > 0),
    sets as (select row_number() over (order by min(doc_id)) as id, g, list_distinct(list(doc_id)) as docs from grams group by g),
    tokens as (select id, len(g) as n, unnest(g) as g from sets),
    pairs as (select a.id as a, b.id as b from tokens a join tokens b on a.g = b.g and a.id < b.id group by a.id, b.id
        having count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.55 - 1e-12),
    both_ways as (select a, b from pairs union all select b, a from pairs),
    reach as (select id as a, id as b from sets union select r.a, p.b from reach r join both_ways p on p.a = r.b),
    class as (select a as id, min(list_min(docs)) as class_id from reach join sets on sets.id = reach.b group by a),
    links as (select a as id, sum(len(docs)) as n from both_ways join sets on sets.id = both_ways.b group by a)
    select unnest(docs) as doc_id, class_id, len(docs)::bigint as n_copies, (len(docs) - 1 + coalesce(n, 0))::bigint as n_links
    from sets join class using (id) left join links using (id)
    union all select distinct doc_id, doc_id, 1, 0 from words where len(w) = 0
    """
)
def op3_jaccard(spark, sf_dir):
    return jaccard.find(table(spark, sf_dir, "documents"))


@query
def op6_gif(spark, sf_dir):
    return gif.decode(gif.pictures(table(spark, sf_dir, "pages")))


@query
@oracle(
    """
    with body as (select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest from pages),
    http as (select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) as http from body),
    head as (select *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
        || 'WARC-Date: 2026-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
        || 'WARC-Payload-Digest: sha256:' || digest || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
        || 'Content-Length: ' || (octet_length(encode(http)) + octet_length(encode(html))) || chr(13) || chr(10) || chr(13) || chr(10) || http as head from http)
    select page_id as record_id, digest, min(page_id) over (partition by digest) as owner, octet_length(encode(head))::int as header_bytes, octet_length(encode(html))::int as payload_bytes,
        true as declared_fits, true as verified, head || html || chr(13) || chr(10) || chr(13) || chr(10) as record from head
    """
)
def op7_warc(spark, sf_dir):
    restored = warc.restore(*warc.store(warc.from_pages(table(spark, sf_dir, "pages"))))
    return restored.withColumn("record", F.col("record").cast("string"))


@query
def op8_html(spark, sf_dir):
    return html.text_of(table(spark, sf_dir, "pages"))
