"""The queries of the library's own operators over the driver's tables, and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.vectors import METRICS
from docweave.operators import change, find, migrate, nearest, search
from docweave.schema import field

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# filters, sorting and paging: a filter string over a table, and the columns that are kept


def filtered(name: str, source: str, text: str, keep: str, sql: str, key: str | None = None, prepare=None) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        df = prepare(df) if prepare else df
        return find.find(df, text, key).select(*keep.split())


ORD = "o_orderkey o_orderstatus o_totalprice"
filtered("entry_filter_sort_limit", "orders", "o_orderstatus=P,F&o_totalprice[gte]=1000&_sort=-o_totalprice&_limit=10", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('P','F') and o_totalprice >= 1000 order by o_totalprice desc, o_orderkey limit 10", "o_orderkey")
filtered("filter_eq", "orders", "o_orderstatus=P", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'P'")
filtered("filter_ne", "orders", "o_orderstatus[ne]=P", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus is distinct from 'P'")
filtered("filter_gt", "lineitem", "l_quantity[gt]=30", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 30")
filtered("filter_gte", "lineitem", "l_quantity[gte]=30", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 30")
filtered("filter_lt", "lineitem", "l_quantity[lt]=30", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 30")
filtered("filter_lte", "lineitem", "l_quantity[lte]=30", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity <= 30")
filtered("filter_range", "lineitem", "l_quantity[gte]=10&l_quantity[lt]=20", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity < 20")
filtered("filter_two_bounds", "lineitem", "l_quantity[gt]=20&l_quantity[gt]=5", "l_orderkey l_linenumber l_quantity", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 20 and l_quantity > 5")
filtered("filter_string_range", "customer", "c_mktsegment[gte]=B&c_mktsegment[lt]=H", "c_custkey c_mktsegment", "select c_custkey, c_mktsegment from customer where c_mktsegment >= 'B' and c_mktsegment < 'H'")
filtered("filter_ts_range", "orders", "o_orderdate[gte]=1998-01-01T00:00:00Z", "o_orderkey o_orderdate", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1998-01-01'")
filtered("filter_like", "part", "p_name[like]=small%25", "p_partkey p_name", "select p_partkey, p_name from part where p_name like 'small%'")
filtered("filter_ilike", "part", "p_name[ilike]=%25RING%25", "p_partkey p_name", "select p_partkey, p_name from part where p_name ilike '%RING%'")
filtered("filter_nlike", "part", "p_name[nlike]=small%25", "p_partkey p_name", "select p_partkey, p_name from part where p_name is null or p_name not like 'small%'")
filtered("filter_nilike", "part", "p_name[nilike]=SMALL%25", "p_partkey p_name", "select p_partkey, p_name from part where p_name is null or p_name not ilike 'SMALL%'")
filtered("filter_in", "customer", "c_mktsegment=BUILDING,MACHINERY", "c_custkey c_mktsegment", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING','MACHINERY')")
filtered("filter_nin", "customer", "c_mktsegment[nin]=BUILDING,MACHINERY", "c_custkey c_mktsegment", "select c_custkey, c_mktsegment from customer where c_mktsegment is null or c_mktsegment not in ('BUILDING','MACHINERY')")


def _sparse(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.nullif("o_orderstatus", F.lit("P")))


filtered("filter_is", "orders", "status[is]=", "o_orderkey", "select o_orderkey from orders where nullif(o_orderstatus, 'P') is null", None, _sparse)
filtered("filter_not", "orders", "status[not]=", "o_orderkey", "select o_orderkey from orders where nullif(o_orderstatus, 'P') is not null", None, _sparse)
filtered("filter_null_negated", "orders", "status[ne]=F&status[nlike]=X%25&status[nin]=X,Y", "o_orderkey status", "select o_orderkey, nullif(o_orderstatus, 'P') as status from orders where nullif(o_orderstatus, 'P') is distinct from 'F'", None, _sparse)
filtered("filter_unknown_field", "orders", "nothing[is]=&nothing[ne]=1", "o_orderkey", "select o_orderkey from orders")
filtered("filter_missing_negated", "events", "props.zzz[ne]=1", "event_id", "select event_id from events where (props->>'$.zzz') is distinct from '1'")
filtered("filter_kv", "events", 'props[kv]={"k":69}', "event_id props", "select event_id, props from events where cast(props->>'$.k' as double) = 69")
filtered("filter_jin", "part", "words[jin]=small,ring", "p_partkey p_name", "select p_partkey, p_name from part where list_has_any(string_split(p_name, ' '), ['small','ring'])", None, lambda df: df.withColumn("words", F.split("p_name", " ")))
filtered("filter_njin", "part", "words[njin]=small,ring", "p_partkey p_name", "select p_partkey, p_name from part where not list_has_any(string_split(p_name, ' '), ['small','ring'])", None, lambda df: df.withColumn("words", F.split("p_name", " ")))
filtered("filter_or_fields", "orders", "o_orderstatus=P|o_totalprice[gte]=100000", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'P' or o_totalprice >= 100000")
filtered("filter_nested_groups", "orders", "(o_orderstatus=P|o_orderstatus=F)&o_totalprice[gte]=1000&o_totalprice[lt]=90000", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders where (o_orderstatus = 'P' or o_orderstatus = 'F') and o_totalprice >= 1000 and o_totalprice < 90000")
filtered("path_json", "events", "props.k[gte]=50", "event_id props", "select event_id, props from events where cast(props->>'$.k' as double) >= 50")
filtered("path_array", "embeddings", "embedding.0[gt]=0", "vec_id label", "select vec_id, label from embeddings where embedding[1] > 0")
filtered("path_struct", "customer", "at.segment=BUILDING&at.nation[lt]=10", "c_custkey", "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey < 10", None, lambda df: df.withColumn("at", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))))
filtered("sort_limit_offset", "orders", "_sort=-o_totalprice&_limit=20&_offset=5", ORD, "select o_orderkey, o_orderstatus, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5", "o_orderkey")
filtered("sort_multi", "customer", "_sort=c_mktsegment,-c_acctbal&_limit=50", "c_custkey c_mktsegment c_acctbal", "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 50", "c_custkey")
filtered("sort_nested", "events", "_sort=props.k,event_id&_limit=1500", "event_id props", "select event_id, props from events order by cast(props->>'$.k' as double), event_id limit 1500", "event_id")
filtered("sort_nested_page", "events", "_sort=-props.k&_limit=700&_offset=250", "event_id props", "select event_id, props from events order by cast(props->>'$.k' as double) desc, event_id limit 700 offset 250", "event_id")
filtered("filter_kv_nested", "events", 'props[kv]={"at":{"k":69},"all":[69]}', "event_id", """select event_id from events where cast(props->>'$.k' as double) = 69""", None, lambda df: df.withColumn("props", F.expr("to_json(named_struct('at', named_struct('k', get_json_object(props, '$.k') + 0, 'x', 'y'), 'all', array(1, get_json_object(props, '$.k') + 0)))")))
filtered("composite_eq", "lineitem", "l_returnflag=A&l_linestatus=F", "l_orderkey l_linenumber l_returnflag l_linestatus", "select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem where l_returnflag = 'A' and l_linestatus = 'F'")


@query("project_fields", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def project_fields(spark, sf_dir):
    return find.find(table(spark, sf_dir, "orders"), "o_orderstatus=F&_fields=o_orderkey,o_totalprice")


@query("count", "select count(*) as n from orders where o_totalprice >= 100000")
def count(spark, sf_dir):
    return find.count(table(spark, sf_dir, "orders"), "o_totalprice[gte]=100000&_limit=1")


@query("exists", "select exists(select 1 from orders where o_orderstatus = 'P') as found, exists(select 1 from orders where o_orderstatus = 'Z') as other")
def exists(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(find.exists(df, "o_orderstatus=P"), find.exists(df, "o_orderstatus=Z"))], "found boolean, other boolean")


@query("get_pk", "select c_custkey, c_name from customer where c_custkey = 7")
def get_pk(spark, sf_dir):
    row = find.get(table(spark, sf_dir, "customer"), "c_custkey", 7)
    return spark.createDataFrame([(row["c_custkey"], row["c_name"])], "c_custkey bigint, c_name string")


# constraints and writes


@query("unique_check", "select c_nationkey, count(distinct c_custkey) as owners from customer group by 1 having count(distinct c_custkey) > 1")
def unique_check(spark, sf_dir):
    return change.violations(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey")


@query("composite_unique_check", "select c_nationkey, c_mktsegment, count(distinct c_custkey) as owners from customer group by 1, 2 having count(distinct c_custkey) > 1")
def composite_unique_check(spark, sf_dir):
    return change.violations(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


def _halves(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    news = c.withColumns({"c_custkey": F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1_000_000_000), "c_name": F.concat("c_name", F.lit("*"))})
    return c, news


_NEWS = "news as (select case when c_custkey % 2 = 0 then c_custkey else c_custkey + 1000000000 end as c_custkey, c_name || '*' as c_name, c_acctbal from customer)"


@query("upsert", f"with {_NEWS} select * from news union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from news)")
def upsert(spark, sf_dir):
    return change.upsert(*_halves(spark, sf_dir), "c_custkey")


@query("upsert_last_wins", "select c_nationkey, c_custkey, c_name from customer qualify row_number() over (partition by c_nationkey order by c_custkey desc) = 1")
def upsert_last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return change.upsert(c.where("false"), c, "c_nationkey", "c_custkey")


@query("insert_new_conflicts", f"with {_NEWS} select * from news where c_custkey in (select c_custkey from customer)")
def insert_new_conflicts(spark, sf_dir):
    return change.conflicts(*_halves(spark, sf_dir), "c_custkey")


@query("delete", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def delete(spark, sf_dir):
    gone = find.find(table(spark, sf_dir, "customer"), "c_mktsegment=BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return change.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("find_and_update", "select p_partkey, p_size, case when p_size >= 30 then p_retailprice * 2 else p_retailprice end as p_retailprice from part")
def find_and_update(spark, sf_dir):
    return change.find_and_update(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size[gte]=30", {"p_retailprice": F.col("p_retailprice") * 2}, "p_partkey")


@query("migrate_split_name", "select p_partkey, string_split(p_name, ' ')[1] as first, string_split(p_name, ' ')[2] as second, null::varchar as note from part")
def migrate_split_name(spark, sf_dir):
    from pyspark.sql import types as T

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = T.StructType([field("p_partkey", "bigint", pk=True), field("first", "string", index=True), field("second", "string"), field("note", "string")])
    split = F.split("p_name", " ")
    steps = {1: (2, lambda d: d.withColumn("first", split[0])), 2: (3, lambda d: d.withColumn("second", F.try_element_at(split, F.lit(2))))}
    return migrate.migrated(parts, parts.schema, new, 1, 3, steps)


# text search over documents


_TERMS = r"""
words as (select doc_id, word, row_number() over () as w from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}._/+@\-]*')) as word from documents where text <> '')),
runs as (select doc_id, regexp_extract_all(word, '[\p{L}\p{Nd}]+') as r, regexp_replace(word, '[._/+@\-]+$', '') as whole from words),
tokens as (select doc_id, unnest(case when len(r) > 1 then list_append(r, whole) else r end) as term from runs),
postings as (select doc_id, term, count(*) as tf from tokens group by 1, 2),
lengths as (select doc_id, sum(tf) as len from postings group by 1),
stats as (select count(*) as n, sum(len) as total from lengths)"""
_PLACES = r""",
single as (select doc_id, unnest(r) as term, generate_subscripts(r, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as r from documents where text <> ''))"""


def _tf(tf: str) -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len / greatest(total / n, 1))))"


def _term(name: str, term: str) -> str:
    return f"{name} as (select doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * {_tf('tf')} as s from postings join lengths using (doc_id), stats, (select count(*) as df from postings where term = '{term}') where term = '{term}')"


_INDEXES: dict = {}


def _index(spark, sf_dir) -> search.TextIndex:
    """The written index of documents. It is made when it is first asked for, and again when the files have changed; a session's queries share it."""
    from docweave.sources.fs import Files
    from docweave.sources.scratch import folder

    path = f"{sf_dir}/documents.parquet"
    stamp = spark.sparkContext.applicationId, path, Files(spark, path).stamp()
    if stamp not in _INDEXES:
        _INDEXES[stamp] = folder(spark, "text-index")
        search.build(table(spark, sf_dir, "documents"), "doc_id", ["text"]).write(_INDEXES[stamp])
    return search.TextIndex.read(spark, _INDEXES[stamp], "doc_id")


@query("fts_tokens", f"with {_TERMS} select term, sum(tf)::bigint as tf, count(*) as df from postings group by 1")
def fts_tokens(spark, sf_dir):
    return _index(spark, sf_dir).postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


# a compound stands where its first run does: behind the runs of the words before it
_POSITIONS = r""",
listed as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}][\p{L}\p{Nd}._/+@\-]*') as ws from documents where text <> '')),
placed as (select doc_id, regexp_extract_all(word, '[\p{L}\p{Nd}]+') as r, regexp_replace(word, '[._/+@\-]+$', '') as whole, coalesce(sum(len(regexp_extract_all(word, '[\p{L}\p{Nd}]+'))) over (partition by doc_id order by j rows between unbounded preceding and 1 preceding), 0) as place from listed),
every as (select doc_id, unnest(r) as term, place + generate_subscripts(r, 1) - 1 as pos from placed union all select doc_id, whole, place from placed where len(r) > 1)"""


@query("fts_positions", f"with {_TERMS}{_POSITIONS} select doc_id, term, array_to_string(list_sort(list(pos::int)), ' ') as positions from every group by 1, 2")
def fts_positions(spark, sf_dir):
    return _index(spark, sf_dir).postings.select(F.col("key").alias("doc_id"), "term", F.array_join("positions", " ").alias("positions"))


@query("fts_df", f"with {_TERMS} select term, count(distinct doc_id) as df from postings group by 1")
def fts_df(spark, sf_dir):
    return search.document_frequency(_index(spark, sf_dir))


@query("fts_stats", f"with {_TERMS} select n as doc_count, total::bigint as sum_len from stats")
def fts_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats


def ranked(name: str, text: str, sql: str) -> None:
    @query(name, f"with {_TERMS}{_PLACES}, {sql}")
    def run(spark, sf_dir):
        return search.search(_index(spark, sf_dir), text, limit=0, digits=6).select(F.col("key").alias("doc_id"), "score")


def _out(sql: str) -> str:
    return f"select doc_id, round(s, 6) as score from ({sql})"


_UNWANTED = "doc_id not in (select doc_id from postings where term = 'erth')"
_TEXTS = {
    "fts_term": ("thnd", f"{_term('a', 'thnd')} {_out('select * from a')}"),
    "fts_and": ("thnd thou", f"{_term('a', 'thnd')}, {_term('b', 'thou')} {_out('select doc_id, a.s + b.s as s from a join b using (doc_id)')}"),
    "fts_or": ("thnd OR thou", f"{_term('a', 'thnd')}, {_term('b', 'thou')} {_out('select doc_id, sum(s) as s from (select * from a union all select * from b) group by 1')}"),
    "fts_not": ("the -erth", f"{_term('a', 'the')} {_out(f'select * from a where {_UNWANTED}')}"),
    "fts_prefix": ("thn*", f"a as (select doc_id, max(ln(1 + (n - df + 0.5) / (df + 0.5)) * {_tf('1')}) as s from postings join lengths using (doc_id), stats, (select count(distinct doc_id) as df from postings where starts_with(term, 'thn')) where starts_with(term, 'thn') group by 1) {_out('select * from a')}"),
    "fts_phrase": ('"of the"', f"hit as (select distinct a.doc_id from single a join single b on a.doc_id = b.doc_id and b.i = a.i + 1 where a.term = 'of' and b.term = 'the'), a as (select doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * {_tf('2')} as s from hit join lengths using (doc_id), stats, (select count(*) as df from postings where term = 'of')) {_out('select * from a')}"),
    "fts_mixed": ("thnd OR thou the -erth", f"{_term('a', 'thnd')}, {_term('b', 'thou')}, {_term('c', 'the')} {_out('select doc_id, any_value(c.s) + sum(x.s) as s from (select * from a union all select * from b) x join c using (doc_id) where ' + _UNWANTED + ' group by doc_id')}"),
}
for _name, (_text, _sql) in _TEXTS.items():
    ranked(_name, _text, _sql)

_TWO = f"{_term('a', 'the')}, {_term('b', 'of')}, hits as ({_out('select doc_id, a.s + b.s as s from a join b using (doc_id)')})"


@query("fts_filter_page", f"with {_TERMS}, {_TWO} select doc_id, lang, score from hits join documents using (doc_id) where lang = 'en' order by score desc, doc_id limit 10 offset 5")
def fts_filter_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return search.search(_index(spark, sf_dir), "the of", docs, 10, 5, "lang=en", digits=6)


@query("fts_keyfilter", f"with {_TERMS}, {_TWO} select doc_id, score from hits where doc_id < 300 order by score desc, doc_id limit 25")
def fts_keyfilter(spark, sf_dir):
    return search.search(_index(spark, sf_dir), "the of", limit=25, key_filter=F.col("key") < 300, digits=6).withColumnRenamed("key", "doc_id")


@query("fts_matched", f"with {_TERMS}, {_TWO} select count(*) as total, count(*) filter (where lang = 'en') as matched from hits join documents using (doc_id)")
def fts_matched(spark, sf_dir):
    return search.totals(_index(spark, sf_dir), "the of", table(spark, sf_dir, "documents"), "lang=en")


# nearest neighbours over embeddings


_SCORES = {"cosine": "list_cosine_similarity(embedding::double[], q)", "dot": "list_inner_product(embedding::double[], q)", "l2": "0 - list_distance(embedding::double[], q)"}
_Q = "(select embedding::double[] as q from embeddings where vec_id = 0)"


def _first(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def _neighbours(name: str, metric: str, filter: str | None = None, also: str = "") -> None:
    @query(name, f"select vec_id, round({_SCORES[metric]}, 6) + 0.0 as score from embeddings, {_Q} {also} order by score desc, vec_id limit 10")
    def run(spark, sf_dir):
        return nearest.nearest(table(spark, sf_dir, "embeddings"), "embedding", _first(spark, sf_dir), "vec_id", 10, metric, filter, digits=6).select("vec_id", "score")


for _metric in METRICS:
    _neighbours(f"vec_{_metric}", _metric)
_neighbours("vec_filter", "cosine", "label=2", "where label = 2")
_neighbours("vec_filter_dot", "dot", "label[gte]=1&label[lt]=4", "where label >= 1 and label < 4")


def _batch(metric: str) -> None:
    # every label's first vector is a query
    sql = f"""with q as (select vec_id as query, embedding::double[] as q from embeddings qualify row_number() over (partition by label order by vec_id) = 1),
    s as (select query, vec_id as key, round({_SCORES[metric]}, 6) + 0.0 as score from embeddings, q)
    select *, row_number() over (partition by query order by score desc, key)::int as rank from s qualify rank <= 5"""

    @query(f"vec_batch_{metric}", sql)
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
        return nearest.nearest_many(e, "embedding", "vec_id", q, "vec_id", "embedding", 5, metric, 6)


for _metric in METRICS:
    _batch(_metric)


def _all(metric: str) -> None:
    # every row is a query
    sql = f"""with q as (select vec_id as query, embedding::double[] as q from embeddings),
    s as (select query, vec_id as key, round({_SCORES[metric]}, 6) + 0.0 as score from embeddings, q)
    select *, row_number() over (partition by query order by score desc, key)::int as rank from s qualify rank <= 5"""

    @query(f"vec_all_{metric}", sql)
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        return nearest.nearest_many(e, "embedding", "vec_id", e, "vec_id", "embedding", 5, metric, 6)


for _metric in METRICS:
    _all(_metric)


# snapshots, backups and streams, with a catalog in a folder of the session


def _catalog(spark, name: str):
    from docweave.sources.scratch import folder
    from docweave.sources.store import Catalog

    return Catalog(spark, folder(spark, name))


def _customers(spark, sf_dir, name):
    from pyspark.sql import types as T

    from docweave.schema import Spec

    catalog = _catalog(spark, name)
    spec = Spec(T.StructType([field("c_custkey", "bigint", pk=True), field("c_name", "string"), field("c_acctbal", "double", index=True)]))
    return catalog, catalog.register("customer", spec), *_halves(spark, sf_dir)


@query("snapshot_until", "select c_custkey, c_name, c_acctbal from customer")
def snapshot_until(spark, sf_dir):
    catalog, t, old, new = _customers(spark, sf_dir, "until")
    at = t.insert(old)
    t.insert(new)
    t.delete(old.where("c_custkey % 3 = 0"))
    return t.df(at)


_CHANGED = f"with {_NEWS}, now as (select * from news union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from news)) select * from now where c_custkey % 3 <> 0"


@query("snapshot_now", _CHANGED)
def snapshot_now(spark, sf_dir):
    catalog, t, old, new = _customers(spark, sf_dir, "now")
    t.insert(old)
    t.insert(new)
    t.delete(t.df().where("c_custkey % 3 = 0"))
    catalog.compact("customer")
    return t.df()


@query("backup_incremental", _CHANGED)
def backup_incremental(spark, sf_dir):
    from docweave.sources.store import Catalog

    catalog, t, old, new = _customers(spark, sf_dir, "backup")
    since = t.insert(old)
    catalog.backup(f"{catalog.root}-full")
    t.insert(new)
    t.delete(t.df().where("c_custkey % 3 = 0"))
    catalog.backup(f"{catalog.root}-part", since)
    other = Catalog(spark, f"{catalog.root}-other")
    other.restore(f"{catalog.root}-full")
    other.apply(f"{catalog.root}-part")
    return other.read("customer")


@query("stream_upsert", "select event_id, user_id, value from events")
def stream_upsert(spark, sf_dir):
    from pyspark.sql import types as T

    from docweave.schema import Spec
    from docweave.streaming.maintain import follow

    catalog = _catalog(spark, "stream")
    t = catalog.register("events", Spec(T.StructType([field("event_id", "bigint", pk=True), field("user_id", "bigint"), field("value", "double")])))
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "value")
    follow(stream, t, "events", f"{catalog.root}-checkpoint").awaitTermination()
    return t.df()
