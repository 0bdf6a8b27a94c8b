from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import occurrences, terms
from docweave.functions.vectors import score
from docweave.operators import change, find, migrate, nearest, search
from docweave.plans import textquery
from docweave.plans.filters import Every, FilterError, Some, parse
from docweave.schema import SchemaError, Spec, field, tagged
from docweave.sources import store
from docweave.sources.store import Busy, Catalog, Conflict, ReadOnly, Stale
from docweave.streaming.maintain import apply_batch, follow

USERS = [("u1", "Alice", "a@x", 30), ("u2", "Bob", "b@x", 25), ("u3", "Carol", "c@x", 35), ("u4", "Dave", "d@x", 25), ("u5", "alice", "e@x", 40)]
USER = Spec(T.StructType([tagged("id", "string", "id,pk"), tagged("name", "string", ",index"), tagged("email", "string", ",unique"), tagged("age", "bigint", ",index")]))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "id string, name string, email string, age bigint").cache()


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "tables"))


@pytest.mark.parametrize(
    "text, ids",
    [
        ("age=25", "u2 u4"),
        ("age[ne]=25", "u1 u3 u5"),
        ("age[gt]=30", "u3 u5"),
        ("age[gte]=30", "u1 u3 u5"),
        ("age[lt]=30", "u2 u4"),
        ("age[lte]=30", "u1 u2 u4"),
        ("age=30.7", ""),
        ("age[gt]=29.5&age[lt]=30.5", "u1"),
        ("name=Alice,Bob", "u1 u2"),
        ("name[nin]=Alice,Bob", "u3 u4 u5"),
        ("name[like]=A%25", "u1"),
        ("name[ilike]=a%25", "u1 u5"),
        ("name[nlike]=A%25", "u2 u3 u4 u5"),
        ("name[nilike]=a%25", "u2 u3 u4"),
        ("name=Alice|age=25", "u1 u2 u4"),
        ("name=Bob&age=25", "u2"),
        ("missing[is]=", "u1 u2 u3 u4 u5"),
        ("name[not]=", "u1 u2 u3 u4 u5"),
        ("age[gte]=30&age[lt]=40", "u1 u3"),
        ("age=25&name[ilike]=b%25", "u2"),
        ("(name=Alice|name=Bob)&age[gte]=30", "u1"),
        ("name=Alice|name=Bob&age[gte]=30", "u1"),
        ("missing=1", ""),
        ("missing[nin]=1,2", "u1 u2 u3 u4 u5"),
        ("age=x", ""),
        ("", "u1 u2 u3 u4 u5"),
    ],
)
def test_filters(users, text, ids):
    assert sorted(r["id"] for r in find.find(users, text).collect()) == ids.split()


def test_order_and_pages(users):
    ids = lambda q: [r["id"] for r in find.find(users, q, "id").collect()]
    assert ids("_sort=-age&_limit=2&_offset=1") == ["u3", "u1"]
    assert ids("_sort=age,name") == ["u2", "u4", "u1", "u3", "u5"]
    assert ids("_sort=nothing,-age&_limit=1") == ["u5"]
    assert ids("_sort=age&_offset=9") == []
    assert find.count(users, "age[gte]=30").first()["n"] == 3 and find.count(users, "_limit=1").first()["n"] == 5
    assert find.find(users, "_fields=name,id,none").columns == ["name", "id"]
    assert find.exists(users, "age=25") and not find.exists(users, "age=26")
    assert find.get(users, "id", "u3")["name"] == "Carol" and len(list(find.walk(users, "_limit=2"))) == 2
    with pytest.raises(KeyError):
        find.get(users, "id", "u9")


def test_nulls_and_types(spark):
    rows = [(1, None, None, None, None, None), (2, "a%b", [1, None], True, 2.5, '{"k": 1, "l": [{"x": "y"}, 3], "s": "t"}'), (3, r"a\c", [], False, float("nan"), '{"k": "1"}')]
    df = spark.createDataFrame(rows, "id int, s string, a array<int>, b boolean, d double, j string").withColumn("t", F.expr("timestamp_seconds(id)")).withColumn("m", F.expr("map('x', id)")).withColumn("n.o", F.col("id"))
    ids = lambda q: sorted(r["id"] for r in find.find(df, q).select("id").collect())
    assert ids("s[ne]=a") == ids("s[nlike]=b") == ids("s[nilike]=b") == ids("s[nin]=x,y") == ids("a[njin]=9") == [1, 2, 3]
    assert ids("a[njin]=1") == [1, 3] and ids("a[jin]=1,9") == [2] and ids("s[jin]=a%25b") == [2]
    assert ids(r"s[like]=a\c") == [3] and ids("s[like]=a_b") == [2]
    assert ids("b=1") == ids("b=true") == [2] and ids("b=x") == []
    assert ids("a.0=1") == [2] and ids("a.7[is]=") == [1, 2, 3] and ids("m.x[gt]=1") == [2, 3] and ids("n.o=3") == [3]
    assert ids("j.k[gte]=1") == [2, 3] and ids("j.l.0.x=y") == [2] and ids("j.s[jin]=t,u") == [2]
    assert ids('j[kv]={"k":1}') == [2, 3] and ids('j[kv]={"l":[{"x":"y"}]}') == [2] and ids("j[kv]=eyJrIjoxfQ") == [2, 3] and ids('a[kv]=[1]') == [2]
    assert ids("t[lte]=1970-01-01T00:00:02Z") == [1, 2]
    assert [r["id"] for r in find.find(df, "_sort=s", "id").collect()][0] == 1 and [r["id"] for r in find.find(df, "_sort=-s", "id").collect()][-1] == 1
    for bad in ("b[gt]=x", "t[gt]=never", "a[gt]=1", "s[what]=1", "(s=1", "s=1)", "_limit=x", "_what=1", "s"):
        with pytest.raises(FilterError):
            find.find(df, bad)


def test_grammar():
    q = parse("name=X|age[gt]=29&_sort=-age,name&_limit=10")
    assert isinstance(q.where, Some) and q.sort == [("age", True), ("name", False)] and q.limit == 10
    assert isinstance(parse("(a=1|b=2)&c[gt]=3&d=(x)").where, Every) and parse("(a=1|b=2)&d=(x)").where.parts[1].value == "(x)"


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 7 as string) as s", "id * 2 as x").write.parquet(str(tmp_path / "p"))
    plan = find.find(spark.read.parquet(str(tmp_path / "p")), "id[gte]=5&s[nin]=1,2&_fields=id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,5)" in plan and "Or(IsNull(s),Not(In(s" in plan and "x:bigint" not in plan.split("ReadSchema")[1]


# text search


def test_terms(spark):
    text = "github.com/testcontainers/testcontainers-go v0.39.0 -x Émile's end."
    want = terms(text)
    assert {t for t, _ in terms("github.com/testcontainers/testcontainers-go v0.39.0")} == {"github", "com", "testcontainers", "go", "v0", "39", "0", "github.com/testcontainers/testcontainers-go", "v0.39.0"}
    runs = spark.range(1).select(F.lit(text).alias("t")).select(occurrences(F.col("t")).alias("o")).first()["o"]
    assert sorted([(r["run"], i) for i, r in enumerate(runs)] + [(r["whole"], i) for i, r in enumerate(runs) if r["whole"]]) == sorted(want)


@pytest.mark.parametrize(
    "rows, text, ids",
    [
        ({"tc": "github.com/testcontainers/testcontainers-go v0.39.0", "pg": "github.com/jackc/pgx/v5 v5.6.0"}, 'v0.39.0|testcontainers v0.39.0|"v0.39.0"|testcontainers', "tc"),
        ({"hit": "git.example.com/acme/services/transactions/transaction_shared.git", "plain": "package transaction_shared", "miss": "git.example.com/acme/services/other/thing.git"}, "transaction_shared", "hit plain"),
        ({"1": "go programming language", "2": "rust programming language", "3": "python programming language"}, "go OR rust|programming go or rust", "1 2"),
        ({"1": "database with postgres backend", "2": "database with mysql backend"}, 'database -postgres|database NOT postgres|database -"postgres backend"', "2"),
        ({"adj": "install testcontainers go now", "split": "go here to install testcontainers later"}, '"testcontainers go"|"testcontainers go', "adj"),
        ({"1": "testcontainers are here", "2": "testing things", "3": "production"}, "test*|TEST*", "1 2"),
        ({"both": "alpha and beta together", "one": "only alpha here"}, "alpha beta", "both"),
        ({"a": "one", "b": None, "c": ""}, "-one|NOT one||nothing|*", ""),
    ],
)
def test_search(spark, rows, text, ids):
    index = search.build(spark.createDataFrame(list(rows.items()), "id string, body string"), "id", ["body"])
    for q in text.split("|"):
        assert sorted(r["key"] for r in search.search(index, q, limit=0).collect()) == ids.split(), q


def test_ranking_filters_and_pages(spark):
    rows = [(f"{i:02}", "alpha " * (10 - i), "wanted" if i % 2 == 0 else "other", "elephant" if i == 9 else None) for i in range(10)]
    docs = spark.createDataFrame(rows, "id string, body string, kind string, title string").cache()
    index = search.build(docs, "id", ["title", "body"]).cached()
    whole = [(r["id"], r["score"]) for r in search.search(index, "alpha", docs, 4, 0, "kind=wanted&_limit=1").collect()]
    pages = [(r["id"], r["score"]) for o in (0, 2) for r in search.search(index, "alpha", docs, 2, o, "kind=wanted").collect()]
    assert whole == pages and len(whole) == 4
    scores = {r["key"]: r["score"] for r in search.search(index, "alpha", limit=0).collect()}
    assert all(scores[i] == s for i, s in whole)
    assert tuple(search.totals(index, "alpha", docs, "kind=wanted").first()) == (10, 5)
    assert tuple(search.totals(index, "alpha", docs, None, F.col("key").startswith("0")).first()) == (10, 10)
    assert search.totals(index, "alpha", docs, "kind=wanted&kind=other").first()["matched"] == 0
    with pytest.raises(search.NoTextFields):
        search.build(docs, "id", [])


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, t string")
    index = search.build(docs, "id", ["t"])
    index.write(str(tmp_path / "i"))
    back = search.TextIndex.read(spark, str(tmp_path / "i"), "id")
    assert [tuple(r) for r in search.search(back, "b").collect()] == [tuple(r) for r in search.search(index, "b").collect()]
    newer = index.without(spark.createDataFrame([(2,)], "key int"), search.build(spark.createDataFrame([(2, "d")], "id int, t string"), "id", ["t"]))
    assert [r["key"] for r in search.search(newer, "b").collect()] == [1] and [r["key"] for r in search.search(newer, "d").collect()] == [2]


def test_text_queries():
    q = textquery.parse('a OR b or c -d "e f" NOT g NOT  h OR')
    assert [[c.words[0] for c in g] for g in q.groups] == [["a", "b", "c"]]
    assert [c.words for c in q.excluded] == [("d",), ("g",)] and [c.words for c in q.required] == [("e", "f"), ("h",)]
    assert [c.kind for c in textquery.parse("x.y").groups[0]] == ["term", "phrase"] and textquery.parse("-x.y").excluded[0].kind == "term"


# vectors


def test_nearest(spark):
    rows = [("a", "blog", [1.0, 0.0, 0.0, 0.0]), ("b", "doc", [0.0, 1.0, 0.0, 0.0]), ("c", "blog", [0.0, 0.0, 1.0, 0.0]), ("d", "doc", [0.5**0.5, 0.5**0.5, 0.0, 0.0]), ("e", "blog", None), ("f", "blog", [])]
    df = spark.createDataFrame(rows, "id string, tag string, v array<float>")
    ids = lambda *a, **k: [r["id"] for r in nearest.nearest(df, "v", *a, "id", **k).collect()]
    assert ids([1, 0, 0, 0]) == ["a", "d", "b", "c"] and ids([1, 0, 0, 0], filter="tag=blog") == ["a", "c"]
    for metric in ("cosine", "dot", "l2"):
        assert ids([1, 0, 0, 0], metric=metric, k=1) == ["a"]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(score(F.col("v"), [1, 0])).first()[0]
    assert zero == 0
    for bad, dim in (([], None), ([float("nan")], None), ([1.0], 4)):
        with pytest.raises(nearest.VectorError):
            ids(bad, dim=dim)
    many = nearest.nearest_many(df, "v", "id", df.where("id in ('a', 'b')"), "id", "v", 2, "l2")
    assert sorted((r["query"], r["key"], r["rank"]) for r in many.collect()) == [("a", "a", 1), ("a", "d", 2), ("b", "b", 1), ("b", "d", 2)]
    assert nearest.nearest_many(df, "v", "id", df.where("false"), "id", "v").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_every_row_is_a_query(spark, monkeypatch, metric):
    """In several passes and blocks, against all pairs."""
    from docweave import registry

    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", 150)
    monkeypatch.setattr(nearest, "SCORES_AT_ONCE", 3000)
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    got: dict = {}
    for r in registry.QUERIES[f"vec_all_{metric}"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], round(r["score"], 6)))
    assert set(got) == set(rows)
    for i, q in zip(ids, x):
        s = -np.sqrt(((x - q) ** 2).sum(1)) if metric == "l2" else (x * q).sum(1)
        s = np.round(s / np.sqrt((x**2).sum(1) * (q**2).sum()) if metric == "cosine" else s, 6) + 0.0
        best = sorted(zip(-s, ids))[:5]
        assert sorted(got[i]) == [(k, b, round(-a, 6)) for k, (a, b) in enumerate(best, 1)]


# schemas


def test_schema():
    assert USER.key == "id" and USER.groups("unique") == {"=email": ["email"]}
    place = Spec(T.StructType([tagged("id", "string", ",pk"), tagged("country", "string", ",index:region"), tagged("city", "string", ",index:region"), tagged("v", "array<float>", "emb,vector(dim=4,metric=dot)")]))
    assert place.groups("index") == {"region": ["country", "city"]} and place.vector == ("emb", {"dim": 4, "metric": "dot", "inline": True})
    assert tagged("x", "string", "-") is None
    assert USER.fingerprint() == Spec(T.StructType(list(reversed(USER.schema.fields)))).fingerprint() != place.fingerprint()
    for tag in (",what", ",vector(dim=0)", ",vector(metric=x)", ",vector(inline=maybe)", ",fts:x"):
        with pytest.raises(SchemaError):
            tagged("v", "array<float>", tag)
    for fields in ([field("a", "string", pk=True), field("b", "string", pk=True)], [field("a", "string"), field("a", "string")]):
        with pytest.raises(SchemaError):
            Spec(T.StructType(fields))


def test_migration_steps(spark):
    df = spark.createDataFrame([("1", "Ali Veli")], "id string, name string")
    new = T.StructType([field("id", "string", pk=True), field("first", "string"), field("email", "string")])
    steps = {2: (3, lambda d: d.withColumn("email", F.concat(F.lower("first"), F.lit("@x")))), 1: (2, lambda d: d.withColumn("first", F.split("name", " ")[0]))}
    assert tuple(migrate.migrated(df, df.schema, new, 1, 3, steps).first()) == ("1", "Ali", "ali@x")
    with pytest.raises(SchemaError, match="no migration registered"):
        migrate.migrated(df, df.schema, new, 1, 3, {2: steps[2]})
    with pytest.raises(SchemaError):
        migrate.migrated(df, df.schema, new, 1, 3, {1: (1, steps[1][1])})


# the store


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_writes(spark, catalog, users):
    t = catalog.register("users", USER)
    t.insert(users.where("id = 'u1'"))
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, name string, email string, age bigint")
    before = catalog.version()
    with pytest.raises(Conflict):
        t.insert(make(("u2", "Bob", "b@x", 1), ("u3", "Eve", "a@x", 2)))
    with pytest.raises(Conflict):
        t.insert_new(users.where("id = 'u1'"))
    assert catalog.version() == before and ids(t.df()) == ["u1"]
    t.insert(make(("u1", "Alice", "a@x", 31)))
    assert t.get("u1")["age"] == 31
    t.insert(make(("u6", "x", "f@x", 1), ("u6", "y", "g@x", 2)).withColumn("n", F.col("age")), order="n")
    assert t.get("u6")["name"] == "y"
    t.insert(users.where("id <> 'u1'"))
    t.find_and_update("age[gte]=35", {"age": F.col("age") + 1})
    assert {r["id"]: r["age"] for r in t.df().collect()} == {"u1": 31, "u2": 25, "u3": 36, "u4": 25, "u5": 41, "u6": 2}
    t.find_and_update("_sort=-age&_limit=1", lambda d: d.withColumn("name", F.lit("old")).where("age > 100"))
    assert t.count("name=old") == 0
    t.delete(make(("u6", "", "", 0), ("u99", "", "", 0)))
    catalog.compact("users")
    assert ids(t.find("age[gt]=30")) == ["u1", "u3", "u5"] and t.exists("age=25") and len(list(t.walk("age=25"))) == 2


def test_transactions(spark, catalog, users):
    t = catalog.register("users", USER)
    done = []
    with catalog.begin() as tx:
        tx.insert(t, users)
        tx.delete(t, users.where("id = 'u1'"))
        assert ids(tx.read(t)) == ["u2", "u3", "u4", "u5"] and ids(t.df()) == []
        tx.insert(t, users.where("id = 'u1'"))
        tx.on_commit(lambda: done.append(1))
    assert done == [1] and ids(t.df()) == ["u1", "u2", "u3", "u4", "u5"]
    with pytest.raises(RuntimeError, match="stop"):
        with catalog.begin() as tx:
            tx.delete(t, users)
            raise RuntimeError("stop")
    assert t.count() == 5
    with pytest.raises(ReadOnly):
        catalog.begin(False).insert(t, users)
    one, two = catalog.begin(), catalog.begin()
    one.delete(t, users.where("id = 'u1'"))
    two.delete(t, users.where("id = 'u2'"))
    one.commit()
    with pytest.raises(Busy):
        two.commit()
    assert ids(t.df()) == ["u2", "u3", "u4", "u5"]


def test_composite_unique_and_derived_key(spark, catalog):
    spec = Spec(T.StructType([field("id", "string", pk=True), field("country", "string", unique="cc"), field("code", "string", unique="cc")]))
    t = catalog.register("places", spec)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, country string, code string")
    t.insert(rows(("l1", "US", "NY"), ("l2", "US", "LA"), ("l4", None, "NY"), ("l5", None, "NY")))
    with pytest.raises(Conflict):
        t.insert(rows(("l3", "US", "NY")))
    t.insert(rows(("l1", "US", "NY")))
    things = catalog.register("things", Spec(T.StructType([field("name", "string")])), key=F.upper("name"))
    things.insert(spark.createDataFrame([("x",)], "name string"))
    assert things.get("X")["name"] == "x"
    with pytest.raises(SchemaError):
        catalog.register("other", Spec(T.StructType([field("name", "string")])))


def test_backups(spark, catalog, users, tmp_path):
    t = catalog.register("users", USER)
    t.insert(users.where("id in ('u1', 'u2')"))
    v = catalog.version()
    catalog.backup(str(tmp_path / "full"))
    t.delete(users.where("id = 'u1'"))
    t.insert(users.where("id = 'u3'"))
    catalog.backup(str(tmp_path / "until"), until=v)
    catalog.backup(str(tmp_path / "part"), since=v)
    other = Catalog(spark, str(tmp_path / "other"))
    mine = other.register("users", USER)
    mine.insert(users.where("id = 'u5'"))
    other.restore(str(tmp_path / "until"))
    with pytest.raises(Stale):
        mine.df()
    mine = other.register("users", USER)
    assert ids(mine.df()) == ["u1", "u2"] and ids(t.df(v)) == ["u1", "u2"]
    other.apply(str(tmp_path / "part"))
    assert ids(mine.df()) == ["u2", "u3"] == ids(t.df())
    with pytest.raises(ValueError):
        other.restore(str(tmp_path / "part"))
    catalog.wipe()
    assert t.count() == 0
    t.insert(users)
    assert t.count() == 5


def test_schema_versions(spark, catalog, users):
    old = Spec(T.StructType([field("id", "string", pk=True), field("name", "string", index=True)]))
    t = catalog.register("users", old, 1)
    t.insert(users.select("id", "name"))
    n = catalog.version()
    catalog.register("users", old, 1)
    assert catalog.version() == n
    for version in (0, 1):
        with pytest.raises(SchemaError):
            catalog.register("users", USER, version)
    now = catalog.register("users", USER, 2)
    with pytest.raises(Stale):
        t.df()
    assert now.get("u1")["email"] is None and ids(now.find("name=Bob")) == ["u2"]
    split = Spec(T.StructType([field("id", "string", pk=True), field("low", "string", fts=True)]))
    last = catalog.register("users", split, 3, {2: (3, lambda d: d.withColumn("low", F.lower("name")))})
    assert ids(last.search("alice")) == ["u1", "u5"] and last.totals("alice")["total"] == 2


def test_vectors_in_tables(spark, catalog):
    spec = lambda dim, metric="cosine", inline=True: Spec(T.StructType([field("id", "string", pk=True), field("v", "array<float>", vector={"dim": dim, "metric": metric, "inline": inline})]))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v array<float>")
    t = catalog.register("vecs", spec(0, inline=False), 1)
    t.insert(rows(("magnitude", [10.0, 0.0]), ("direction", [1.0, 1.0]), ("none", None)))
    with pytest.raises(nearest.VectorError):
        t.insert(rows(("x", [1.0, 2.0, 3.0])))
    with pytest.raises(nearest.VectorError):
        t.insert(rows(("x", [1.0, float("inf")])))
    assert [r["id"] for r in t.nearest([1, 1], 1).collect()] == ["direction"] and "v" not in t.find().columns
    t = catalog.register("vecs", spec(2, "dot"), 2)
    assert [r["id"] for r in t.nearest([1, 1], 1).collect()] == ["magnitude"]
    with pytest.raises(SchemaError):
        catalog.register("vecs", spec(3, "dot"), 3)
    t.embedder = F.array(F.length("id").cast("float"), F.lit(0.0).cast("float"))
    t.insert(rows(("abc", None), ("kept", [7.0, 7.0])))
    assert list(t.get("abc")["v"]) == [3.0, 0.0] and list(t.get("kept")["v"]) == [7.0, 7.0]
    with pytest.raises(search.NoTextFields):
        t.index()


def test_streams(spark, catalog, users, tmp_path):
    t = catalog.register("users", USER)
    users.where("id <> 'u5'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(users.schema).parquet(str(tmp_path / "in"))
    follow(stream(), t, "s", str(tmp_path / "c")).awaitTermination()
    assert t.count() == 4
    users.where("id = 'u5'").write.mode("append").parquet(str(tmp_path / "in"))
    follow(stream(), t, "s", str(tmp_path / "c")).awaitTermination()
    assert t.count() == 5
    assert not apply_batch(t, "s", users.where("false"), 0)
    marked = users.where("id in ('u1', 'u2')").withColumn("gone", F.col("id") == "u1").withColumn("age", F.lit(1).cast("bigint"))
    assert apply_batch(t, "other", marked, 0, deleted="gone")
    assert ids(t.df()) == ["u2", "u3", "u4", "u5"] and t.get("u2")["age"] == 1


def test_changes(spark, users):
    assert change.embed(spark.createDataFrame([(1, None)], "id int, v array<float>"), "v", lambda d: F.array(F.lit(1.0).cast("float"))).first()["v"] == [1.0]
    assert change.find_and_update(users, "", lambda d: d.where("false"), "id").count() == 5


def test_two_writers(spark, catalog, users):
    """Of writers that commit the same version at once, one succeeds, and nothing of the others is read."""
    from concurrent.futures import ThreadPoolExecutor

    t = catalog.register("users", USER)
    t.insert(users)
    base = catalog.version()

    def write(k):
        try:
            return catalog.commit(base, [{"table": "users", "change": f"data/none{k}"}])
        except Busy:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(write, range(8)))
    assert [x for x in done if x is not None] == [base + 1] and catalog.version() == base + 1
    assert len(catalog.state().tables["users"]["changes"]) == 2


def test_many_versions(spark, catalog, users, monkeypatch):
    """The log is summed up, tables are written whole after some changes, and what nothing reads any more can go."""
    monkeypatch.setattr(store, "CHECKPOINT", 4)
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    t = catalog.register("users", USER)
    t.insert(users)
    first = catalog.version()
    for k in range(6):
        t.insert(users.where("id = 'u1'").withColumn("age", F.lit(k).cast("bigint")))
        assert t.get("u1")["age"] == k and t.count() == 5
    state = catalog.state()
    assert len(state.tables["users"]["changes"]) < 3 and any(n.endswith(".state") for n in catalog.files.names("_log"))
    assert catalog.read("users", first).where("id = 'u1'").first()["age"] == users.where("id = 'u1'").first()["age"]
    before = len(catalog.files.names("data"))
    assert catalog.vacuum(1, 24) == 0 and 0 < catalog.vacuum(1, 0) < before
    assert t.get("u1")["age"] == 5 and t.count() == 5 and {r["id"] for r in Catalog(spark, catalog.root).read("users").collect()} == {f"u{i}" for i in range(1, 6)}


def test_index_follows_changes(spark, catalog, monkeypatch):
    monkeypatch.setattr(store, "LAYERS", 3)
    spec = Spec(T.StructType([field("id", "string", pk=True), field("low", "string", fts=True), field("title", "string", fts=True)]))
    t = catalog.register("notes", spec)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, low string, title string")
    built = []
    monkeypatch.setattr(search, "build", lambda df, *a, build=search.build: built.append(df.count()) or build(df, *a))
    t.insert(rows(*[(str(i), f"word{i} same", None) for i in range(9)]))
    assert ids(t.search("same", 0)) == [str(i) for i in range(9)] and built == [9]
    t.insert(rows(("3", "other", "titled"), ("new", "same", "same")))
    t.delete(rows(("5", None, None)).select("id"))
    assert ids(t.search("same", 0)) == sorted([*"012467", "8", "new"]) and ids(t.search("other OR titled")) == ["3"] and built == [9, 2]
    whole = {r["key"]: r["score"] for r in search.search(search.build(t.df(), "id", ["low", "title"]), "same", limit=0, digits=9).collect()}
    assert {r["key"]: r["score"] for r in search.search(t.index(), "same", limit=0, digits=9).collect()} == whole
    for k in range(3):
        t.insert(rows((f"more{k}", "same", None)))
        assert f"more{k}" in ids(t.search("same", 0))
    assert max(built[3:]) == 11  # after LAYERS layers it is written whole
    again = Catalog(spark, catalog.root).register("notes", spec)
    many = len(built)
    assert len(ids(again.search("same", 0))) == 11 and len(built) == many  # another session reads what is there
    hits = again.search_walk("same")
    assert next(hits)["id"] and sum(1 for _ in hits) == 10


def test_repeated_keys_and_embedders(spark, catalog):
    spec = lambda dim: Spec(T.StructType([field("id", "string", pk=True), field("v", "array<float>", vector={"dim": dim, "metric": "cosine", "inline": True})]))
    one = F.array(F.length("id").cast("float"))
    seen = []
    t = catalog.register("vecs", spec(1), 1, embedder=one)
    t.insert(spark.createDataFrame([("a", None), ("bb", [9.0]), ("a", [5.0])], "id string, v array<float>").coalesce(1))
    assert list(t.get("a")["v"]) == [5.0] and t.count() == 2  # the later row of a key counts
    t.insert(spark.createDataFrame([("ccc", [])], "id string, v array<float>"))
    assert list(t.get("ccc")["v"]) == [3.0] and list(t.get("bb")["v"]) == [9.0]
    with pytest.raises(SchemaError):
        catalog.register("vecs", spec(2), 2)
    two = F.array(F.length("id").cast("float"), F.lit(1.0).cast("float"))
    t = catalog.register("vecs", spec(2), 2, embedder=two, progress=lambda done, total: seen.append((done, total)))
    assert list(t.get("bb")["v"]) == [2.0, 1.0] and seen == [(0, 3), (3, 3)]


def test_cancelled_search(spark):
    import threading
    import time

    from docweave.operators.cancel import cancel, cancellable

    slow = F.pandas_udf(lambda s: (time.sleep(60), s)[1], "bigint")
    threading.Timer(2.0, lambda: cancel(spark, "mine")).start()
    began = time.time()
    with pytest.raises(Exception, match="cancel"), cancellable(spark, "mine"):
        spark.range(4).select(slow("id")).collect()
    assert time.time() - began < 40 and spark.range(3).count() == 3


def test_index_is_built_without_moving_postings(spark, tmp_path, monkeypatch):
    """Texts move once and postings never, in runs of any size; what it holds is what counting word by word gives."""
    monkeypatch.setattr(search, "LOT", 7)
    texts = {1: ("b a b", None), 2: ("x.y b X.y", "b a"), 3: ("", None), 4: (None, "ä a-1 a"), 5: ("c", "b")}
    docs = spark.createDataFrame([(k, *v) for k, v in texts.items()], "id int, t string, u string")
    index = search.build(docs, "id", ["t", "u"])
    want: dict = {}
    for k, v in texts.items():
        for f, text in zip("tu", v):
            for term, at in terms(text or ""):
                want.setdefault((k, f, term), []).append(at)
    size = {k: sum(len(at) for (d, _, _), at in want.items() if d == k) for k in texts}
    got = {(r["key"], r["field"], r["term"]): r for r in index.postings.collect()}
    assert {k: list(r["positions"]) for k, r in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(r["tf"] == len(r["positions"]) and r["len"] == size[r["key"]] for r in got.values()) and len(got) == index.postings.count()
    df = {t: len({k for k, _, x in want if x == t}) for _, _, t in want}
    assert {r["term"]: r["df"] for r in search.document_frequency(index).collect()} == df
    assert tuple(index.stats.first()) == (4, sum(size.values())) and {tuple(r) for r in index.lengths.collect()} == {(k, n) for k, n in size.items() if n}
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(index.postings).count("Repartition") == 1 and "Aggregate" not in plan(index.postings)
    assert "distinct" not in plan(search.document_frequency(index)).lower()
    index.write(str(tmp_path / "i"))
    back = search.TextIndex.read(spark, str(tmp_path / "i"), "id")
    assert sorted(map(str, back.postings.collect())) == sorted(map(str, got.values()))


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_rough_scores_lose_nothing(spark, monkeypatch, metric):
    """Near and far, short and long, equal, zero and huge vectors; few of all pairs are scored exactly."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[100:200] = x[:100] + 1e-4 * rng.normal(size=(100, 8))
    x[200:250] *= 1e-3
    x[250:300] = np.round(x[250:300])
    x[300:303] = 0
    if metric != "dot":
        x[303], x[304] = 1e160, 1e-160
    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", 220)
    monkeypatch.setattr(nearest, "SCORES_AT_ONCE", 9000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(2)
    got: dict = {}
    queries = df.where("id < 303 or id > 304")
    for r in nearest.nearest_many(df, "v", "id", queries, "id", "v", 4, metric, 6).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"], r["score"]))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x**2).sum(1))
        for i in [i for i in range(600) if i not in (303, 304)]:
            s = -np.sqrt(((x - x[i]) ** 2).sum(1)) if metric == "l2" else (x * x[i]).sum(1)
            if metric == "cosine":
                s = np.divide(s, norm * norm[i], out=np.zeros(600), where=norm * norm[i] > 0)
            best = sorted((-v, k) for k, v in enumerate(np.round(s, 6) + 0.0) if v == v)[:4]
            assert [(k, round(v, 6)) for _, k, v in sorted(got[i])] == [(k, round(-v, 6)) for v, k in best], i
    block = nearest._Block(x[400:], x[400:], metric)
    s = block.rough(0, 200)
    fourth = np.sort(block.score_of(s[:, :]), 1)[:, -4] if metric == "cosine" else np.sort(block.exact(*np.divmod(np.arange(200 * 200), 200), None).reshape(200, 200), 1)[:, -4]
    assert (s >= block.cut(fourth, 1e-6)[:, None]).sum() < 200 * 6
