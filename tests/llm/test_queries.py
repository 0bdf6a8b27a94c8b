from __future__ import annotations

import pytest

import corpus_pipeline
from docweave.llm import bpe, queries
from tests.sql import connection, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, read = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, read, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in read.select("doc_id").collect()}
        read = after
    whole = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r["doc_id"]: r["token_ids"] for r in read.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(read).collect()} == texts


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, empty tables and columns named like helpers go through every stage."""
    words = [f"word{i}" for i in range(300)]
    good, passage = " ".join(words[:90]), " ".join(f"p{i}" for i in range(60))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(80))
    item = "which of these many words would be the one that stands in both the tables of the test"
    texts = {1: good, 2: good + " more", 3: None, 4: "", 5: "!!! ||| ### " * 40, 6: f"{item} and so on", 7: f"{own(7)} {passage} three", 8: f"{own(8)} {passage} five six", 9: " ".join(f"n{k}" for k in range(30_000)), 10: "short text"}
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "x", [0]) for i, t in [*texts.items(), (10, "short text"), (None, "no id here"), (None, None)]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc int, key int, cell string, token_ids array<int>"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (10, 1, 0), (5, 0, 0), (9, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) <= set(texts) | {None} and not {2, 3, 5, 6} & set(got) and {1, 7, 8, 9, 10} <= set(got) and len(got[10]) == 2
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()}
    assert back[1] == good and back[7] == texts[7] and back[8] == f"{own(8)}\nfive six" and back[9] == texts[9]
    assert {"lang", "source", "n_chars", "_doc", "key", "cell"} <= set(out.columns) and out.columns.count("token_ids") == 1 and got[8][0]["_doc"] == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
