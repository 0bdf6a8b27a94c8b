from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import bpe, rans
from docweave.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "\n\n x\t\ty", "don't I'll we've", "über straße ñandú éà", "日本語 текст 👩‍👩‍👧", "a" * 5000, "ab" * 300, "1234567 89", "x" * 31 + " " + "y" * 33, "<|endoftext|>", "end.", "a , b. c", "퟿\x00\x01", "word " * 3000]


def reference():
    return rans._tokenizer(bpe.VOCABULARY)


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_public_encoder(text):
    own = bpe.encoder(bpe.VOCABULARY)
    ids = own.encode(text)
    assert ids == reference().encode_ordinary(text)
    assert own.decode(ids).decode() == text


def test_random_words():
    rng, own = random.Random(3), bpe.encoder(bpe.VOCABULARY)
    for n in (1, 2, 7, 8, 9, 31, 33, 255, 257, 700):
        for _ in range(30):
            word = "".join(rng.choice("abcdefghéñ") for _ in range(n))
            assert bpe.merge(word.encode(), own.ranks) == own.encode(word) == reference().encode_ordinary(word)


def test_encode_and_decode_tables(spark, docs_of):
    rows = [*enumerate(ODD), (90, None), (91, ODD[5]), (91, ODD[5]), (None, "no id")]
    docs = docs_of(rows).withColumnRenamed("source", "token_ids")
    out = bpe.encode(docs)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got if r["doc_id"] != 90)
    assert next(r for r in got if r["doc_id"] == 90)["token_ids"] is None
    back = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in bpe.decode(out).collect())
    assert back == sorted((-1 if i is None else i, t or "") for i, t in rows)
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, [10**6]), (2, None)], "doc_id bigint, token_ids array<int>")).where("text is null").count() == 2


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode(docs).collect():
        assert r["token_ids"] == reference().encode_ordinary(texts[r["doc_id"]]) and r["round_trip"] and r["n_bytes"] == len(texts[r["doc_id"]].encode())


# rANS


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000, 262_144])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.geometric(0.01, n), 5000)
    seen, times = np.unique(np.append(tokens, 7), return_counts=True)
    freq, start = rans.scaled(seen, times)
    assert freq.sum() == 1 << rans.SCALE and (freq[seen] > 0).all()
    payload, points = rans.encode_block(tokens, freq, start)
    parts = [rans.decode_part(payload, points, n, k, rans.symbols(freq), freq, start) for k in reversed(range(len(points) // (8 * (rans.LANES + 2))))]
    assert np.array_equal(np.concatenate(parts[::-1] or [np.zeros(0, int)]), tokens)  # parts are decoded in any order
    if n > 50_000:
        p = times / times.sum()
        assert len(payload) * 8 < 1.02 * n * -(p * np.log2(p)).sum() + 64 * rans.LANES


def pieces(archive):
    whole: dict = {}
    for r in sorted(rans.decode(archive).collect(), key=lambda r: (r["block_id"], r["ord"], r["part"])):
        whole.setdefault(r["doc_id"], []).append(r["token_ids"])
    return whole


def test_store_and_decode(spark, docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(rans.encode, "__defaults__", (1000,))
    rows = [*enumerate(ODD), (90, None), (91, ODD[5]), (91, ODD[5]), (92, "long text " * 5000), (None, "no id")]
    docs = docs_of(rows).withColumnsRenamed({"lang": "n", "source": "ids"})
    rans.store(docs).write.parquet(str(tmp_path / "archive"))
    archive = spark.read.parquet(str(tmp_path / "archive"))
    blocks = archive.where("block_id is not null")
    assert blocks.count() > 5 and blocks.select("block_id").distinct().count() == blocks.count()
    whole = pieces(archive)  # from the written rows alone
    for i, t in rows:
        parts = whole[i]
        assert parts == [None] if t is None else sum((p for p in parts if p), []) == reference().encode_ordinary(t) * (2 if i == 91 else 1)
    broken = archive.withColumn("crc32", F.expr("transform(crc32, x -> if(block_id is null, x, x + 1))"))
    with pytest.raises(Exception, match="checksum"):
        rans.decode(broken).collect()
    empty = rans.store(docs.limit(0))
    assert empty.where("block_id is not null").count() == 0 and rans.decode(empty).count() == 0


def test_parts_of_a_long_block(spark, docs_of, monkeypatch):
    """A block of several parts, with documents that lie across them, and null and empty ones at their edges."""
    monkeypatch.setattr(rans, "STRIDE", 4)
    rows = [(i, None if i % 7 == 3 else "" if i % 7 == 5 else " ".join(f"word{k % 97}" for k in range(i * 37 % 900))) for i in range(40)]
    archive = rans.store(docs_of(rows, 1))
    assert archive.where("size(crc32) > 3").count() > 0
    whole = pieces(archive)
    for i, t in rows:
        assert whole[i] == [None] if t is None else sum((p for p in whole[i] if p), []) == reference().encode_ordinary(t)


def test_store_of_the_table(spark):
    docs = table(spark, SF, "documents")
    whole = {i: sum((p or [] for p in x), []) for i, x in pieces(rans.store(docs).cache()).items()}
    assert whole == {r["doc_id"]: reference().encode_ordinary(r["text"]) for r in docs.collect()}
