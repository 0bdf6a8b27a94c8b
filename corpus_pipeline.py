"""Stages over documents, from quality to tokens. Each works on all rows that the one before it left, and its decisions take effect.

Only the last stage changes the columns: it returns token ids beside all columns but text. No stage is written as SQL.

Edge cases: a row with a null text is rejected by the first stage; an empty text is scored like any other, has no partners and no tokens; a row with a null
doc_id is never a near copy and loses no passage; repeated rows of one doc_id stay or go together; of ties the smallest doc_id stays; very long texts are
worked on whole; an empty table gives an empty result; other columns are passed on whatever their names, but for those
that the last stage makes itself, which it replaces.
"""

from __future__ import annotations

from docweave.llm import bpe, decontaminate, jaccard, quality, substring
from docweave.llm.common import table


def good(spark, docs, sf_dir):
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark, docs, sf_dir):
    return jaccard.keep_one(docs)


def no_repeats(spark, docs, sf_dir):
    return substring.dedup(docs)


def no_benchmark(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark, docs, sf_dir):
    return bpe.encode(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text", *bpe.MADE)))


STAGES = [("quality", good), ("near_copies", one_of_each), ("substrings", no_repeats), ("decontamination", no_benchmark), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
