"""Exact nearest neighbours over an array column: for one query vector, under a filter, or for a table of queries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docweave.functions.vectors import METRICS, finite, score
from docweave.operators.find import as_query, find

#: Query vectors that a pass over the table is held against at once, and their bytes.
QUERIES_AT_ONCE, BYTES_AT_ONCE = 16_384, 32 << 20
#: Scores that a task holds at once; bounds its memory, not the result.
SCORES_AT_ONCE = 1 << 21


class VectorError(ValueError):
    pass


def check(query: Sequence[float], dim: int | None = None) -> list[float]:
    if not len(query):
        raise VectorError("the query vector is empty")
    if any(v is None or not math.isfinite(v) for v in query):
        raise VectorError("the query vector has a component that isn't finite")
    if dim is not None and len(query) != dim:
        raise VectorError(f"the query vector has {len(query)} components, not {dim}")
    return [float(v) for v in query]


def invalid(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Rows whose vector isn't finite, or isn't of dim components; rows without one are fine."""
    c = F.col(f"`{vector}`")
    wrong = ~finite(c)
    if dim is not None:
        wrong = wrong | (F.size(c) != dim)
    return df.where((F.size(c) > 0) & wrong)


def nearest(df: DataFrame, vector: str, query: Sequence[float], key: str, k: int = 10, metric: str = "cosine", filter=None, dim: int | None = None, digits: int | None = None) -> DataFrame:
    """The k best rows with their score, best first, by key among equals. A filter's own sort, offset and limit narrow the rows too. Rows without a vector never match."""
    q = check(query, dim)
    rows = find(df, as_query(filter), key) if filter is not None else df
    s = score(F.col(f"`{vector}`"), q, metric)
    if digits is not None:
        s = F.round(s, digits) + 0.0
    return rows.where(F.size(F.col(f"`{vector}`")) == len(q)).withColumn("score", s).orderBy(F.desc("score"), F.asc(key)).limit(k or 10)


class _Block:
    """Rows of a table, made ready to be scored roughly, in single precision, against queries q: what can't be among the best isn't scored in double precision.

    Rough scores are of vectors scaled to 1 at most, so they are off by self.off at most. Of dot products and distances they are a growing function for each query.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.metric, self.q, self.x = metric, q, x
            self.nq, self.nx = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
            self.fine = np.isfinite(self.nx) & ((self.nx > 1e-140) | (x == 0).all(1))  # the squares of the others have no digits
            sure = np.isfinite(self.nq) & ((self.nq > 1e-140) | (q == 0).all(1))
            self.sure = bool(sure.all())
            one = np.where(self.nq > 0, self.nq, 1.0)
            ends = self.nx[self.fine]
            self.most = most = max(float(ends.max(initial=0)), float(self.nq.max(initial=0)) if metric == "l2" else 0.0) or 1.0
            self.off = (q.shape[1] + 16) * 2.0**-23 * (2 if metric == "l2" else 1)
            if metric == "l2":
                a, b = np.c_[q / most, np.ones(len(q))], np.c_[x / most, -((self.nx / most) ** 2) / 2]
            else:
                a, b = q / one[:, None], x / (np.where(self.nx > 0, self.nx, 1.0)[:, None] if metric == "cosine" else most)
            self.unit = np.full(len(q), 1.0) if metric == "cosine" else self.nq * most
            self.a, self.b = a.astype(np.float32), np.where(self.fine[:, None], b, 0).astype(np.float32)

    def rough(self, at: int, end: int) -> np.ndarray:
        return self.a @ self.b[at:end].T

    def score_of(self, rough: np.ndarray) -> np.ndarray:
        """The least score that a rough score of each query may stand for."""
        rough = rough.astype(float) - self.off
        if self.metric == "l2":
            return -np.sqrt(np.maximum((self.nq / self.most) ** 2 - 2 * rough, 0)) * self.most
        return rough * self.unit

    def cut(self, low: np.ndarray, slack: float) -> np.ndarray:
        """The least rough score of what may score low - slack."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            low = low - slack
            if self.metric == "l2":
                out = ((self.nq / self.most) ** 2 - (np.minimum(low, 0) / self.most) ** 2) / 2
            else:
                out = np.where(self.unit > 0, low / self.unit, -np.inf)
        out = np.where(np.isfinite(low) & np.isfinite(out), out - 2 * self.off, -np.inf)
        return np.nextafter(out.astype(np.float32), np.float32(-np.inf))

    def exact(self, i: np.ndarray, j: np.ndarray, digits: int | None) -> np.ndarray:
        out = np.zeros(len(i))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(i), 8192):
                q, x = self.q[i[at : at + 8192]], self.x[j[at : at + 8192]]
                if self.metric == "l2":
                    s = -np.sqrt(((q - x) ** 2).sum(1))
                else:
                    s = (q * x).sum(1)
                    if self.metric == "cosine":
                        n = self.nq[i[at : at + 8192]] * self.nx[j[at : at + 8192]]
                        s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
                out[at : at + 8192] = s
            return (np.round(out, digits) if digits is not None else out) + 0.0


def nearest_many(df: DataFrame, vector: str, key: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """(query, key, score, rank): the k best rows for each query. Queries are held against the table QUERIES_AT_ONCE at a time, as matrices; a task sends k rows a query at most."""
    if metric not in METRICS:
        raise VectorError(f"there is no metric {metric!r}")
    kinds = queries.schema[query_key].dataType.simpleString(), df.schema[key].dataType.simpleString()
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("key is not null and size(v) > 0")
    name_type = to_arrow_type(queries.schema[query_key].dataType)
    spark, parts, held = df.sparkSession, [], []

    def against(block: list) -> DataFrame:
        names = [b[0] for b in block]
        q = np.array([b[1] for b in block])
        shared = spark.sparkContext.broadcast((names, q))

        def run(batches):
            import pandas as pd

            names, q = shared.value
            best = schema = None
            low = np.full(len(q), -np.inf)
            found: list = []

            def settle():
                """The k best of what was found, by key among equals, and the score that others must reach."""
                nonlocal best
                frame = pd.concat([*([] if best is None else [best]), *found])
                found.clear()
                best = frame.sort_values(["q", "score", "key"], ascending=[True, False, True]).groupby("q").head(k)
                full = best.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                low[full.index.to_numpy()] = full["min"].to_numpy()

            slack = 10.0**-digits if digits is not None else 0.0
            step = max(1, SCORES_AT_ONCE // len(q))
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rows = rows.filter(pa.compute.equal(pa.compute.list_value_length(rows["v"]), q.shape[1]))
                if not rows.num_rows:
                    continue
                schema = rows.schema.field("key").type
                keys = rows["key"].to_numpy()
                block = _Block(q, np.asarray(rows["v"].combine_chunks().flatten()).reshape(-1, q.shape[1]), metric)
                for at in range(0, len(keys), step):
                    fine = block.fine[at : at + step]
                    s = block.rough(at, at + step)
                    least = low
                    if fine.sum() > k and block.sure and not np.isfinite(low).all():
                        some = s if fine.all() else s[:, fine]
                        least = np.maximum(low, block.score_of(np.partition(some, some.shape[1] - k, 1)[:, some.shape[1] - k]) - slack)
                    i, j = np.divmod(np.flatnonzero(s >= block.cut(least, slack)[:, None] if block.sure else np.ones_like(s, bool)), s.shape[1])
                    if not fine.all():
                        odd = np.flatnonzero(~fine)
                        good = fine[j]
                        i, j = np.concatenate([i[good], np.repeat(np.arange(len(q)), len(odd))]), np.concatenate([j[good], np.tile(odd, len(q))])
                    score = block.exact(i, at + j, digits)
                    good = score >= low[i]
                    found.append(pd.DataFrame({"q": i[good], "key": keys[at + j[good]], "score": score[good]}))
                    if least is not low or sum(map(len, found)) > 2 * k * len(q):
                        settle()
            if found:
                settle()
            if best is not None and len(best):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best["q"]], name_type), pa.array(best["key"].to_numpy(), schema), pa.array(best["score"].to_numpy(float))], names=["query", "key", "score"])

        return source.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")

    for row in queries.select(query_key, query_vector).toLocalIterator():
        held.append((row[0], check(row[1])))
        if len(held) == min(QUERIES_AT_ONCE, max(1, BYTES_AT_ONCE // (8 * len(held[0][1])))):
            parts.append(against(held))
            held = []
    if held or not parts:
        parts.append(against(held) if held else source.where("false").select(F.lit(None).cast(kinds[0]).alias("query"), "key", F.lit(0.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
