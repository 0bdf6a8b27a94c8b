"""Similarities of array columns, higher is nearer. They are Spark expressions over doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def array_of(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def score(a: Column, query: Sequence[float] | Column, metric: str = "cosine") -> Column:
    """Of an array column against a vector or another array column. A vector of norm 0 has cosine 0."""
    if metric not in METRICS:
        raise ValueError(f"there is no metric {metric!r}")
    fixed = not isinstance(query, Column)
    q = array_of(query) if fixed else query
    if metric == "dot":
        return dot(a, q)
    if metric == "l2":
        return F.lit(0.0) - F.sqrt(_sum(F.zip_with(a, q, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    length = norm(a) * (F.lit(math.sqrt(sum(float(v) ** 2 for v in query))) if fixed else norm(q))
    return F.when(length == 0, 0.0).otherwise(dot(a, q) / length)


def finite(a: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
