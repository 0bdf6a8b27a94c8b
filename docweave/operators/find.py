"""Filter, sort, page, project, count and fetch: every function takes a DataFrame and gives a lazy one, but for exists, get and walk."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.plans.filters import Query, parse
from docweave.plans.predicates import Json, column, resolve


def as_query(query: str | Query | None) -> Query:
    return query if isinstance(query, Query) else parse(query or "")


def where(df: DataFrame, query: str | Query) -> DataFrame:
    return df.filter(column(df.schema, as_query(query).where))


def ordering(schema: T.StructType, sort: list[tuple[str, bool]], key: str | None) -> list[Column]:
    """Nulls come first in ascending order, and of values out of JSON text, texts before numbers; unknown fields don't order; the key settles ties."""
    out = []
    for name, down in sort:
        if (found := resolve(schema, name)) is not None and not isinstance(found[1], T.MapType):
            c, kind = found
            for x in (c.try_cast("double"), c) if isinstance(kind, Json) else (c,):
                out.append(x.desc_nulls_last() if down else x.asc_nulls_first())
    return [*out, F.col(f"`{key}`")] if out and key else out


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in the order asked for; a dotted path is named by its whole path, and unknown fields are left out."""
    found = [(f, resolve(df.schema, f)) for f in dict.fromkeys(fields)]
    known = [c[0].alias(f) for f, c in found if c is not None]
    return df.select(*known) if known else df


def find(df: DataFrame, query: str | Query, key: str | None = None) -> DataFrame:
    q = as_query(query)
    out = where(df, q)
    if order := ordering(df.schema, q.sort, key):
        out = out.orderBy(*order)
    if q.offset:
        out = out.offset(q.offset)
    if q.limit:  # 0 is no limit
        out = out.limit(q.limit)
    return project(out, q.fields) if q.fields else out


def walk(df: DataFrame, query: str | Query) -> Iterator[Row]:
    """The rows one after the other, a partition at a time; sorting is ignored, and stopping early leaves the rest unread."""
    q = as_query(query)
    yield from find(df, Query(q.where, [], q.limit, q.offset, q.fields)).toLocalIterator()


def count(df: DataFrame, query: str | Query) -> DataFrame:
    """(n): rows that match; sort, offset and limit don't matter."""
    return where(df, query).agg(F.count(F.lit(1)).alias("n"))


def exists(df: DataFrame, query: str | Query) -> bool:
    return not where(df, query).isEmpty()


def get(df: DataFrame, key: str, value) -> Row:
    """The row of a key; KeyError if there is none."""
    rows = df.filter(F.col(f"`{key}`") == F.lit(value)).limit(1).collect()
    if not rows:
        raise KeyError(value)
    return rows[0]
