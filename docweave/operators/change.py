"""Writes as DataFrames: what a table holds after upserts, deletes and updates, and what breaks its constraints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.find import find


class Conflict(ValueError):
    """A key or unique value that another row holds; fields names it."""

    def __init__(self, fields: tuple[str, ...]):
        super().__init__(f"conflict on {', '.join(fields)}")
        self.fields = fields


def last_of_each(batch: DataFrame, key: str, order: str | None) -> DataFrame:
    """The row of each key that comes last by order; without an order, the last as the rows stand in the batch. Of equal ones, that too."""
    names = [f"`{c}`" for c in batch.columns]
    place = F.struct(*([F.col(f"`{order}`")] if order is not None else []), F.monotonically_increasing_id())
    w = Window.partitionBy("_all." + f"`{key}`").orderBy(F.desc("_place"))
    return batch.select(F.struct(*names).alias("_all"), place.alias("_place")).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("_all.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    if order is not None:  # else keys are unique
        new = last_of_each(new, key, order)
    if order is not None and order not in old.columns:
        new = new.drop(order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def conflicts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key old has."""
    return new.join(old.select(key), key, "left_semi")


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    if not conflicts(old, new, key).isEmpty():
        raise Conflict((key,))
    return old.unionByName(new)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys; keys that it doesn't have don't matter."""
    return old.join(keys.select(key), key, "left_anti")


def find_and_update(df: DataFrame, query, change: dict[str, Column] | Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """df after change was applied to the rows that query finds, with its sort and page. A function may leave rows out: they stay as they were."""
    found = find(df, query, key)
    changed = change(found) if callable(change) else found.withColumns(change)
    return upsert(df, changed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema]), key)


def violations(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(fields, owners): unique values that rows of more than one key have; a value with a null in it is free."""
    cols = [F.col(f"`{f}`") for f in fields]
    known = df
    for c in cols:
        known = known.where(c.isNotNull())
    return known.groupBy(*cols).agg(F.count_distinct(F.col(f"`{key}`")).alias("owners")).where("owners > 1")


def embed(df: DataFrame, vector: str, embedder: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """df with the vectors that are missing or empty filled by an embedder, a Column such as a pandas UDF's; others stay."""
    made = embedder(df) if callable(embedder) else embedder
    have = F.coalesce(F.size(F.col(f"`{vector}`")), F.lit(0)) > 0
    return df.withColumn(vector, F.when(have, F.col(f"`{vector}`")).otherwise(made))
