"""Moving rows from one schema to another through registered steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.change import embed
from docweave.schema import SchemaError

Step = Callable[[DataFrame], DataFrame]


def path(have: int, want: int, steps: dict[int, tuple[int, Step]]) -> list[Step]:
    """The steps from version to version; an error where one is missing or doesn't lead on."""
    out = []
    while have < want:
        if have not in steps:
            raise SchemaError(f"no migration registered from version {have}")
        to, step = steps[have]
        if to <= have or to > want:
            raise SchemaError(f"the migration from version {have} to {to} doesn't lead to {want}")
        out.append(step)
        have = to
    return out


def reshaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the fields of schema: new ones are null, old ones go, types are cast."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _vector(schema: T.StructType) -> dict:
    return {f.name: f.metadata["vector"] for f in schema if "vector" in f.metadata}


def migrated(df: DataFrame, old: T.StructType, new: T.StructType, have: int, want: int, steps: dict[int, tuple[int, Step]] | None, embedder=None) -> DataFrame:
    """One lazy plan: all steps in a row, then the shape of the new schema. Without steps, only fields and flags may change; a vector's dimension needs a step or an embedder, which makes all vectors anew."""
    other = [n for n, v in _vector(new).items() if (b := _vector(old).get(n)) and v["dim"] and b["dim"] and v["dim"] != b["dim"]]
    if not steps and other and embedder is None:
        raise SchemaError(f"vectors of {other[0]} must be made anew for {_vector(new)[other[0]]['dim']} components")
    for step in path(have, want, steps) if steps else []:
        df = step(df)
    df = reshaped(df, new)
    for name in other if embedder is not None else []:
        fits = F.size(F.col(f"`{name}`")) == _vector(new)[name]["dim"]
        df = embed(df.withColumn(name, F.when(fits, F.col(f"`{name}`"))), name, embedder)
    return df
