"""Table schemas: Spark fields whose metadata says what they are for, and a fingerprint of them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import types as T

METRICS = ("cosine", "dot", "l2")


class SchemaError(ValueError):
    pass


_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def kind_of(text: str) -> T.DataType:
    """A type from its name; those that aren't plain, or arrays of plain ones, need a session."""
    if text in _KINDS:
        return _KINDS[text]
    if text.startswith("array<") and text[6:-1] in _KINDS:
        return T.ArrayType(_KINDS[text[6:-1]])
    return T.DataType.fromDDL(text)


def field(name: str, kind: T.DataType | str, pk: bool = False, index: bool | str = False, unique: bool | str = False, fts: bool = False, vector: dict | None = None) -> T.StructField:
    """index and unique: True for the field alone, or the name of a group of fields. vector: {dim, metric, inline}."""
    kind = kind_of(kind) if isinstance(kind, str) else kind
    meta: dict = {}
    if pk:
        meta["pk"] = True
    for flag, value in (("index", index), ("unique", unique)):
        if value:
            meta[flag] = value if isinstance(value, str) else ""
    if fts:
        meta["fts"] = True
    if vector is not None:
        v = {"dim": 0, "metric": "cosine", "inline": True} | vector
        if set(v) != {"dim", "metric", "inline"} or v["metric"] not in METRICS or not isinstance(v["dim"], int) or v["dim"] < 0 or not isinstance(v["inline"], bool):
            raise SchemaError(f"{vector} can't be a vector of {name}")
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            raise SchemaError(f"{name} is no array of float numbers")
        meta["vector"] = v
    return T.StructField(name, kind, not pk, meta)


def tagged(name: str, kind: T.DataType | str, tag: str = "") -> T.StructField | None:
    """A field from a tag such as "id,pk", "region,index:place,fts" or "emb,vector(dim=4,metric=dot)"; an empty name in it is name; "-" is no field."""
    if tag == "-":
        return None
    own, *flags = [x.strip() for x in re.split(r",(?![^(]*\))", tag)] if tag else [""]
    given: dict = {}
    for flag in flags:
        what, _, rest = flag.partition("(") if flag.startswith("vector(") else flag.partition(":")
        if what in ("index", "unique"):
            given[what] = rest or True
        elif what in ("pk", "fts") and not rest:
            given[what] = True
        elif what == "vector":
            given["vector"] = {}
            for k, eq, v in (x.strip().partition("=") for x in rest.rstrip(")").split(",") if x.strip()):
                if k == "dim" and v.isdigit() and int(v) > 0:
                    given["vector"]["dim"] = int(v)
                elif k == "metric":
                    given["vector"]["metric"] = v
                elif k == "inline" and v in ("true", "false"):
                    given["vector"]["inline"] = v == "true"
                else:
                    raise SchemaError(f"{k}{eq}{v} is no setting of a vector")
        else:
            raise SchemaError(f"there is no flag {flag!r}")
    return field(own or name, kind, **given)


@dataclass(frozen=True)
class Spec:
    """What a schema's metadata says."""

    schema: T.StructType

    def __post_init__(self):
        names = [f.name for f in self.schema]
        if len(set(names)) < len(names):
            raise SchemaError("two fields have one name")
        if len([f for f in self.schema if "pk" in f.metadata]) > 1:
            raise SchemaError("two fields are the primary key")
        if len([f for f in self.schema if "vector" in f.metadata]) > 1:
            raise SchemaError("two fields are vectors")

    @property
    def key(self) -> str | None:
        return next((f.name for f in self.schema if "pk" in f.metadata), None)

    def groups(self, flag: str) -> dict[str, list[str]]:
        """Fields under one index or unique constraint, in the order of the schema."""
        out: dict[str, list[str]] = {}
        for f in self.schema:
            if flag in f.metadata:
                out.setdefault(f.metadata[flag] or f"={f.name}", []).append(f.name)
        return out

    @property
    def texts(self) -> list[str]:
        return [f.name for f in self.schema if "fts" in f.metadata and isinstance(f.dataType, T.StringType)]

    @property
    def vector(self) -> tuple[str, dict] | None:
        return next(((f.name, f.metadata["vector"]) for f in self.schema if "vector" in f.metadata), None)

    def fingerprint(self) -> str:
        """Equal for schemas with the same fields and flags in any order; how a vector is stored isn't part of it."""
        rows = []
        for f in self.schema:
            flags = ["P"] * ("pk" in f.metadata)
            for flag, mark in (("index", "I"), ("unique", "U")):
                if flag in f.metadata:
                    flags.append(mark + (f":{f.metadata[flag]}" if f.metadata[flag] else ""))
            flags += ["F"] * ("fts" in f.metadata)
            if v := f.metadata.get("vector"):
                flags.append(f"V:{v['dim']}:{v['metric']}")
            rows.append((f.name, f.dataType.simpleString(), *flags))
        return hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()
