"""Syntax trees of filters as Spark Columns.

A missing or null field fails every positive operator and satisfies every negated one. Values are typed by the column: a value that
can't be one equals nothing, and ordering by it is an error when the plan is built.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.plans.filters import Cond, Every, FilterError, Some

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NEGATED = {"ne": "eq", "nlike": "like", "nilike": "ilike", "nin": "in", "njin": "jin"}
_NOTHING = object()


class Json(T.StringType):
    """A value that was taken out of JSON text: a string whose type isn't known before it is read."""


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column at a dotted path through structs, maps, array places and JSON text; None where the schema has no such field."""
    steps = path.split(".")
    for n in range(len(steps), 0, -1):  # a column's own name may hold dots
        name = ".".join(steps[:n])
        if name in schema.names:
            c, kind, rest = F.col(f"`{name}`"), schema[name].dataType, steps[n:]
            break
    else:
        return None
    while rest:
        step = rest[0]
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return None
            c, kind = c.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(step).cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.ArrayType):
            if not step.isdigit():
                return None
            c, kind = F.try_element_at(c, F.lit(int(step) + 1)), kind.elementType
        elif isinstance(kind, T.StringType):
            inside = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in rest)
            return F.get_json_object(c, "$" + inside), Json()
        else:
            return None
        rest = rest[1:]
    return c, kind


def number(value) -> Decimal | None:
    if isinstance(value, bool):
        return Decimal(int(value))
    try:
        x = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return x if x.is_finite() else None


def typed(value, kind: T.DataType):
    """value as a literal of a column's type; _NOTHING where it can't be one."""
    if isinstance(kind, INTEGERS):
        x = number(value)
        if x is None:
            return _NOTHING
        return F.lit(int(x)) if x == int(x) and abs(x) < 2**63 else F.lit(x) if abs(x) < 10**18 else F.lit(float(x))
    if isinstance(kind, T.DecimalType):
        x = number(value)
        return _NOTHING if x is None else F.lit(x)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        try:
            x = float(value)
        except (TypeError, ValueError):
            return _NOTHING
        return F.lit(x).cast(kind) if isinstance(kind, T.FloatType) else F.lit(x)
    if isinstance(kind, T.BooleanType):
        known = {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
        return _NOTHING if known is None else F.lit(known)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        try:
            at = dt.datetime.fromisoformat(str(value))
        except ValueError:
            return _NOTHING
        if isinstance(kind, T.DateType):
            return F.lit(at.date())
        if isinstance(kind, T.TimestampNTZType):
            at = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
            return F.to_timestamp_ntz(F.lit(at.isoformat(sep=" ")))
        return F.lit(at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc))
    if isinstance(kind, T.BinaryType):
        return F.lit(str(value).encode())
    return F.lit(str(value))


def _plain(value) -> str:
    """A JSON scalar as the text that reading it gives."""
    return json.dumps(value) if isinstance(value, (bool, int, float)) else str(value)


def equals(c: Column, kind: T.DataType, value) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(kind, Json):
        x = number(value) if not isinstance(value, bool) else None
        same = c == F.lit(_plain(value))
        return same if x is None else same | (c.try_cast("double") == F.lit(float(x)))
    want = typed(value, kind)
    return F.lit(False) if want is _NOTHING else c == want


def ordered(c: Column, kind: T.DataType, op: str, value) -> Column:
    if isinstance(kind, Json):
        x = number(value)
        c, want = (c, F.lit(str(value))) if x is None else (c.try_cast("double"), F.lit(float(x)))
    else:
        want = typed(value, kind)
        if want is _NOTHING or isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
            raise FilterError(f"{value!r} has no order among values of type {kind.simpleString()}")
    return {"gt": c > want, "gte": c >= want, "lt": c < want, "lte": c <= want}[op]


def member(c: Column, kind: T.DataType, values) -> Column:
    if isinstance(kind, Json):
        return reduce(Column.__or__, [equals(c, kind, v) for v in values], F.lit(False))
    want = [x for x in (typed(v, kind) for v in values) if x is not _NOTHING]
    return c.isin(*want) if want else F.lit(False)


def likes(c: Column, kind: T.DataType, pattern: str, fold: bool) -> Column:
    """% is any run and _ any character; nothing escapes them."""
    text = c if isinstance(kind, T.StringType) else c.cast("string")
    pattern = str(pattern).replace("\\", "\\\\")
    return text.ilike(pattern) if fold else text.like(pattern)


def contains(c: Column, kind: T.DataType, want) -> Column:
    """JSON containment: objects hold the keys, arrays hold a fitting element for each wanted one, scalars are equal."""
    text = isinstance(kind, T.StringType)
    if isinstance(want, dict):
        parts = [c.isNotNull()]
        for key, value in want.items():
            if text:
                name = key.replace("'", "\\'")
                parts.append(contains(F.get_json_object(c, f"$['{name}']"), Json(), value))
            elif isinstance(kind, T.StructType) and key in kind.names:
                parts.append(contains(c.getField(key), kind[key].dataType, value))
            elif isinstance(kind, T.MapType):
                parts.append(contains(F.try_element_at(c, F.lit(key).cast(kind.keyType)), kind.valueType, value))
            else:
                return F.lit(False)
        return reduce(Column.__and__, parts)
    if isinstance(want, list):
        if text:
            c, inner = F.from_json(c, "array<string>"), Json()
        elif isinstance(kind, T.ArrayType):
            inner = kind.elementType
        else:
            return F.lit(False)
        return reduce(Column.__and__, [c.isNotNull(), *[_holds(c, inner, v) for v in want]])
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.lit(False)
    return equals(c, Json() if text and not isinstance(kind, Json) else kind, want)


def _holds(c: Column, inner: T.DataType, want) -> Column:
    return F.exists(c, lambda x: F.coalesce(contains(x, inner, want), F.lit(False)))


def any_of(c: Column, kind: T.DataType, values) -> Column:
    """An array with any of the values, compared as text; a string that is one of them."""
    want = F.array(*[F.lit(str(v)) for v in values])
    if isinstance(kind, T.ArrayType):
        return F.arrays_overlap(F.transform(c, lambda x: x.cast("string")), want)
    if isinstance(kind, Json):
        return F.coalesce(F.arrays_overlap(F.from_json(c, "array<string>"), want), c.isin(*map(str, values)))
    return c.isin(*map(str, values)) if isinstance(kind, T.StringType) else F.lit(False)


def _positive(c: Column, kind: T.DataType, op: str, value) -> Column:
    if op == "eq":
        return equals(c, kind, value)
    if op in ("gt", "gte", "lt", "lte"):
        return ordered(c, kind, op, value)
    if op in ("like", "ilike"):
        return likes(c, kind, value, op == "ilike")
    values = value if isinstance(value, (tuple, list)) else (value,)
    return member(c, kind, values) if op == "in" else any_of(c, kind, values) if op == "jin" else contains(c, kind, value)


def condition(schema: T.StructType, cond: Cond) -> Column:
    found = resolve(schema, cond.field)
    if cond.op in ("is", "not"):
        missing = found[0].isNull() if found else F.lit(True)
        return missing if cond.op == "is" else ~missing
    if cond.op in NEGATED:
        if found is None:
            return F.lit(True)
        c, kind = found
        if cond.op == "ne" and not isinstance(kind, Json):
            want = typed(cond.value, kind)
            return F.lit(True) if want is _NOTHING else ~c.eqNullSafe(want)
        return c.isNull() | ~F.coalesce(_positive(c, kind, NEGATED[cond.op], cond.value), F.lit(False)) if cond.op == "njin" else c.isNull() | ~_positive(c, kind, NEGATED[cond.op], cond.value)
    return F.lit(False) if found is None else _positive(*found, cond.op, cond.value)


def column(schema: T.StructType, node) -> Column:
    """The predicate of a syntax tree; an empty group is true."""
    if isinstance(node, Cond):
        return condition(schema, node)
    parts = [column(schema, p) for p in node.parts]
    if not parts:
        return F.lit(True)
    assert isinstance(node, (Every, Some))
    return reduce(Column.__and__ if isinstance(node, Every) else Column.__or__, parts)
