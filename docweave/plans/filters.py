"""URL-style filter strings as a small syntax tree.

`&` binds tighter than `|`, parentheses group. A condition is field=value, field[op]=value, or field=a,b for membership.
Parts whose field starts with an underscore (_sort, _limit, _offset, _fields) aren't conditions, wherever they stand.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from urllib.parse import unquote_plus

OPERATORS = {"eq", "ne", "gt", "gte", "lt", "lte", "like", "ilike", "nlike", "nilike", "in", "nin", "is", "not", "kv", "jin", "njin"}
LISTS = {"in", "nin", "jin", "njin"}


class FilterError(ValueError):
    """A filter string, or a value in it, that can't be used."""


@dataclass(frozen=True)
class Cond:
    field: str
    op: str = "eq"
    value: object = None


@dataclass(frozen=True)
class Every:
    parts: tuple = ()


@dataclass(frozen=True)
class Some:
    parts: tuple = ()


@dataclass
class Query:
    where: object = Every()
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int = 0
    offset: int = 0
    fields: list[str] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.query = text, 0, Query()

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def chain(self, mark: str, inner, kind):
        parts = [inner()]
        while self.peek() == mark:
            self.at += 1
            parts.append(inner())
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else kind(tuple(parts))

    def either(self):
        return self.chain("|", self.both, Some)

    def both(self):
        return self.chain("&", self.atom, Every)

    def atom(self):
        if self.peek() == "(":
            self.at += 1
            inside = self.either()
            if self.peek() != ")":
                raise FilterError(f"a parenthesis isn't closed in {self.text!r}")
            self.at += 1
            return inside
        start, deep = self.at, 0
        while (c := self.peek()) and not (c in "&|" and not deep):
            if c == ")" and not deep:
                break
            deep += (c == "(") - (c == ")")
            self.at += 1
        return self.condition(self.text[start : self.at])

    def condition(self, raw: str):
        if not raw:
            return None
        name, eq, value = raw.partition("=")
        name, op = unquote_plus(name).strip(), "eq"
        if name.endswith("]") and "[" in name:
            name, _, op = name[:-1].rpartition("[")
            op = op.lower() or "eq"
        if name.startswith("_"):
            return self.directive(name, unquote_plus(value))
        if op not in OPERATORS:
            raise FilterError(f"there is no operator {op!r}")
        if not name or not eq:
            raise FilterError(f"{raw!r} is no condition")
        if op in LISTS:
            return Cond(name, op, tuple(unquote_plus(v) for v in value.split(",")))
        if op == "eq" and "," in value:
            return Cond(name, "in", tuple(unquote_plus(v) for v in value.split(",")))
        value = unquote_plus(value)
        return Cond(name, op, json_value(value) if op == "kv" else value)

    def directive(self, name: str, value: str) -> None:
        if name == "_sort":
            self.query.sort = [(k.lstrip("+-"), k.startswith("-")) for k in (x.strip() for x in value.split(",")) if k.lstrip("+-")]
        elif name in ("_limit", "_offset"):
            if not value.isdigit():
                raise FilterError(f"{name} must be a number, not {value!r}")
            setattr(self.query, name[1:], int(value))
        elif name == "_fields":
            self.query.fields = [x.strip() for x in value.split(",") if x.strip()]
        else:
            raise FilterError(f"there is no directive {name!r}")


def json_value(text: str):
    """JSON text, plain or as unpadded base64url."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError as x:
        raise FilterError(f"{text!r} is no JSON") from x


def parse(text: str) -> Query:
    p = _Parser(text.lstrip("?"))
    where = p.either()
    if p.at < len(p.text):
        raise FilterError(f"a parenthesis too many at {p.at} in {text!r}")
    p.query.where = where if where is not None else Every()
    return p.query
