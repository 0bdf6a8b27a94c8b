"""Text queries: words are all wanted, "quoted words" as a phrase, OR between alternatives, NOT or - before what is unwanted, and word* by prefix.

The keywords may be in any case. NOT and - reach what follows them directly; two blanks after NOT cancel it. There are no parentheses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from docweave.functions.text import terms


@dataclass(frozen=True)
class Clause:
    kind: str  # term, prefix or phrase
    words: tuple[str, ...]


@dataclass
class TextQuery:
    required: list[Clause] = field(default_factory=list)
    groups: list[list[Clause]] = field(default_factory=list)
    excluded: list[Clause] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.required and not self.groups


@dataclass
class _Piece:
    text: str
    quoted: bool = False
    negated: bool = False
    either: bool = False


def pieces(query: str) -> list[_Piece]:
    out: list[_Piece] = []
    held, quoting, negated = "", False, False

    def end(quoted: bool) -> None:
        nonlocal held, negated
        text, held = held, ""
        if not text and not quoted:
            negated = False
        elif not quoted and text.upper() == "OR":
            out.append(_Piece("", either=True))
            negated = False
        elif not quoted and text.upper() == "NOT":
            negated = True
        else:
            out.append(_Piece(text, quoted, negated))
            negated = False

    for c in query:
        if c == '"':
            if quoting:
                end(True)
            quoting = not quoting
        elif quoting:
            held += c
        elif c in " \t\r\n":
            end(False)
        elif c == "-" and not held and not negated:
            negated = True
        else:
            held += c
    end(quoting)
    return out


def _steps(found: list[tuple[str, int]]) -> tuple[str, ...]:
    """The shortest term at each position."""
    by: dict[int, str] = {}
    for term, at in found:
        if at not in by or len(term.encode()) < len(by[at].encode()):
            by[at] = term
    return tuple(by[at] for at in sorted(by))


def clauses(piece: _Piece) -> list[Clause]:
    """What a piece stands for: one clause, the alternatives of a compound, or nothing."""
    text = piece.text
    if not piece.quoted and text.endswith("*") and len(text) > 1:
        text = text[:-1]
        found = terms(text)
        return [Clause("prefix", (found[0][0] if len(found) == 1 else text.lower(),))]
    found = terms(text)
    if not found:
        return []
    steps = _steps(found)
    longest = Clause("term", (max((t for t, _ in found), key=lambda t: len(t.encode())),))
    if len(steps) == 1:
        return [longest]
    phrase = Clause("phrase", steps)
    return [phrase] if piece.quoted else [longest, phrase]


def parse(query: str) -> TextQuery:
    q = TextQuery()
    waiting = False  # an OR stands before
    last: int | None = None  # where the positive clause before it is in required

    for piece in pieces(query):
        if piece.either:
            waiting = True
            continue
        found = clauses(piece)
        if not found:
            continue
        if piece.negated:
            q.excluded.append(found[0])
            last = None
        elif len(found) > 1 and not waiting:
            q.groups.append(found)
            last = None
        elif waiting and last is not None:
            q.groups.append([q.required.pop(last), found[0]])
            waiting, last = False, None
        elif waiting and q.groups:
            q.groups[-1].append(found[0])
            waiting = False
        else:
            waiting = False
            q.required.append(found[0])
            last = len(q.required) - 1
    return q
