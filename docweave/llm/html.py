"""Operator 8: the main text of web pages by block rules in two passes.

A page falls into blocks at block-level tags. The first pass looks at each block alone: its link density, its length and the share of its
words that are stop words make it good, bad, nearly good, or, if it is short, undecided. In the second pass undecided blocks inherit from
the nearest blocks that are decided: a short one takes the label of the nearer neighbour, and is bad between equally near ones that differ or where
there is none; a nearly good one is bad only between bad ones. The good blocks are the text.

Edge cases: a null page has null results; an empty page, or one without text, an empty text and no blocks; unclosed tags end with the
page, and a "<" that opens no tag is text; repeated rows each give a row; long pages are parsed whole, in linear time; an empty table gives
an empty result; of two decided neighbours at one distance the one before counts. Words are runs between spaces, so that pages in scripts without spaces have none
to count and come back empty. Only page_id and
html are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import slices

#: Blocks shorter than SHORT characters are undecided, and those longer than LONG with many stop words are good.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.2, 0.2
STOP = {
    "en": "a about after all also an and any are as at be been but by can could do for from had has have he her his i if in into is it its more my no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "fr": "a au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui ma mais me même mes nous on ou par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die dies dieser du durch ein eine einem einen einer eines er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wir zu zum zur",
    "es": "a al como con de del desde dos el ella en entre era es esta este está fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también te un una uno y ya",
}
LISTS = {k: frozenset(v.split()) for k, v in STOP.items()}
EVERY = frozenset().union(*LISTS.values())
BLOCK = frozenset("address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|svg|iframe|object|title|textarea)\b[^>]*+>.*?(?:</\1\s*+>|\Z)
    |<(/?[a-z][a-z0-9:-]*+)(?:[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>|[^<>]*+(?:>|\Z))
    |<[!?][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", re.I)
GOOD, BAD, NEARLY, UNDECIDED = "good", "bad", "nearly", "short"


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, characters in links) of the blocks that have text, in order."""
    out: list[tuple[str, int]] = []
    texts: list[str] = []
    linked = links = 0
    at, br = 0, False

    def add(a: int, b: int) -> None:
        nonlocal linked, br
        piece = page[a:b]
        if "&" in piece:
            piece = unescape(piece)
        if links:
            linked += len("".join(piece.split()))
        if piece and not piece.isspace():
            br = False
        texts.append(piece)

    def close() -> None:
        nonlocal linked, br
        br = False
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                out.append((text, linked))
        linked = 0

    for m in TOKEN.finditer(page):
        a, b = m.span()
        if a > at:
            add(at, a)
        at = b
        if (name := m.group(2)) is not None:
            name = name.lower()
            if name in BLOCK or name[1:] in BLOCK and name[0] == "/":
                close()
            elif name == "a":
                links = 1  # links don't nest
            elif name == "/a":
                links = 0
            elif name == "br":  # two in a row part blocks, one is a space
                if br:
                    close()
                else:
                    texts.append(" ")
                    br = True
    if at < len(page):
        add(at, len(page))
    close()
    return out


def first_pass(text: str, linked: int, stop: frozenset) -> str:
    n = len(text)
    words = text.lower().split()
    letters = n - len(words) + 1
    if linked / letters > LINKS or "©" in text:
        return BAD
    if n < SHORT:
        return BAD if linked else UNDECIDED
    share = sum(map(stop.__contains__, [w.strip(".,;:!?\"'()") for w in words])) / len(words)
    if share >= STOP_HIGH:
        return GOOD if n > LONG else NEARLY
    return NEARLY if share >= STOP_LOW else BAD


def second_pass(labels: list[str]) -> list[bool]:
    """Whether each block is good."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] in (GOOD, BAD) else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] in (GOOD, BAD) else after[i + 1]
    out = []
    for i, x in enumerate(labels):
        if x in (GOOD, BAD):
            out.append(x == GOOD)
            continue
        left = labels[before[i]] if before[i] >= 0 else None
        right = labels[after[i]] if after[i] < n else None
        if x == NEARLY:
            out.append(GOOD in (left, right) or left is right is None)
        elif left == right or left is None or right is None:
            out.append((left or right) == GOOD)
        else:
            a, b = i - before[i], after[i] - i
            out.append(a != b and (left if a < b else right) == GOOD)
    return out


def extract(page: str) -> tuple[str, list[str], list[bool]]:
    """(text, labels of the first pass, good or not)."""
    found = blocks(page)
    lang = LANG.search(page)
    stop = LISTS.get(lang.group(1).lower(), EVERY) if lang else EVERY
    labels = [first_pass(t, k, stop) for t, k in found]
    good = second_pass(labels)
    return "\n".join([t for (t, _), g in zip(found, good) if g]), labels, good


def text_of(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_good, labels, good) for every row; labels and good are by block. No shuffle."""

    def run(batches):
        for part in slices(batches):
            rows = [(None, None, None) if p is None else extract(p) for p in part.column(1).to_pylist()]
            text, labels, good = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(text, pa.string()), pa.array([None if x is None else len(x) for x in labels], pa.int32()), pa.array([None if x is None else sum(x) for x in good], pa.int32()), pa.array(labels, pa.list_(pa.string())), pa.array(good, pa.list_(pa.bool_()))],
                names=["page_id", "text", "n_blocks", "n_good", "labels", "good"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string, n_blocks int, n_good int, labels array<string>, good array<boolean>")
