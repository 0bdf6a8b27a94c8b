"""Terms of texts: runs of letters and digits in lower case, and whole compounds of runs that . - _ / + @ join."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"[\p{L}\p{Nd}]+"
WORD = r"[\p{L}\p{Nd}][\p{L}\p{Nd}._/+@-]*"
JOINERS = "._/+@-"
JOINED = r"[\p{L}\p{Nd}][._/+@-]+[\p{L}\p{Nd}]"


def _compounds(low: Column) -> Column:
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))

    def of(word: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit(RUN), F.lit(0))
        whole = F.when(F.size(runs) > 1, F.regexp_replace(word, F.lit(f"[{JOINERS}]+$"), F.lit("")))
        return F.when(word.rlike(f"[{JOINERS}]"), F.transform(runs, lambda r, i: F.struct(r.alias("run"), F.when(i == 0, whole).alias("whole")))).otherwise(F.array(F.struct(word.alias("run"), F.lit(None).cast("string").alias("whole"))))

    return F.flatten(F.transform(words, of))


def occurrences(text: Column) -> Column:
    """array<struct<run, whole>>: each run in its place, which is its position; the first run of a compound carries the whole compound.

    Few texts have compounds; the others are a single pass over their runs.
    """
    low = F.lower(text)
    plain = F.transform(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)), lambda r: F.struct(r.alias("run"), F.lit(None).cast("string").alias("whole")))
    return F.when(low.rlike(JOINED), _compounds(low)).otherwise(plain)


def listed(text: Column) -> Column:
    """struct<terms, places>: the terms of occurrences() one after the other; places are null where each stands at its own index."""
    low = F.lower(text)

    def flat(o: Column) -> Column:
        terms = F.flatten(F.transform(o, lambda x: F.when(x["whole"].isNull(), F.array(x["run"])).otherwise(F.array(x["run"], x["whole"]))))
        places = F.flatten(F.transform(o, lambda x, i: F.when(x["whole"].isNull(), F.array(i)).otherwise(F.array(i, i))))
        return F.struct(terms.alias("terms"), places.alias("places"))

    plain = F.struct(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)).alias("terms"), F.lit(None).cast("array<int>").alias("places"))
    return F.when(low.rlike(JOINED), F.transform(F.array(_compounds(low)), flat)[0]).otherwise(plain)


def _letter(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd"


def terms(text: str) -> list[tuple[str, int]]:
    """(term, position) of a short text on the driver, by the same rules; runs of a word come before its compound."""
    out: list[tuple[str, int]] = []
    position = 0
    marked = "".join(c if _letter(c) else c if c in JOINERS else " " for c in text.lower())
    for word in marked.split():
        word = word.strip(JOINERS)
        runs = [r for r in re.split(f"[{re.escape(JOINERS)}]+", word) if r]
        out += [(r, position + i) for i, r in enumerate(runs)]
        if len(runs) > 1:
            out.append((word, position))
        position += len(runs)
    return out
