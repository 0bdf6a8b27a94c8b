"""Operator 4: a quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text: counts and ratios of its characters and words, and how its words fall into WORDS classes
by their hashes. The weights maximise the likelihood that, in preference pairs of
a labelled good and a labelled bad document, the good one wins: logistic loss on feature differences. They are fitted on a bounded sample of labelled
documents. Documents are kept whose score reaches the quantile of the scores of all labelled documents that the share of bad labels names; it is
read from counts of the scores in BINS bins, so that any number of labels gives a result of one size.

Edge cases: a null text has a null score and is rejected; an empty text is scored like any other; equal texts have equal
scores, and a score equal to the threshold is kept; a document with several labels is good if any says so; null or missing labels are ignored; an empty
table gives an empty result; very long texts are read whole; without labels of both kinds, all
non-null texts score 0 and are kept. Columns other than doc_id and text are passed on by select(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import joined, mix, slices

#: Labelled documents that the fit uses at most, by the order of a hash of their ids.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: Classes of words, and bins of the scores of labelled documents.
WORDS, BINS = 32, 1 << 16
NAMES = ("log_words", "upper", "bang", "bar", "symbol", "digit", "newline", "word_length", "adjacent_repeat", "distinct", "sqrt_upper", "sqrt_bang", "sqrt_bar", "sqrt_symbol", "sqrt_repeat", *(f"words_{i}" for i in range(WORDS)))

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_"]] = 8
_CLASS[128:] = 9
_BASE = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text, from its UTF-8 bytes; nulls count as empty."""
    n = len(texts)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(n), sizes)
    kind = _CLASS[raw]
    by = np.bincount(doc * 16 + kind, minlength=16 * n).reshape(n, 16).astype(float)
    space = (kind == 4) | (kind == 5)
    first = np.zeros(len(raw), bool)
    first[(ends[:-1] - ends[0])[sizes > 0]] = True
    starts = np.flatnonzero(~space & (first | np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, bool))
    last = np.concatenate([first[1:], [True]]) if len(raw) else first
    stops = np.flatnonzero(~space & (last | np.concatenate([space[1:], [True]])) if len(raw) else np.zeros(0, bool)) + 1
    owner = doc[starts] if len(raw) else np.zeros(0, np.int64)
    words = np.bincount(owner, minlength=n).astype(float)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), _BASE)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        h = (total[stops] - total[starts]) * down[starts]
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) if len(h) else np.zeros(0, bool)
    repeats = np.bincount(owner[1:][same], minlength=n) if len(h) else np.zeros(n)
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    fresh = np.concatenate([[True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])]) if len(ho) else np.zeros(0, bool)
    distinct = np.bincount(oo[fresh], minlength=n)
    per = np.maximum(words, 1)
    classes = np.bincount(owner * WORDS + (mix(h) >> np.uint64(32)).astype(np.int64) % WORDS, minlength=WORDS * n).reshape(n, WORDS) / per[:, None] if len(h) else np.zeros((n, WORDS))
    letters = by[:, 1] + by[:, 2]
    upper, bang, bar, symbol = by[:, 2] / np.maximum(letters, 1), by[:, 6] / per, by[:, 7] / per, by[:, 8] / per
    repeat = repeats / per
    columns = [np.log1p(words), upper, bang, bar, symbol, by[:, 3] / np.maximum(sizes, 1), by[:, 5] / per, (sizes - by[:, 4] - by[:, 5]) / per, repeat, distinct / per]
    return np.column_stack([*columns, *map(np.sqrt, (upper, bang, bar, symbol, repeat)), classes])


class Model:
    """weights are for standardized features; keep is score >= threshold."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        # one sum after the other: equal rows score equally in any batch
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        total = np.zeros(len(x))
        for j, w in enumerate(self.weights):
            total += z[:, j] * w
        return total


def train(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, rounds: int = 30) -> Model:
    """Newton's method on the mean logistic loss of the differences of good and bad rows."""
    k = x.shape[1] if x.ndim == 2 else len(NAMES)
    if not good.any() or good.all():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), -np.inf)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(7)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    left, right = rng.choice(winners, pairs), rng.choice(losers, pairs)
    w = np.zeros(k)
    for _ in range(rounds):
        gradient, hessian = l2 * w, l2 * np.eye(k)
        for a in range(0, pairs, 20_000):
            d = z[left[a : a + 20_000]] - z[right[a : a + 20_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
            gradient = gradient + d.T @ (p - 1) / pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)
    ranked = np.sort(model.score(x))
    at = int((~good).sum())
    model.threshold = float((ranked[at - 1] + ranked[at]) / 2)
    return model


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_good"))


def cut(docs: DataFrame, labels: DataFrame, model: Model) -> float:
    """The score below which lie as many of all labelled documents as are labelled bad, to a bin of the range that scores can have."""
    known = _labelled(labels)
    reach = 8 * float(np.abs(model.weights).sum())
    if not reach:
        return model.threshold
    picked = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    size = 64 * known.count()
    picked = joined(picked, known.withColumnRenamed("_id", "doc_id"), size, "doc_id", "inner")

    def run(batches):
        total = np.zeros(2 * BINS, np.int64)
        for part in slices(batches):
            at = np.clip(((model.score(features(part.column(1))) + reach) / (2 * reach) * BINS).astype(np.int64), 0, BINS - 1)
            total += np.bincount(at * 2 + part.column(2).to_numpy(), minlength=2 * BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((some // 2).astype(np.int32)), pa.array((some % 2).astype(np.int32)), pa.array(total[some])], names=["bin", "good", "n"])

    rows = picked.select("doc_id", "text", "_good").mapInArrow(run, "bin int, good int, n bigint").groupBy("bin", "good").agg(F.sum("n").alias("n")).collect()
    bad = sum(r["n"] for r in rows if not r["good"])
    if not bad or bad == sum(r["n"] for r in rows):
        return model.threshold
    at = np.bincount([r["bin"] for r in rows], [r["n"] for r in rows], BINS)
    below = np.concatenate([[0], np.cumsum(at)])
    best = np.abs(below - bad)
    ties = np.flatnonzero(best == best.min())  # edges without a score between them
    return float((ties[0] + ties[-1]) / 2 / BINS * 2 * reach - reach)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """The model of at most bound labelled documents, and the threshold of all. Only the features of the sample reach the driver; the sample that is broadcast is no larger than bound."""
    picked = _labelled(labels).orderBy(F.xxhash64("_id"), "_id").limit(bound).withColumnRenamed("_id", "doc_id")
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for part in slices(batches):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", F.col("_good").cast("int").alias("_good")).mapInArrow(run, f"doc_id {kind}, good int, x array<double>").toPandas()
    if not len(rows):
        return train(np.zeros((0, len(NAMES))), np.zeros(0, bool))
    x, good = np.stack(rows["x"].to_numpy()), rows["good"].to_numpy() == 1
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy()))  # the rows' order must not matter
    model = train(x[order], good[order])
    model.threshold = cut(docs, labels, model)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, keep) for every row."""

    def run(batches):
        for part in slices(batches):
            null = part.column(1).is_null().to_numpy(zero_copy_only=False)
            s = model.score(features(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, mask=null), pa.array((s >= model.threshold) & ~null)], names=["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches):
            texts = part.column(at)
            keep = (model.score(features(texts)) >= model.threshold) & texts.is_valid().to_numpy(zero_copy_only=False)
            if keep.any():
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
