"""Operator 1: toxic spans by a linear-chain conditional random field.

The tokens of a bounded sample of labelled documents are labelled first: in a toxic document, a token is toxic whose word, or
whose prefix, occurs in toxic documents beyond chance and hardly ever in clean ones. A chain with two states is fitted to
these labels: its steps from state to state by their counts, what its tokens say by some rounds down the gradient of its likelihood. For tokens that were
labelled by hand, train_tokens() fits all of it, with what the tokens before and after say, by that gradient until it is small. Every document's whole text then goes through forward-backward; the marginals
give the score 1 - prod(1 - p) and the offsets of the spans whose tokens have p >= 1/2.

Edge cases: a null text has a null score, flag and span list; a text without word characters scores 0; repeated rows score
alike; a document with several labels is toxic if any says so; labels that are null or neither 0 nor 1 are ignored; an empty table gives an empty
result; very long texts are one chain; without labelled toxic documents everything scores near 0.
Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices

#: Labelled documents that the fit uses at most, by the order of a hash of their ids.
MAX_TOXIC, MAX_CLEAN = 1_000, 2_000
PREFIXES = (3, 4, 5, 6)
WORD = re.compile(r"\w+")


def traits(word: str) -> list[str]:
    """What a token's emission depends on: its word and its prefixes, in lower case."""
    low = word.lower()
    return ["=" + low, *["^" + low[:k] for k in PREFIXES if len(low) > k]]


def chain(emission: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, width: int = 512, sums: bool = False):
    """Marginals of state 1 for sequences that follow one another, with emission[t] the log odds at t and first[t] where one begins. sums: also how many steps
    from each state to each are expected, and the logarithm of the sum over all paths. move and start are any positive weights.

    Exact, in rounds over parts of `width` tokens side by side: the transfer matrix of each part, the states between the
    parts, then the states within them, forward and backward.
    """
    n = len(emission)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if sums else np.zeros(0)
    width = max(1, min(width, int(np.sqrt(n)) + 1))
    parts = -(-n // width)
    odds = np.ones(parts * width)
    odds[:n] = np.exp(np.clip(emission, -60, 60))
    begin = np.ones(parts * width, bool)  # what fills up the last part stands for sequences of its own
    begin[:n] = first
    odds, begin = odds.reshape(parts, width).T, begin.reshape(parts, width).T
    t = [[np.where(begin, start[j], move[i, j]) * (odds if j else 1.0) for j in (0, 1)] for i in (0, 1)]

    def step(a0, a1, k):
        return a0 * t[0][0][k] + a1 * t[1][0][k], a0 * t[0][1][k] + a1 * t[1][1][k]

    # a[i][j]: weight of leaving a part in j after entering it from i
    a00, a01, a10, a11 = np.ones(parts), np.zeros(parts), np.zeros(parts), np.ones(parts)
    for k in range(width):
        a00, a01 = step(a00, a01, k)
        a10, a11 = step(a10, a11, k)
        s = 1 / (a00 + a01 + a10 + a11)
        a00, a01, a10, a11 = a00 * s, a01 * s, a10 * s, a11 * s
    a = np.array([[a00, a01], [a10, a11]])
    forward, backward = np.empty((parts, 2)), np.empty((parts, 2))
    f = np.array([0.5, 0.5])
    for p in range(parts):
        forward[p] = f
        f = f @ a[:, :, p]
        f /= f.sum()
    b = np.array([0.5, 0.5])
    for p in range(parts - 1, -1, -1):
        backward[p] = b
        b = a[:, :, p] @ b
        b /= b.sum()
    ahead = np.empty((width, 2, parts))
    x0, x1 = forward[:, 0], forward[:, 1]
    real = (np.arange(parts)[None] * width + np.arange(width)[:, None]) < n
    total, pairs = 0.0, np.zeros((2, 2))
    for k in range(width):
        x0, x1 = step(x0, x1, k)
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        if sums:
            total += float(np.log(s[real[k]]).sum())
        ahead[k, 0], ahead[k, 1] = x0, x1
    p = np.empty((width, parts))
    y0, y1 = backward[:, 0], backward[:, 1]
    for k in range(width - 1, -1, -1):
        on, off = ahead[k, 1] * y1, ahead[k, 0] * y0
        p[k] = on / (on + off)
        if sums:
            before = (ahead[k - 1, 0], ahead[k - 1, 1]) if k else (forward[:, 0], forward[:, 1])
            w = np.array([[before[i] * t[i][j][k] * (y1 if j else y0) for j in (0, 1)] for i in (0, 1)])
            w /= w.sum((0, 1))
            pairs += w[:, :, real[k] & ~begin[k]].sum(2)
        y0, y1 = t[0][0][k] * y0 + t[0][1][k] * y1, t[1][0][k] * y0 + t[1][1][k] * y1
        s = y0 + y1
        y0, y1 = y0 / s, y1 / s
    marginals = p.T.ravel()[:n]
    return (marginals, pairs, total) if sums else marginals


class Model:
    """weights: of a token's own traits; near: of the traits of the token before it and of the one after it."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, start: np.ndarray, near: tuple[dict[str, float], dict[str, float]] = ({}, {})):
        self.weights, self.bias, self.move, self.start, self.near = weights, bias, move, start, near
        self._seen: dict[str, tuple[float, float, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def emissions(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """Log odds of each token; first: where a text begins."""
        seen, tables = self._seen, (self.weights, *self.near)
        if len(seen) > 300_000:
            seen.clear()
        for word in set(words).difference(seen):
            own = traits(word)
            seen[word] = tuple(sum([w.get(x, 0.0) for x in own]) for w in tables)
        if not words:
            return np.zeros(0)
        e = np.array(list(map(seen.__getitem__, words)))
        out = self.bias + e[:, 0]
        out[1:] += np.where(first[1:], 0.0, e[:-1, 1])
        out[:-1] += np.where(first[1:], 0.0, e[1:, 2])
        return out

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        sizes = [len(x) for x in texts]
        ends = np.cumsum(sizes)
        first = np.zeros(ends[-1] if len(ends) else 0, bool)
        first[[e - s for e, s in zip(ends, sizes) if s]] = True
        p = chain(self.emissions([w for x in texts for w in x], first), first, self.move, self.start)
        return np.split(p, ends[:-1]) if len(ends) else []


def _origins(words: list[str]) -> tuple[int, ...]:
    """Least hashes of a text's word triples under four functions: copies and near copies mostly share them."""
    import xxhash

    triples = {" ".join(words[i : i + 3]).lower() for i in range(max(1, len(words) - 2))}
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in triples), np.uint64, len(triples))
    with np.errstate(over="ignore"):
        return tuple(int((h * np.uint64(m)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def label_tokens(texts: list[list[str]], toxic: np.ndarray) -> tuple[list[np.ndarray], list[str]]:
    """0 or 1 for each token, from the documents' labels; and the telling traits. Copies of a document count once."""
    origins: dict[tuple, set] = {}
    seen: dict[str, list] = {}
    for words, bad in zip(texts, toxic):
        own = _origins(words) if words else (0, 0, 0, 0)
        for i, o in enumerate(own):
            origins.setdefault((bool(bad), i), set()).add(o)
        for x in {y for w in set(words) for y in traits(w)}:
            entry = seen.setdefault(x, [[], []])
            entry[int(bad)].append(own)
    n0, n1 = (max(1, min([len(origins.get((bad, i), ())) for i in range(4)])) for bad in (False, True))
    count = {x: [min(len({o[i] for o in side}) for i in range(4)) if side else 0 for side in entry] for x, entry in seen.items() if len(entry[1]) >= 3}
    need = np.log(max(len(seen), 2) / 0.1)
    share = n1 / (n1 + n0)
    found = {}
    for x, (clean, bad) in count.items():
        if bad >= 3:
            both = bad + clean
            gain = bad * np.log(bad / both / share) + (clean * np.log(max(clean / both / (1 - share), 1e-12)) if clean else 0)
            if gain >= need and bad / n1 >= 0.98 * (bad / n1 + clean / n0):
                found[x] = bad
    # a prefix that says no more than a longer one, or than one word, gives way to it
    for x in sorted(found, key=len, reverse=True):
        for k in PREFIXES:
            if x in found and k < len(x) - 1 and (shorter := "^" + x[1 : k + 1]) in found and found[shorter] <= found[x] * 1.02:
                del found[shorter]
    hit: dict[str, bool] = {}

    def marked(w: str) -> bool:
        if w not in hit:
            hit[w] = any(x in found for x in traits(w))
        return hit[w]

    return [np.array([bad and marked(w) for w in words], bool) for words, bad in zip(texts, toxic)], sorted(found)


def descend(f, x: np.ndarray, rounds: int, small: float) -> np.ndarray:
    """The least point of a smooth convex f, which gives its value and gradient, by limited-memory quasi-Newton steps until no part of the gradient exceeds small."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= small:
            break
        d, held = -g, []
        for s, y, r in reversed(steps):
            a = r * (s @ d)
            held.append(a)
            d = d - a * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(held)):
            d = d + s * (a - r * (y @ d))
        slope, t = float(g @ d), 1.0 if steps else min(1.0, 1.0 / np.abs(g).max())
        for _ in range(30):
            other, og = f(x + t * d)
            if other <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, og - g
        if (sy := float(s @ y)) > 1e-12:
            steps = [*steps[-9:], (s, y, 1 / sy)]
        x, value, g = x + s, other, og
    return x


def train_tokens(texts: list[list[str]], labels: list[np.ndarray], telling: list[str] | None = None, rounds: int = 150, small: float = 1e-3, l2: float = 1e-3) -> Model:
    """The chain that makes the labels of the tokens most likely, with a weak normal prior. telling: the traits that count, else all of labelled tokens and of their neighbours."""
    texts, labels = [x for x in texts if x], [y for x, y in zip(texts, labels) if x]
    move, start = np.full((2, 2), 0.5), np.array([0.9, 0.1])
    if not any(y.any() for y in labels):
        return Model({}, -20.0, move, start)
    if telling is None:
        near = {x[k] for x, y in zip(texts, labels) for j in np.flatnonzero(y).tolist() for k in (j - 1, j, j + 1) if 0 <= k < len(x)}
        telling = sorted({t for w in near for t in traits(w)})
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for x in texts for w in x])
    y = np.concatenate(labels).astype(np.int64)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0] + [len(x) for x in texts[:-1]])] = True
    held = {t: i for i, t in enumerate(telling)}
    pairs = np.array([(i, held[t]) for w, i in ids.items() for t in traits(w) if t in held]).reshape(-1, 2)
    row, column, k = pairs[:, 0], pairs[:, 1], len(held)
    inner = ~first[1:]
    then, now = y[:-1][inner], y[1:][inner]
    seen_moves, seen_start = np.bincount(then * 2 + now, minlength=4).astype(float), np.bincount(y[first], minlength=2).astype(float)

    def traits_of(x):  # of tokens: their own, the one before and the one after
        by = [np.bincount(flat, x, len(ids)), np.bincount(flat[:-1][inner], x[1:][inner], len(ids)), np.bincount(flat[1:][inner], x[:-1][inner], len(ids))]
        return np.concatenate([np.bincount(column, b[row], k) for b in by])

    def loss(v):
        own, before, after = (np.bincount(row, v[i * k : i * k + k][column], len(ids)) for i in range(3))
        e = v[3 * k] + own[flat]
        e[1:] += np.where(inner, before[flat[:-1]], 0.0)
        e[:-1] += np.where(inner, after[flat[1:]], 0.0)
        e = np.clip(e, -60, 60)
        steps, begin = v[3 * k + 1 : 3 * k + 5], v[3 * k + 5 :]
        p, moves, total = chain(e, first, np.exp(steps).reshape(2, 2), np.exp(begin), sums=True)
        value = total - float(e @ y) - float(steps @ seen_moves) - float(begin @ seen_start)
        starts = np.array([(1 - p[first]).sum(), p[first].sum()])
        g = np.concatenate([traits_of(p - y), [float((p - y).sum())], moves.ravel() - seen_moves, starts - seen_start])
        return value + 0.5 * l2 * float(v @ v), g + l2 * v

    x = np.zeros(3 * k + 7)
    x[3 * k] = -4.0
    x = descend(loss, x, rounds, small * max(1.0, float(y.sum())))
    tables = [{t: float(x[j * k + i]) for t, i in held.items() if abs(x[j * k + i]) >= 1e-3} for j in range(3)]
    return Model(tables[0], float(x[3 * k]), np.exp(x[3 * k + 1 : 3 * k + 5]).reshape(2, 2), np.exp(x[3 * k + 5 :]), (tables[1], tables[2]))


def train(texts: list[list[str]], toxic: np.ndarray, rounds: int = 25, rate: float = 0.5, l2: float = 1e-6) -> Model:
    """The chain of documents that are labelled as wholes. Steps from state to state are counted; the weights of the telling traits begin at a high value and go
    down the gradient of the chains' likelihood a fixed number of rounds, so that one trait alone, which few documents speak for, doesn't flag a document.
    """
    labels, telling = label_tokens(texts, toxic)
    cut = [(x, y) for x, y in zip(texts, labels) if x]
    move, start = np.full((2, 2), 0.5), np.array([0.9, 0.1])
    if not any(y.any() for _, y in cut):
        return Model({}, -20.0, move, start)
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for x, _ in cut for w in x])
    y = np.concatenate([y for _, y in cut])
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0] + [len(x) for x, _ in cut[:-1]])] = True
    held = {t: i for i, t in enumerate(telling)}
    row, column = np.array([(i, held[t]) for w, i in ids.items() for t in traits(w) if t in held]).T
    # transitions are estimated from the labelled chains, with one count added to each
    then, now = y[:-1][~first[1:]], y[1:][~first[1:]]
    seen = np.bincount(then * 2 + now, minlength=4).reshape(2, 2) + 1.0
    move = seen / seen.sum(1, keepdims=True)
    seen = np.bincount(y[first].astype(int), minlength=2) + 1.0
    start = seen / seen.sum()
    w, bias = np.full(len(held), 18.0), -10.0
    m, v, bm, bv = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    total = len(flat)
    seen_y = np.bincount(flat, y, len(ids))
    for r in range(1, rounds + 1):
        e = bias + np.bincount(row, w[column], len(ids))
        p = chain(e[flat], first, move, start)
        by_word = np.bincount(flat, p, len(ids)) - seen_y
        g = np.bincount(column, by_word[row], len(held)) / total * 1e3 + l2 * w * 1e3
        gb = by_word.sum() / total * 1e3
        m, v, bm, bv = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        a, b = 1 - 0.9**r, 1 - 0.99**r
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        bias -= 0.02 * rate * (bm / a) / (np.sqrt(bv / b) + 1e-6)
    return Model({t: float(w[i]) for t, i in held.items() if abs(w[i]) >= 0.05}, float(bias), move, start)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """The model of at most max_toxic and max_clean labelled documents; what is broadcast and what reaches the driver are bounded by them."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    some = [known.where(F.col("_toxic") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for bad, most in ((1, max_toxic), (0, max_clean))]
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(some[0].union(some[1])), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    return train([WORD.findall(t) for t in rows["text"]], rows["_toxic"].to_numpy(bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic, spans) for every row; spans: start and end as character offsets in the text, and the largest marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches):
        own = shared.value
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            words = [WORD.findall(t or "") for t in texts]
            scores, spans = [], []
            for text, p in zip(texts, own.marginals(words)):
                if text is None:
                    scores.append(None)
                    spans.append(None)
                    continue
                scores.append(round(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), 9))
                found: list[dict] = []
                if len(p) and p.max() >= 0.5:
                    after = -1
                    for k, match in enumerate(WORD.finditer(text)):
                        if p[k] >= 0.5:
                            if after == k:
                                found[-1]["end"], found[-1]["score"] = match.end(), max(found[-1]["score"], float(p[k]))
                            else:
                                found.append({"start": match.start(), "end": match.end(), "score": float(p[k])})
                            after = k + 1
                spans.append(found)
            flags = [None if s is None else s >= 0.5 for s in scores]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "toxic", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean, spans array<struct<start:int,end:int,score:double>>")
