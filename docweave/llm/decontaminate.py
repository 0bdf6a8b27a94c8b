"""Operator 9: benchmark decontamination by exact pieces, nested verification and exact edit distance.

Texts are compared in lower case with runs of white space as one space. A document holds an item where some run of its
characters lies within THETA of the item's length in edit distance, and every such pair is found: of an item that may be hurt by d
edits, d + 1 pieces are looked up at every place of every document, and one of them is whole wherever the item is held. Pieces stand
in groups of 2, 4 and 8; where the item is held, some group of s pieces is hurt by less than s edits, in it some half by less than
its pieces, and so down to a piece, so that a hit is followed only while its groups fit. What is left is decided by the edit distance.
Which pieces are taken changes the time, not the result: those that the shard's own items make out to be rare.

The keys of Chakraborty, Goldenberg and Koucky's walks (Embedding) map edit distance to Hamming distance: WALKS random walks, and
TABLES samples of BITS places of each. They may miss close pairs, so the search doesn't ask them.

The items are broadcast in shards of at most SHARD_CHARS characters, each with its own pass over the documents. Equal items are
searched once and each reported.

Edge cases: null texts hold nothing and null items are never found; items of fewer than three words are too general and are
skipped, where two characters of a script without spaces count as a word; repeated document rows each give their rows; long texts are scanned whole; an empty table
of documents or items gives an empty result, or leaves all rows. Only doc_id, text and item_id are read,
whatever other columns are called.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import mix, slices

#: Largest edit distance, as a share of the item's length.
THETA = 0.15
WALKS, TABLES, BITS = 8, 12, 4
SHARD_CHARS = 32_000_000
#: Characters of documents and hits that are worked on at once, and of an item that pieces are chosen in; bound memory, not the result.
CHARS_AT_ONCE, HITS_AT_ONCE, BLOCK = 1 << 20, 1 << 15, 400
#: Pieces in a group, each twice the one before.
GROUPS = (2, 4, 8)


#: Characters of scripts without spaces: Thai to Tibetan, Burmese, Khmer, kana, Chinese. Two count as a word.
SPACELESS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def telling(text: str) -> bool:
    """Whether a text has three words at least, of whatever script."""
    rest, n = SPACELESS.subn(" ", text)
    return len(rest.split()) + (n + 1) // 2 >= 3 or text.count(" ") >= 2


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def nearest_run(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between item and any run of characters of text, or any that begins it, and where the first such run ends. Myers' bit vectors."""
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, score = full, 0, len(item)
    best, end, first = score, 0, int(anchored)
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        plus, minus = down | ~(d0 | up) & full, d0 & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, j
        plus, minus = plus << 1 | first, minus << 1
        up, down = (minus | ~(d0 | plus)) & full, plus & d0 & full
    return best, end


def least_distance(item: str, text: str, most: int) -> int:
    """Least edit distance between item and any run of characters of text; most + 1 if it is larger."""
    return min(nearest_run(item, text)[0], most + 1) if item else 0


class Embedding:
    """Keys of strings of at most size characters: TABLES samples of each of WALKS random walks."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size, self.steps = size, 3 * size
        self.moves = rng.integers(0, 2, (WALKS, self.steps, 256), np.int8)
        self.samples = rng.random((WALKS, TABLES, BITS))
        self.factors = rng.integers(1, 1 << 62, BITS).astype(np.uint64) | np.uint64(1)

    def keys(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """(text, walk * TABLES + table): keys. lengths: of the item that the text is held against; its samples lie within three times that."""
        n = len(texts)
        chars = np.zeros((n, self.size + 1), np.uint8)  # 0 stands behind the end
        for i, t in enumerate(texts):
            c = np.frombuffer(t[: self.size].encode("utf-32-le", "surrogatepass"), np.uint32)
            chars[i, : len(c)] = c % 255 + 1
        # all walks of all texts go on together
        flat, width = chars.ravel(), self.size + 1
        base = np.tile(np.arange(n) * width, (WALKS, 1))
        end = base + self.size
        at = base.copy()
        steps = min(self.steps, 3 * int(lengths.max(initial=1)))
        walk = np.empty((steps, WALKS, n), np.uint8)
        moves = self.moves.reshape(WALKS, self.steps, 256)
        which = np.arange(WALKS)[:, None]
        for j in range(steps):
            c = walk[j] = flat[at]
            at += moves[which, j, c]
            np.minimum(at, end, out=at)
        out = np.zeros((n, WALKS * TABLES), np.uint64)
        every = np.arange(n)[:, None]
        reach = 3 * np.minimum(lengths, self.size)[:, None]
        with np.errstate(over="ignore"):
            for w in range(WALKS):
                for t in range(TABLES):
                    places = (self.samples[w, t] * reach).astype(np.int64)
                    h = (walk[places, w, every].astype(np.uint64) * self.factors).sum(1, dtype=np.uint64)
                    out[:, w * TABLES + t] = mix(h + np.uint64(w * TABLES + t) * np.uint64(0x9E3779B97F4A7C15))
        return out


def codes(texts: list[str]) -> np.ndarray:
    """The characters of texts one after the other, 16 bits each. Different characters may get equal codes."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return (c ^ c >> np.uint32(16)).astype(np.uint16)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A number for every run of q characters. Equal runs have equal numbers."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    c = ((c ^ c >> np.uint16(10)) & np.uint16(1023)).astype(np.uint64)
    out = c[: len(c) - q + 1]
    for i in range(1, q):
        out = out << np.uint64(10) | c[i : len(c) - q + 1 + i]
    return out


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def rarity(c: np.ndarray, q: int) -> np.ndarray:
    """About how often each run of q characters is to be expected, from the counts of runs of 3 and 2."""

    def counts(k):
        _, which, n = np.unique(grams(c, k), return_inverse=True, return_counts=True)
        return np.log(n[which])

    if q < 4:
        return np.exp(counts(q))
    three, two, n = counts(3), counts(2), len(c) - q + 1
    return np.exp(sum(three[i : i + n] for i in range(q - 2)) - sum(two[i : i + n] for i in range(1, q - 2)))


def choose(cost: np.ndarray, size: int, k: int, q: int) -> list[int]:
    """Where k runs of q characters of size begin that don't overlap and cost the least together."""
    best, took = np.zeros(size + 1), []
    for _ in range(k):
        with_it = best[: size - q + 1] + cost[: size - q + 1]
        least = np.minimum.accumulate(with_it)
        took.append(np.maximum.accumulate(np.where(with_it == least, np.arange(len(least)), 0)))
        best = np.concatenate([np.full(q, np.inf), least])
    out, end = [], size
    for t in reversed(took):
        end = int(t[end - q])
        out.append(end)
    return out[::-1]


def extension(pattern: np.ndarray, p: np.ndarray, text: np.ndarray, x: np.ndarray, length: np.ndarray, step: int, most: int) -> np.ndarray:
    """Least edit distance between length characters of pattern from p on and any characters of text from x on, both read by steps of 1 or -1; exact up to most."""
    wide, rows = 2 * most + 1, int(length.max(initial=0))
    t = [text.take(x + step * k, mode="clip") for k in range(-most, rows + most + 1)]
    big = 100
    now = np.full((wide, len(p)), big, np.uint8)
    for o in range(most, wide):
        now[o] = o - most
    out = now.min(0)
    for j in range(rows):
        c = pattern.take(p + step * j, mode="clip")
        new, more = np.empty_like(now), now + np.uint8(1)
        for o in range(wide):
            d = new[o]
            if j + o - most < -1:
                d[:] = big
                continue
            np.add(now[o], t[j + o] != c, out=d)
            if o + 1 < wide:
                np.minimum(d, more[o + 1], out=d)
            if o:
                np.minimum(d, new[o - 1] + np.uint8(1), out=d)
        now = np.minimum(new, big, out=new)
        live = length > j
        out = np.where(live, now.min(0), out)
    return out


class Index:
    """Items with their pieces, by number of characters of a piece."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if telling(t)]
        self.chars = np.array([len(t) for _, t in self.items], np.int64)
        self.most = (self.chars * THETA).astype(np.int64)
        self.same: dict[str, list[int]] = {}
        for k, (_, t) in enumerate(self.items):
            self.same.setdefault(t, []).append(k)
        self.texts = list(self.same)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.allowed = (size * THETA).astype(np.int64)
        self.size, self.begin = size, np.cumsum(size) - size
        self.flat = codes(self.texts)
        pieces = self.allowed + 1
        self.last = np.cumsum(pieces)  # piece numbers of an item end there
        of = np.repeat(np.arange(len(size)), pieces)
        at = np.zeros(len(of), np.int64)
        length = np.minimum(size // pieces, 6)
        self.tables = []
        for q in np.unique(length).tolist():
            cost = rarity(self.flat, q)
            mine = np.flatnonzero(length == q)
            for k in mine.tolist():
                n, total, start = int(size[k]), int(pieces[k]), int(self.begin[k])
                blocks = max(1, n // BLOCK)
                edges = [n * b // blocks for b in range(blocks + 1)]
                starts = []
                for a, b in zip(edges, edges[1:]):
                    here = cost[start + a : start + b - q + 1]
                    starts += [a + y for y in choose(here, b - a, total * b // n - total * a // n, q)]
                at[self.last[k] - total : self.last[k]] = starts
            number = np.flatnonzero(np.isin(of, mine))
            keys = grams(self.flat, q)[self.begin[of[number]] + at[number]]
            order = np.argsort(keys, kind="stable")
            unique, first, count = np.unique(keys[order], return_index=True, return_counts=True)
            bits = min(26, max(18, int(len(unique) * 32).bit_length()))
            near = np.zeros(1 << bits, bool)  # before the binary search
            near[spread(unique, bits)] = True
            self.tables.append((q, bits, near, unique, first, count, number[order]))
        self.of, self.at = of, at

    @cached_property
    def embedding(self) -> Embedding | None:
        return Embedding(int((self.chars.max(initial=1)) * (1 + THETA)) + 8) if self.items else None

    @cached_property
    def keys(self) -> np.ndarray:
        return self.embedding.keys([t for _, t in self.items], self.chars) if self.items else np.zeros((0, WALKS * TABLES), np.uint64)

    def seeds(self, c: np.ndarray):
        """(place, piece, characters of the piece) of every piece that stands in c, in lots."""
        for q, bits, near, unique, first, count, number in self.tables:
            for lo in range(0, max(len(c) - q + 1, 0), CHARS_AT_ONCE):
                g = grams(c[lo : lo + CHARS_AT_ONCE + q - 1], q)
                place = np.flatnonzero(near[spread(g, bits)])
                found = np.minimum(np.searchsorted(unique, g[place]), len(unique) - 1)
                fine = unique[found] == g[place]
                place, found = place[fine] + lo, found[fine]
                # lots of about HITS_AT_ONCE hits, whatever the number of items that share a piece
                ends = np.cumsum(count[found])
                total = int(ends[-1]) if len(ends) else 0
                for a in range(0, total, HITS_AT_ONCE):
                    hit = np.arange(a, min(total, a + HITS_AT_ONCE))
                    which = np.searchsorted(ends, hit, "right")
                    yield place[which], number[first[found[which]] + hit - (ends[which] - count[found[which]])], q

    def fit(self, c: np.ndarray, place: np.ndarray, piece: np.ndarray, q: int) -> np.ndarray:
        """Which hits have groups that all fit."""
        left = np.arange(len(place))
        for s in GROUPS:
            if not len(left):
                break
            x, k = place[left], piece[left]
            item = self.of[k]
            end = self.last[item]
            begin = end - self.allowed[item] - 1
            a = begin + (k - begin) // s * s
            b = np.minimum(a + s, end)
            # a group reaches to where the next one begins
            head = np.where(a == begin, 0, self.at[a])
            tail = np.where(b == end, self.size[item], self.at[np.minimum(b, len(self.at) - 1)])
            at, base = self.at[k], self.begin[item]
            before = extension(self.flat, base + at - 1, c, x - 1, at - head, -1, s - 1)
            fine = before <= b - a - 1
            after = np.zeros(len(left), np.uint8)
            after[fine] = extension(self.flat, (base + at)[fine], c, x[fine], (tail - at)[fine], 1, s - 1)
            left = left[fine & (before.astype(np.int64) + after <= b - a - 1)]
        return left

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end word, distance) of the runs that are close enough, the closest for each text and item, the first of equals."""
        out, lot, have = [], [], 0
        for t, text in enumerate(texts):
            if text:
                lot.append((t, normal(text)))
                have += len(text)
            if lot and (have >= CHARS_AT_ONCE or t == len(texts) - 1):
                out += self._search(lot)
                lot, have = [], 0
        return out + (self._search(lot) if lot else [])

    def _search(self, lot: list[tuple[int, str]]) -> list[tuple[int, int, int, int, int]]:
        sizes = np.array([len(t) + 1 for _, t in lot], np.int64)
        ends = np.cumsum(sizes)
        c = codes([t + "\n" for _, t in lot])
        # which item may begin about where
        spots = []
        for place, piece, q in self.seeds(c):
            fine = self.fit(c, place, piece, q)
            item = self.of[piece[fine]]
            spots.append(np.stack([np.searchsorted(ends, place[fine], "right"), item, place[fine] - self.at[piece[fine]]]))
        spots = np.unique(np.concatenate(spots, 1), axis=1).T.tolist() if spots else []
        runs: list[list[int]] = []
        for k, item, x in spots:
            x -= int(ends[k] - sizes[k])
            d, n = int(self.allowed[item]), int(self.size[item])
            lo, hi = max(0, x - d), min(len(lot[k][1]), x + n + d)
            if runs and runs[-1][:2] == [k, item] and lo <= runs[-1][3]:
                runs[-1][3] = max(hi, runs[-1][3])
            else:
                runs.append([k, item, lo, hi])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, item, lo, hi in runs:
            d, end = nearest_run(self.texts[item], lot[k][1][lo:hi])
            if d <= self.allowed[item] and ((k, item) not in best or d < best[k, item][0]):
                best[k, item] = d, lo, lo + end
        out = []
        for (k, item), (d, lo, end) in best.items():
            t, text = lot[k]
            start = end - nearest_run(self.texts[item][::-1], text[lo:end][::-1], True)[1]
            first, last = text.count(" ", 0, start + 1), text.count(" ", 0, end - 1) + 1
            out += [(t, i, first, last, d) for i in self.same[self.texts[item]]]
        return sorted(out)


def shards(items: DataFrame, chars: int = SHARD_CHARS) -> list[list[tuple[int, str]]]:
    """Items in shards of at most chars characters, or of one item. They come to the driver one after the other, not all at once."""
    out: list[list[tuple[int, str]]] = [[]]
    have = 0
    for row in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text").orderBy("item_id", "text").toLocalIterator():
        if out[-1] and have + len(row[1]) > chars:
            out.append([])
            have = 0
        out[-1].append((row[0], row[1]))
        have += len(row[1])
    return [x for x in out if x]


def find(docs: DataFrame, items: DataFrame, chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, distance, allowed): each document and item that it holds, with its closest run."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, first_word int, end_word int, distance int, allowed int"
    docs = docs.select("doc_id", "text")
    out = None
    for shard in shards(items, chars) or [[]]:
        shared = docs.sparkSession.sparkContext.broadcast(Index(shard))

        def run(batches, shared=shared):
            own = shared.value
            for part in slices(batches):
                rows = own.search(part.column(1).to_pylist())
                if rows:
                    t, i, a, b, d = map(np.array, zip(*rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array([own.items[k][0] for k in i], pa.int64()), *[pa.array(x.astype(np.int32)) for x in (a, b, d, own.most[i])]], names=["doc_id", "item_id", "first_word", "end_word", "distance", "allowed"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, and no shuffle."""
    at = docs.columns.index("text")
    for shard in shards(items, chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(shard))

        def run(batches, shared=shared):
            own = shared.value
            for part in slices(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[r[0] for r in own.search(part.column(at).to_pylist())]] = False
                if keep.any():
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
