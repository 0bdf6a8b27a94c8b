"""Operator 3: documents whose word n-gram sets have a Jaccard similarity of THRESHOLD at least.

A set's tokens, hashes of its n-grams, are ordered from rare to frequent. How often a token occurs is estimated from two count sketches of fixed
size over all documents, one of words and one of tokens: about as often as chance brings its words together, unless its own bucket says more. Any
order gives right results, a good one short lists. Tokens up to FREQUENT occurrences form a class that is indexed by single
tokens; the frequent ones fall into classes by hash, which are indexed by combinations of two tokens. A set of n tokens may
lack at most n - ceil(THRESHOLD * n) of a partner's, so its prefix is extended until the tokens of its classes, less one for each
class of pairs that it enters, outnumber that by SHARED: then partners share SHARED signatures at least. How many classes there are depends on the larger
set's band of sizes, so that a class holds a few tokens of a set; sets near the end of a band enter the next one too. Sets below SMALL tokens, which
may be too short for that, and all that could be partners of theirs, are indexed by plain prefixes as well.

Equal sets are one from the start, so copies cost no pairs. Signatures and lists travel in packed blocks. The lists of one group of near copies
mostly begin with one of a few sets, and meet there; lists of more than LONG sets are split into blocks of sets, each pair of blocks on its own.
Of two sets, their sizes say how many signatures they share at least if they are partners, and how far into the prefix of each: the signatures of tokens
more frequent than that make no candidates, though a partner of another size may need them. Candidates that share enough are verified on the whole sets, as
48-bit hashes of their n-grams, in cells of at most two blocks of BLOCK sets about. What leaves a cell grows with its sets, not with its pairs:
how many partners each has, and edges that connect them.

Edge cases: null and empty texts and texts without words have no partners; rows with a null doc_id are left out; a text of fewer words than an
n-gram is one token; words are compared in lower case; very long texts are compared whole. Rows with the same doc_id and text count once, and a doc_id with
several texts has a row for each set. An empty table gives an empty result. Ties don't arise: every pair at or above the threshold counts.
Only doc_id and text are read, whatever other columns are called; keep_one() passes all columns on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import WordHash, drop, fresh_name, joined, mix, slices, windows, written

N, THRESHOLD = 2, 0.55
#: Signatures that partners of SMALL tokens or more share.
SHARED, SMALL = 3, 20
#: Shared signatures that are asked for at most; more would only lead to more frequent tokens.
ENOUGH = 20
#: Steps in which the place of a signature in its set's prefix is told, rounded down.
LEVELS = 16
#: Occurrences beyond which a token is frequent. Single tokens of more would make lists that grow with the input, and pairs with its square.
FREQUENT = 8
#: Of a band of sizes, the largest by the smallest; each has its own number of classes of frequent tokens.
BAND = 4
SKETCH_BITS, CHUNKS = 20, 64
#: Signatures that one part of an exchange holds about, and that a task packs at once.
PART, LOT = 4_000_000, 2_000_000
#: Sets that a list holds before it is split, and sets of a block.
LONG, BLOCK = 1024, 512
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def word_bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Counts:
    """About how often tokens occur. Whole numbers all through, so that a token has one place in the order wherever it stands."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, n: int):
        self.log = np.rint(256 * np.log2(np.maximum(words, 1))).astype(np.int32)
        total = max(1.0, float(words.sum()))
        top = int(n * 256 * np.log2(total)) + n + 1
        self.chance = np.exp2(np.arange(top + 1) / 256 - (n - 1) * np.log2(total)).astype(np.float32)
        self.tokens, self.mean = tokens.astype(np.float32), np.float32(tokens.mean())

    def seen(self, tokens: np.ndarray, score: np.ndarray) -> np.ndarray:
        count = self.tokens[bucket(tokens)]
        return np.maximum(np.minimum(count, self.chance[score]), count - self.mean)


def token_sets(texts: list, hashes: WordHash, n: int = N, log: np.ndarray | None = None, sketch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(tokens, sizes, keys, score): the sorted distinct tokens of each text, one text after the other, a hash of each whole set, and with log the sum of it over the words of a token. Words are counted in sketch."""
    words = [(t or "").lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = hashes.of([w for x in words for w in x])
    if sketch is not None:
        sketch += np.bincount(word_bucket(flat), minlength=len(sketch))
    owner = np.repeat(np.arange(len(words)), lengths)
    grams = windows(flat, n)
    inside = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.zeros(0, bool)
    tokens, owners = grams[inside], owner[: len(grams)][inside]
    score = None
    if log is not None:
        own = log[word_bucket(flat)]
        score = sum(own[k : k + len(grams)] for k in range(n))[inside] if len(grams) else np.zeros(0, np.int32)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        starts = np.cumsum(lengths) - lengths
        with np.errstate(over="ignore"):
            own = np.array([mix(flat[starts[i] : starts[i] + lengths[i]] * _A).sum(dtype=np.uint64) for i in short], np.uint64)
        tokens, owners = np.concatenate([tokens, own]), np.concatenate([owners, short])
        score = None if score is None else np.concatenate([score, np.zeros(len(short), np.int32)])
    order = np.lexsort((tokens, owners))
    tokens, owners = tokens[order], owners[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[first], owners[first]
    score = None if score is None else score[order][first]
    sizes = np.bincount(owners, minlength=len(words))
    keys = np.zeros(len(words), np.uint64)
    if len(tokens):
        some = np.flatnonzero(sizes)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(tokens * _B + np.uint64(1)), (np.cumsum(sizes) - sizes)[some])
            keys[some] = mix(total + sizes[some].astype(np.uint64) * _A)
    return tokens, sizes, keys, score


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def need(n: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens of a set of n that a partner has at least."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def shares(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Signatures that partners of n and m tokens share at least.

    Of a set's n - need(n) + SHARED signatures, at most as many are missing in the partner as tokens; those are n less what both have in common.
    """
    common = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)
    least = common - np.maximum(need(n, threshold), need(m, threshold)) + np.where(np.minimum(n, m) < SMALL, 1, SHARED)
    return np.clip(least, 1, ENOUGH)


def _within(n: np.ndarray, m: np.ndarray, level: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a signature of a set of n may be one of those by which a partner of m is found.

    Up to the last of the first so many signatures that partners share, a set has those and at most one more for each token that the partner lacks.
    """
    common = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)
    place = -(-level.astype(np.int64) * (n - need(n, threshold) + SHARED) // LEVELS)
    return place < n - common + shares(n, m, threshold)


def _schemes(low: int, high: int, threshold: float) -> list[tuple[int, int, int]]:
    """(from, to, classes): for the bands of sizes that sets of low to high tokens enter, which sets enter each, and its classes of frequent tokens.

    A pair meets in the band of its larger set, which sets down to threshold of the band's least size enter too. As many classes
    leave the smallest of them tokens enough.
    """
    out, least = [], SMALL
    while threshold * least <= high + 1e-9:
        first = max(SMALL, int(np.ceil(threshold * least - 1e-9)))
        if low < least * BAND:
            out.append((first, least * BAND, max(1, int(need(np.array(first), threshold)) - SHARED)))
        least *= BAND
    return out


def signatures(tokens: np.ndarray, sizes: np.ndarray, seen: np.ndarray, frequent: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) for sets that follow one another, with how often each token occurs; the lowest bit tells plain prefixes from the others."""
    return _signed(tokens, sizes, seen, frequent, threshold)[:2]


def _signed(tokens: np.ndarray, sizes: np.ndarray, seen: np.ndarray, frequent: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """signatures(), and the level of each: how many the set is sure to have before it, as LEVELS steps of its prefix."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, seen, owner))
    tokens, seen = tokens[order], seen[order]
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - starts[owner]
    spare = sizes - need(sizes, threshold)
    one = np.uint64(1)
    largest = int(np.floor((SMALL - 1) / threshold + 1e-9))
    plain = (sizes[owner] <= largest) & (place <= spare[owner])
    main = sizes >= SMALL
    single = main[owner] & (place < (spare + SHARED)[owner]) & (seen <= frequent)
    sigs = [mix(tokens[plain]) | one, mix(tokens[single]) & ~one]
    owners, places = [owner[plain], owner[single]], [place[plain], place[single]]

    def done():
        of, before = np.concatenate(owners), np.concatenate(places)
        return np.concatenate(sigs), of, (before * LEVELS // (spare + SHARED)[of]).astype(np.uint8)

    rare = np.bincount(owner[seen <= frequent], minlength=len(sizes))
    short = main & (rare < spare + SHARED)  # of single tokens
    if not short.any():
        return done()
    for first, end, classes in _schemes(int(sizes[short].min()), int(sizes[short].max()), threshold):
        own = np.flatnonzero(short & (sizes >= first) & (sizes < end))
        many = (sizes - rare)[own]
        at, of = _ragged((starts + rare)[own], many), np.repeat(own, many)
        kind = ((tokens[at] >> np.uint64(8)) % np.uint64(classes)).astype(np.int64)
        by = np.lexsort((kind, of))  # stable: by place within a class
        gain = np.zeros(len(at), np.int64)
        gain[by[1:]] = (kind[by][1:] == kind[by][:-1]) & (of[by][1:] == of[by][:-1])
        gained = np.cumsum(gain) - gain
        gained -= np.repeat(gained[np.cumsum(many) - many], many)  # of the set's tokens before this one
        by = by[(gained < (spare + SHARED - rare)[of])[by]]
        if not len(by):
            continue
        head = np.concatenate([[True], (kind[by][1:] != kind[by][:-1]) | (of[by][1:] != of[by][:-1])])
        begin = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
        before = np.arange(len(by)) - begin
        x, y = tokens[at[by]][_ragged(begin, before)], np.repeat(tokens[at[by]], before)
        with np.errstate(over="ignore"):
            sigs.append(mix(x * _A + mix(y * _B) + np.uint64(classes)) & ~one)
        owners.append(np.repeat(of[by], before))
        places.append(np.repeat((gained + rare[of])[by], before))
    return done()


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """(chunk, doc, key, n, counts): a row for each document, with its set, and the parts of each task's sketches of tokens and of words."""

    def run(batches):
        hashes, total, words, held, have = WordHash(), np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for part in slices(batches):
            tokens, sizes, keys, _ = token_sets(part.column(1).to_pylist(), hashes, n, sketch=words)
            held.append(bucket(tokens))
            have += len(tokens)
            if have > 2_000_000:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, have = [], 0
            rows = part.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), part.column(0), pa.array(keys.view(np.int64), mask=sizes == 0), pa.array(sizes.astype(np.int32)), pa.nulls(rows, pa.binary())], names=["chunk", "doc", "key", "n", "counts"])
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        if total.any():
            packed = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in (*np.split(total, CHUNKS), *np.split(words, CHUNKS))]
            none = pa.nulls(2 * CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * CHUNKS, dtype=np.int32)), none, none, pa.nulls(2 * CHUNKS, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "doc", "key", "n", "counts"])

    return docs.mapInArrow(run, "chunk int, doc bigint, key bigint, n int, counts binary")


def _counts(survey: DataFrame, n: int) -> Counts:
    """The sketches of all tasks, added up on the executors; 2 * 2**SKETCH_BITS numbers come to the driver at any size of the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for part in slices(batches, 64):
            for chunk, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        for chunk, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = survey.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    size = (1 << SKETCH_BITS) // CHUNKS
    out = np.zeros(2 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["counts"], "<u4")
    return Counts(out[1 << SKETCH_BITS :], out[: 1 << SKETCH_BITS], n)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers byte plane by byte plane, so that small numbers cost little."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns)
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return squeeze.compress(raw) + squeeze.flush()


def _columns(packed: bytes, *shapes: tuple[int, str]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zlib.decompress(packed, -15), np.uint8), 0, []
    for n, kind in shapes:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _narrow(k: int) -> str:
    return "<u2" if k <= 1 << 16 else "<u4"


def _parts_of(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, rest) of hashes: both grow with the hash."""
    with np.errstate(over="ignore"):
        x = (h >> np.uint64(32)) * np.uint64(parts) + ((h & _LOW) * np.uint64(parts) >> np.uint64(32))
    return (x >> np.uint64(32)).astype(np.int64), (x & _LOW).astype(np.uint32)


_BLOCKS = "part int, n int, k int, m int, body binary, ids binary"


def _block(rows: list[tuple]) -> pa.RecordBatch:
    part, n, k, m, body, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in (part, n, k, m)], pa.array(body, pa.binary()), pa.array(ids, pa.binary())], names=["part", "n", "k", "m", "body", "ids"])


def _by_part(batches):
    """Yields the rows of each part that this task has, in the order of parts."""
    now, held = None, []
    for batch in slices(batches, 64):
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if row[0] != now and held:
                yield held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield held


def _pack_signatures(sig: np.ndarray, of: np.ndarray, level: np.ndarray, keys: np.ndarray, sizes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blocks of signatures, each with the keys and sizes of its sets once."""
    order = np.argsort(sig)
    sig, of, level = sig[order], of[order], level[order]
    part, rest = _parts_of(sig, parts)
    rest = rest & ~np.uint32(1) | (sig & np.uint64(1)).astype(np.uint32)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own, which = np.unique(of[a:b], return_inverse=True)
        step = np.diff(rest[a:b], prepend=np.uint32(0))
        rows.append((int(part[a]), b - a, len(own), 0, _planes(step, which.astype(_narrow(len(own))), level[a:b], sizes[own].astype("<u4")), keys[own].astype("<u8").tobytes()))
    return _block(rows)


def _pack_lists(hub: np.ndarray, flag: np.ndarray, many: np.ndarray, left: np.ndarray, key: np.ndarray, size: np.ndarray, level: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blocks of lists: a hub, a flag, how many sets, how many of them on the left, and the sets."""
    starts = np.cumsum(many) - many
    part, _ = _parts_of(mix(hub), parts)
    order = np.lexsort((hub, part))
    edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = order[a:b]
        at = _ragged(starts[own], many[own])
        heads, which_hub = np.unique(hub[own], return_inverse=True)
        ids, first, which = np.unique(key[at], return_index=True, return_inverse=True)
        body = _planes(which_hub.astype("<u4"), flag[own].astype("u1"), many[own].astype("<u4"), left[own].astype("<u4"), np.array([len(heads)], "<u4"), which.astype(_narrow(len(ids))), level[at], size[at][first].astype("<u4"))
        rows.append((int(part[order[a]]), b - a, len(ids), len(at), body, np.concatenate([ids, heads]).astype("<u8").tobytes()))
    return _block(rows)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _unpack_lists(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    out = []
    for n, k, m, body, ids in rows:
        both = np.frombuffer(ids, "<u8")
        which_hub, flag, many, left, _, which, level, sizes = _columns(body, (n, "<u4"), (n, "u1"), (n, "<u4"), (n, "<u4"), (1, "<u4"), (m, _narrow(k)), (m, "u1"), (k, "<u4"))
        out.append((both[k:][which_hub], flag, many.astype(np.int64), left.astype(np.int64), both[:k][which], sizes[which].astype(np.int64), level))
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists_of(rows: list[tuple], threshold: float) -> tuple[np.ndarray, ...] | None:
    """(plain, sets, keys, sizes, levels) of each signature of a part that several sets have; the sets of one by key."""
    sig, key, size, level = [], [], [], []
    for n, k, _, body, ids in rows:
        step, which, levels, sizes = _columns(body, (n, "<u4"), (n, _narrow(k)), (n, "u1"), (k, "<u4"))
        level.append(levels)
        sig.append(np.cumsum(step, dtype=np.uint32))
        key.append(np.frombuffer(ids, "<u8")[which])
        size.append(sizes[which])
    sig, key, size, level = (np.concatenate(x) for x in (sig, key, size, level))
    order = np.argsort(sig)
    same = sig[order][1:] == sig[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    order = order[np.lexsort((level[order], key[order], sig[order]))]
    sig, key, size, level = sig[order], key[order], size[order], level[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key, size, level = sig[fresh], key[fresh], size[fresh], level[fresh]
    # a set whose size fits no other of its list has no partner there
    order = np.lexsort((size, sig))
    fits = np.zeros(len(sig), bool)
    near = (sig[order][1:] == sig[order][:-1]) & (size[order][:-1] >= need(size[order][1:], threshold))
    fits[order[1:][near]] = fits[order[:-1][near]] = True
    sig, key, size, level = sig[fits], key[fits], size[fits], level[fits]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(sig)))
    keep = many > 1
    two = first[many == 2]
    n, m = size[two].astype(np.int64), size[two + 1].astype(np.int64)
    keep[many == 2] = _within(n, m, level[two], threshold) & _within(m, n, level[two + 1], threshold)
    if not keep.any():
        return None
    at = _ragged(first[keep], many[keep])
    return (sig[first[keep]] & 1).astype(np.uint8), many[keep], key[at], size[at], level[at]


def _split(plain: np.ndarray, many: np.ndarray, key: np.ndarray, size: np.ndarray, level: np.ndarray, long: int) -> tuple[np.ndarray, ...]:
    """(hub, plain, sets, left, keys, sizes, levels): long lists as the pairs of their blocks; left is how many sets of a list stand on its left side, 0 where all are paired with all."""
    starts = np.cumsum(many) - many
    short = np.flatnonzero(many <= long)
    out = [(key[starts[short]], plain[short], many[short], np.zeros(len(short), np.int64), key[at := _ragged(starts[short], many[short])], size[at], level[at])]
    for i in np.flatnonzero(many > long).tolist():
        own, sizes, levels = (x[starts[i] : starts[i] + many[i]] for x in (key, size, level))
        blocks = 1 << int(np.ceil(np.log2(many[i] / (long // 2))))
        kind = (mix(own) % np.uint64(blocks)).astype(np.int64)
        groups = [np.flatnonzero(kind == b) for b in range(blocks)]
        for a in range(blocks):
            for b in range(a, blocks):
                both = groups[a] if a == b else np.concatenate([groups[a], groups[b]])
                if len(both) > 1 and (a == b or len(groups[a]) and len(groups[b])):
                    with np.errstate(over="ignore"):
                        hub = mix(own[:1] + np.uint64(blocks) * _A + np.uint64(a) * _B + mix(np.array([b + 1], np.uint64)))
                    out.append((hub, plain[i : i + 1], np.array([len(both)]), np.array([0 if a == b else len(groups[a])]), own[both], sizes[both], levels[both]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pairs_of(sig: np.ndarray, key: np.ndarray, n: np.ndarray, threshold: float, level: np.ndarray | None = None):
    """Yields (i, j) of the rows of sorted signature lists that may be partners by size, and by the level of the signature in both."""
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))

    def fine(i, j):
        lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (lo >= need(hi, threshold)) & (((sig[i] & 1) == 0) | (lo < SMALL))
        i, j = i[ok], j[ok]
        if level is not None:
            ok = _within(n[i], n[j], level[i], threshold) & _within(n[j], n[i], level[j], threshold)
            i, j = i[ok], j[ok]
        return i, j

    for m in np.unique(size[size > 1]).tolist():
        at = first[size == m]
        if m <= 64:
            a, b = np.triu_indices(m, 1)
            step = max(1, 1_000_000 // len(a))
            for k in range(0, len(at), step):
                base = at[k : k + step, None]
                yield fine((base + a).ravel(), (base + b).ravel())
        else:
            step = max(1, 1_000_000 // m)
            for base in at.tolist():
                for lo in range(0, m, step):
                    a, b = np.meshgrid(np.arange(lo, min(m, lo + step)), np.arange(m), indexing="ij")
                    upper = b > a
                    yield fine(base + a[upper], base + b[upper])


def _counted(flag: np.ndarray, many: np.ndarray, left: np.ndarray, key: np.ndarray, size: np.ndarray, threshold: float, block: int = BLOCK):
    """Yields (a, b, times, least) for the lists of one hub, all pairs of sets at once, by matrix products over blocks of sets."""
    ids, first, which = np.unique(key, return_index=True, return_inverse=True)
    n = size[first]
    of = np.repeat(np.arange(len(many)), many)
    cross = left > 0  # of one hub all or none
    on_left = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many) < left[of] if cross.any() else None
    for lo in range(0, len(ids), block):
        hi = min(len(ids), lo + block)
        for lo2 in range(lo, len(ids), 2 * block):
            hi2 = min(len(ids), lo2 + 2 * block)
            times = np.zeros((2, hi - lo, hi2 - lo2), np.float32)
            for plain in (0, 1):
                lists = np.flatnonzero(flag == plain)
                for s in range(0, len(lists), 2048):
                    place = np.full(len(many), -1)
                    place[lists[s : s + 2048]] = np.arange(len(lists[s : s + 2048]))
                    row = place[of]
                    x = np.zeros((min(2048, len(lists) - s), hi - lo), np.float32)
                    y = np.zeros((len(x), hi2 - lo2), np.float32)
                    one, two = (row >= 0) & (which >= lo) & (which < hi), (row >= 0) & (which >= lo2) & (which < hi2)
                    if on_left is None:
                        x[row[one], which[one] - lo] = 1
                        y[row[two], which[two] - lo2] = 1
                        times[plain] += x.T @ y
                    else:
                        for mine, other in ((on_left, ~on_left), (~on_left, on_left)):
                            x[:], y[:] = 0, 0
                            x[row[one & mine], which[one & mine] - lo] = 1
                            y[row[two & other], which[two & other] - lo2] = 1
                            times[plain] += x.T @ y
            low, high = np.minimum(n[lo:hi, None], n[None, lo2:hi2]), np.maximum(n[lo:hi, None], n[None, lo2:hi2])
            total = times[0] + np.where(low < SMALL, times[1], 0)
            i, j = np.nonzero((total > 0) & (low >= need(high, threshold)) & (np.arange(lo, hi)[:, None] < np.arange(lo2, hi2)[None, :]))
            if len(i):
                yield ids[lo + i], ids[lo2 + j], total[i, j].astype(np.int64), shares(n[lo + i], n[lo2 + j], threshold)


def _candidates(docs: DataFrame, counts: Counts, total: int, n: int, threshold: float) -> DataFrame:
    """(cell, a, b): keys, a < b, of sets that share enough signatures, by the cells in which they are verified; b is null for the sets of a cell. total: tokens of all sets."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    parts = max(8, -(-total // (2 * PART)))
    fewer = max(8, parts // 2)  # lists and pairs are fewer than signatures, and blocks of many name their sets more cheaply

    def sign(batches):
        hashes, done = WordHash(), set()
        held: list[tuple] = []
        have = sets = 0

        def close():
            nonlocal held, have, sets
            sig, of, level, keys, sizes = (np.concatenate(x) for x in zip(*held))
            held, have, sets = [], 0, 0
            return _pack_signatures(sig, of, level, keys, sizes, parts)

        for part in slices(batches):
            tokens, sizes, keys, score = token_sets(part.column(1).to_pylist(), hashes, n, shared.value.log)
            new = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):  # a set that this task has signed already needn't be again
                if sizes[i] and k not in done:
                    done.add(k)
                    new[i] = True
            if len(done) > 1_000_000:
                done.clear()
            if new.any():
                own = np.repeat(new, sizes)
                tokens, score, sizes, keys = tokens[own], score[own], sizes[new], keys[new]
                sig, of, level = _signed(tokens, sizes, shared.value.seen(tokens, score), FREQUENT, threshold)
                held.append((sig, of + sets, level, keys, sizes))
                have += len(sig)
                sets += len(keys)
                if have > LOT:
                    yield close()
        if held:
            yield close()

    def lists(batches):
        held: list[tuple] = []
        have = 0
        for rows in _by_part(batches):
            found = _lists_of(rows, threshold)
            if found:
                held.append(_split(*found, LONG))
                have += len(held[-1][4])
                if have > LOT // 2:
                    yield _pack_lists(*map(np.concatenate, zip(*held)), fewer)
                    held, have = [], 0
        if held:
            yield _pack_lists(*map(np.concatenate, zip(*held)), fewer)

    def pair(batches):
        held: list[tuple] = []
        have = 0

        def close():
            nonlocal held, have
            a, b, times, least, hub = _summed(*map(np.concatenate, zip(*held)))
            held, have = [], 0
            part, _ = _parts_of(mix(a), fewer)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]]))
            rows = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = order[lo:hi]
                ids, first, runs = np.unique(a[own], return_index=True, return_counts=True)  # a grows within a part
                hubs = np.minimum.reduceat(hub[own], first)
                far = hubs != ids  # a list's hub is mostly its first set
                names, which = np.unique(b[own], return_inverse=True)
                few = 10 * len(names) < 8 * len(own)
                body = _planes(runs.astype("<u4"), far.astype("u1"), np.minimum(times[own], 255).astype("u1"), least[own].astype("u1"), *([which.astype(_narrow(len(names)))] if few else []))
                rows.append((int(part[own[0]]), hi - lo, len(ids), len(names) if few else 0, body, np.concatenate([ids, hubs[far], names if few else b[own]]).astype("<u8").tobytes()))
            return _block(rows)

        for rows in _by_part(batches):
            hub, flag, many, left, key, size, level = _unpack_lists(rows)
            starts = np.cumsum(many) - many
            order = np.argsort(hub, kind="stable")
            hub, flag, many, left = hub[order], flag[order], many[order], left[order]
            at = _ragged(starts[order], many)
            key, size, level = key[at], size[at], level[at]
            starts = np.cumsum(many) - many
            heads = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
            tails = np.append(heads[1:], len(hub))
            work = np.add.reduceat(many * many, heads)
            dense = (work > 20_000) | (np.maximum.reduceat(left, heads) > 0)
            scattered = np.repeat(~dense, tails - heads)
            rest = np.flatnonzero(scattered)
            for h in np.flatnonzero(dense).tolist():
                s, e = int(heads[h]), int(tails[h])
                lo, hi = int(starts[s]), int(starts[e - 1] + many[e - 1])
                if left[s] == 0 and (e - s) * float(len(np.unique(key[lo:hi]))) ** 2 > 500 * float(work[h]):
                    rest = np.concatenate([rest, np.arange(s, e)])
                    continue
                for found in _counted(flag[s:e], many[s:e], left[s:e], key[lo:hi], size[lo:hi], threshold, BLOCK):
                    held.append((*found, np.full(len(found[0]), hub[s])))
                    have += len(found[0])
                if have > LOT:
                    yield close()
            if len(rest):
                at = _ragged(starts[rest], many[rest])
                sig = np.repeat(2 * np.arange(len(rest)) + flag[rest], many[rest])
                k, z, h = key[at], size[at], np.repeat(hub[rest], many[rest])
                for i, j in _pairs_of(sig, k, z, threshold, level[at]):
                    if len(i):
                        held.append((np.minimum(k[i], k[j]), np.maximum(k[i], k[j]), np.ones(len(i), np.int64), shares(z[i], z[j], threshold), h[i]))
                        have += len(i)
                        if have > LOT:
                            yield close()
        if held:
            yield close()

    def count(batches):
        def emit(cell, a, b):
            for k in range(0, len(a), 100_000):
                x, y = a[k : k + 100_000].view(np.int64), pa.nulls(len(a[k : k + 100_000]), pa.int64()) if b is None else pa.array(b[k : k + 100_000].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + 100_000].view(np.int64)), pa.array(x), y], names=["cell", "a", "b"])

        for rows in _by_part(batches):
            held = []
            for n_, k, m, body, ids in rows:
                runs, far, times, least, *which = _columns(body, (k, "<u4"), (k, "u1"), (n_, "u1"), (n_, "u1"), *[(n_, _narrow(m))] * (m > 0))
                a, hubs, b = np.split(np.frombuffer(ids, "<u8"), [k, k + int(far.sum())])
                hub = a.copy()
                hub[far > 0] = hubs
                held.append((np.repeat(a, runs), b[which[0]] if which else b, times.astype(np.int64), least.astype(np.int64), np.repeat(hub, runs)))
            a, b, times, least, hub = _summed(*map(np.concatenate, zip(*held)))
            keep = times >= least
            if not keep.any():
                continue
            a, b, hub = a[keep], b[keep], hub[keep]
            # the pairs of one set go where most of its group's do, and by blocks if they are many
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            many = np.diff(np.append(first, len(a)))
            hub = np.repeat(np.minimum.reduceat(hub, first), many)
            blocks = np.repeat(1 << np.ceil(np.log2(np.maximum(many / BLOCK, 1))).astype(np.int64), many).astype(np.uint64)
            with np.errstate(over="ignore"):
                x, y = mix(a * _A) % blocks, mix(b * _A) % blocks
                cell = mix(hub + blocks * _A + np.minimum(x, y) * _B + mix(np.maximum(x, y) + np.uint64(1)))
            yield from emit(cell, a, b)
            both, sets = np.concatenate([cell, cell]), np.concatenate([a, b])
            order = np.lexsort((sets, both))
            both, sets = both[order], sets[order]
            new = np.concatenate([[True], (both[1:] != both[:-1]) | (sets[1:] != sets[:-1])])
            yield from emit(both[new], sets[new], None)

    blocks = docs.select("_doc", "text").mapInArrow(sign, _BLOCKS)
    for step, schema in ((lists, _BLOCKS), (pair, _BLOCKS), (count, "cell bigint, a bigint, b bigint")):
        blocks = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(step, schema)
    return blocks


def _summed(a: np.ndarray, b: np.ndarray, times: np.ndarray, least: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(times[order], first), np.maximum.reduceat(least[order], first), np.minimum.reduceat(hub[order], first)


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("_doc"), "text").where("_doc is not null")


def _verified(docs: DataFrame, n: int, threshold: float, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n) of all documents, and (a, b, x) of sets: with pairs each with its similarity, else edges that connect them (b is a key) and of each set how many documents its partners have (b is null)."""
    base = _base(docs)
    survey = written(_survey(base, n), "survey")
    counts = _counts(survey, n)
    sets = written(survey.where("chunk is null").select("doc", "key", "n"), "sets")
    drop(survey)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = written(_candidates(base, counts, total, n, threshold), "candidates")
    members = placed.where("b is null").groupBy(F.col("a").alias("key")).agg(F.collect_set("cell").alias("cells"))
    known = sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("_doc"), F.countDistinct("doc").alias("copies"))
    source = written(members.join(known, "key"), "sources")
    rows, cells = source.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()

    def cut(batches):
        hashes = WordHash()
        for part in slices(batches):
            tokens, sizes, keys, _ = token_sets(part.column(0).to_pylist(), hashes, n)
            ends = np.cumsum(sizes)
            cell, key, copies, packed = [], [], [], []
            for i, (wanted, cells_, many) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))):
                own = int(keys[i].astype(np.int64))
                if own == wanted:  # a doc_id may stand for several texts
                    raw = np.ascontiguousarray(tokens[ends[i] - sizes[i] : ends[i]].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    for c in cells_:
                        cell.append(c), key.append(own), copies.append(many), packed.append(raw)
            if cell:
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(key, pa.int64()), pa.nulls(len(cell), pa.int64()), pa.array(copies, pa.int64()), pa.array(packed, pa.binary())], names=["cell", "a", "b", "copies", "tokens"])

    def verify(batches):
        now, held, root, links = None, {}, {}, {}

        def find_root(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def emit(rows):
            a, b, x = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.float64())], names=["a", "b", "x"])

        for part in slices(batches, 1024):
            out = []
            for cell, a, b, copies, tokens in zip(*(part.column(i).to_pylist() for i in range(5))):
                if cell != now:
                    out += [(k, None, float(v)) for k, v in links.items()]
                    now, held, root, links = cell, {}, {}, {}
                if b is None:
                    if a not in held:
                        wide = np.zeros((len(tokens) // 6, 8), np.uint8)
                        wide[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
                        held[a] = wide.view(">u8").ravel().astype(np.uint64), copies
                        root[a] = a
                    continue
                (x, nx), (y, ny) = held[a], held[b]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if common / (whole := len(x) + len(y) - common) >= threshold - 1e-12:
                    if pairs:
                        out.append((a, b, common / whole))
                        continue
                    links[a], links[b] = links.get(a, 0) + ny, links.get(b, 0) + nx
                    if (p := find_root(a)) != (q := find_root(b)):
                        root[max(p, q)] = min(p, q)
                        out.append((a, b, None))
            if out:
                yield emit(out)
        if links:
            yield emit([(k, None, float(v)) for k, v in links.items()])

    texts = joined(base, source, 96 * rows + 8 * cells, "_doc", "inner").select("text", "key", "cells", "copies").mapInArrow(cut, "cell bigint, a bigint, b bigint, copies bigint, tokens binary")
    wanted = placed.where("b is not null").select("cell", "a", "b", F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("binary").alias("tokens"))
    found = written(texts.union(wanted).repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first()).mapInArrow(verify, "a bigint, b bigint, x double"), "links")
    drop(placed, source)
    return sets, found


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): each pair of different sets, by their least doc_ids, doc_a < doc_b."""
    sets, found = _verified(docs, n, threshold, True)
    least = sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"))
    named = found.join(least.toDF("a", "x_doc"), "a").join(least.toDF("b", "y_doc"), "b")
    return named.select(F.least("x_doc", "y_doc").alias("doc_a"), F.greatest("x_doc", "y_doc").alias("doc_b"), F.round("x", 9).alias("jaccard"))


def _classes(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, root): the sets that partners connect, by their least key; sets without partners have no row."""
    return components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")


def find(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links): a row for each document and set.

    class_id is the least doc_id of the documents that pairs connect with it, n_copies how many documents have its set, itself included, and n_links
    how many other documents are at or above the threshold, copies included. The result grows with the documents, not with the pairs.
    """
    sets, found = _verified(docs, n, threshold, False)
    own = sets.where("key is not null").select("doc", "key").distinct()
    known = own.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n_copies"))
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("x").cast("bigint").alias("links"))
    known = known.join(links, "key", "left").join(_classes(sets, found), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = written(known.join(least, "root").select("key", "class_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    alone = sets.where("key is null").select("doc").distinct()
    out = own.join(known, "key").select(F.col("doc").alias("doc_id"), "class_id", "n_copies", "n_links")
    return out.unionByName(alone.select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) is connected with. Alternates large and small stars; every round is a written table, and the one before it goes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = e.join(least, "u")
        if large:
            return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        return out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(out.select("u", "m")).where("a <> b").distinct()

    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        before, now = now, written(star(star(now, True), False), "edges")
        drop(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    rest = now.select("a", "b").distinct()
    return rest.select(F.col("a").alias("node"), F.col("b").alias("root")).union(rest.select("b", "b").distinct())


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group of documents that pairs connect. Rows without a set stay, and so do all rows of a doc_id that stays."""
    sets, found = _verified(docs, n, threshold, False)
    own = sets.where("key is not null").select("doc", "key").distinct()
    of = own.join(_classes(sets, found), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("many")).where("many > 1")
    helper = fresh_name(docs, "doc")
    gone = written(of.join(least, "root").where("doc <> least").select(F.col("doc").alias(helper)).distinct(), "gone")
    drop(found, sets)
    names = docs.columns
    marked = docs.withColumn(helper, F.col("doc_id").cast("bigint"))
    return joined(marked, gone, 64 * gone.count(), helper, "left_anti").select(*[f"`{x}`" for x in names])
