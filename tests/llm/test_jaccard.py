from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from docweave.llm import jaccard


def grams(text, n=2):
    w = (text or "").lower().split()
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, t=jaccard.THRESHOLD):
    """The rows of find() and of pairs()."""
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(grams(text), set()).add(i)
    alone = sets.pop(frozenset(), set())
    keys = list(sets)
    root, links, pairs = {k: k for k in keys}, {k: len(sets[k]) - 1 for k in keys}, set()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(keys, 2):
        j = len(x & y) / len(x | y)
        if j >= t - 1e-12:
            a, b = sorted((min(sets[x]), min(sets[y])))
            pairs.add((a, b, round(j, 9)))
            links[x] += len(sets[y])
            links[y] += len(sets[x])
            root[top(x)] = top(y)
    least = {}
    for k in keys:
        least[top(k)] = min(least.get(top(k), 1 << 60), min(sets[k]))
    return sorted([(i, least[top(k)], len(sets[k]), links[k]) for k in keys for i in sets[k]] + [(i, i, 1, 0) for i in alone]), pairs


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = "this very line stands in a great many of all the documents here at once".split()
    rows = []
    for i in range(n):
        k = rng.random()
        if rows and k < 0.5:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(int(len(w) * rng.choice((0, 0.03, 0.1, 0.2)))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if w and rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "new")
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 5, 12, 19, 20, 21, 35, 60, 200)))]
        rows.append((i, " ".join(w + line * (rng.random() < 0.4))))
    return [*rows, (1000, None), (1001, ""), (None, rows[5][1]), (5, rows[5][1]), (1002, " ".join(vocabulary * 30)), (1003, " ".join(vocabulary * 30 + ["end"]))]


def found(docs):
    return sorted(map(tuple, jaccard.find(docs).collect())), set(map(tuple, jaccard.pairs(docs).collect()))


@pytest.mark.parametrize("frequent", [512, -1])
def test_find_is_exact(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(frequent)
    assert found(docs_of(rows)) == brute(rows)


def test_small_blocks(docs_of, monkeypatch):
    """Lists that are split, cells of few sets and many small parts."""
    for name, value in (("LONG", 6), ("BLOCK", 4), ("PART", 500), ("LOT", 300)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(3, 90)
    assert found(docs_of(rows)) == brute(rows)


def test_group_of_near_copies(docs_of):
    """Many texts that differ in a few words, and many equal ones."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(rng.randrange(1, 22)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words)) for i in range(100)]
    assert found(docs_of(rows)) == brute(rows)


def test_matrix_counts_like_pairs():
    """Counting the lists of a hub by matrices and pair by pair gives the same."""
    rng = np.random.default_rng(6)
    ids = np.unique(rng.integers(0, 1 << 60, 1300).astype(np.uint64))
    size = rng.integers(5, 60, len(ids))
    lists = [np.sort(rng.choice(len(ids), rng.integers(2, 90), False)) for _ in range(60)]
    flag, many = rng.integers(0, 2, 60).astype(np.uint8), np.array([len(x) for x in lists])
    at = np.concatenate(lists)
    quick = [np.concatenate(x) for x in zip(*jaccard._counted(flag, many, np.zeros(60, np.int64), ids[at], size[at], 0.55))]
    slow = [(np.minimum(ids[at][i], ids[at][j]), np.maximum(ids[at][i], ids[at][j]), np.ones(len(i), np.int64), jaccard.shares(size[at][i], size[at][j], 0.55), np.zeros(len(i), np.uint64)) for i, j in jaccard._pairs_of(np.repeat(2 * np.arange(60) + flag, many), ids[at], size[at], 0.55)]
    slow = jaccard._summed(*map(np.concatenate, zip(*slow)))
    assert len(slow[0]) and all((x == y).all() for x, y in zip(jaccard._summed(*quick, np.zeros(len(quick[0]), np.uint64)), slow))


@pytest.mark.parametrize("frequent", [0, 3, 1 << 40])
def test_partners_share_signatures(frequent):
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    counts = rng.integers(0, 9, len(pool))
    for _ in range(150):
        x = rng.choice(pool, rng.integers(1, 300), False)
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.6, 1))), False), rng.choice(pool, rng.integers(0, 1 + len(x) // 3), False)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if common / (len(x) + len(y) - common) < jaccard.THRESHOLD:
            continue
        sig, of = jaccard.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), counts[np.searchsorted(pool, np.concatenate([x, y]))], frequent, jaccard.THRESHOLD)
        both = np.intersect1d(sig[of == 0], sig[of == 1])
        small = min(len(x), len(y)) < jaccard.SMALL
        least = jaccard.shares(np.array([len(x)]), np.array([len(y)]), jaccard.THRESHOLD)[0]
        assert least >= (1 if small else jaccard.SHARED) and ((both & np.uint64(1)) == small).sum() >= least


def test_partners_of_any_size_share_signatures():
    """Sets that only combinations find, as small as partners may be, on both sides of every band."""
    rng = np.random.default_rng(8)
    t = jaccard.THRESHOLD
    pool = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = rng.integers(0, 9, len(pool))
    for n in (20, 21, 36, 37, 79, 80, 81, 145, 146, 319, 320, 581, 600, 1279, 1280, 2327, 2400, 5119, 5130):
        for m in {n, int(np.ceil(t * n)), int(0.8 * n)}:
            both = int(np.ceil(t / (1 + t) * (n + m) - 1e-9))
            x = rng.choice(len(pool), n + m - both, False)
            x, y = np.sort(x[:n]), np.sort(x[n - both :])
            of = np.concatenate([x, y])
            sig, owner = jaccard.signatures(pool[of], np.array([n, m]), counts[of], -1, t)
            shared = np.intersect1d(sig[owner == 0], sig[owner == 1])
            small = min(n, m) < jaccard.SMALL
            assert ((shared & np.uint64(1)) == small).sum() >= jaccard.shares(np.array([n]), np.array([m]), t)[0], (n, m)


def test_chance_pairs_stay_few():
    """Sets without partners that have many tokens in common by chance, each of which stands in 50 sets about."""
    rng = np.random.default_rng(5)
    n, size = 2500, 120
    pool = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64))
    tokens = np.concatenate([np.sort(rng.choice(pool, size, False)) for _ in range(n)])
    _, where, times = np.unique(tokens, return_inverse=True, return_counts=True)
    sig, of = jaccard.signatures(tokens, np.full(n, size), times[where], jaccard.FREQUENT, jaccard.THRESHOLD)
    lists = np.unique(sig, return_counts=True)[1].astype(float)
    assert len(sig) < 2 * n * size and (lists * (lists - 1) / 2).sum() < 100 * n


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == expected


def test_keep_one(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(7, text), (3, text + " more"), (9, text.upper()), (1, "alone here"), (2, None), (2, ""), (None, text), (7, text)]
    docs = docs_of(rows).withColumnsRenamed({"source": "_doc", "lang": "KEY"})
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"] is not None) == sorted([(3, text + " more"), (1, "alone here"), (2, ""), (0, text)])
    assert kept.where("text is null").count() == 1 and {r["_doc"] for r in kept.collect()} == {"src0"}
    empty = docs.limit(0)
    assert jaccard.keep_one(empty).count() == 0 and jaccard.find(empty).count() == 0


def test_partners_are_found_within_their_reach():
    """Of sets that partner, signatures enough are within the part of both prefixes that their sizes call for; those of sets that don't mostly aren't."""
    rng = np.random.default_rng(12)
    t = jaccard.THRESHOLD
    pool = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = rng.integers(0, 30, len(pool))
    kept = total = 0
    for frequent in (-1, 8, 15, 1 << 40):
        for n in (3, 12, 19, 20, 21, 36, 37, 80, 81, 146, 320, 581, 1280, 2400):
            for m in {n, int(np.ceil(t * n)), int(np.ceil(0.8 * n))}:
                for partners in (True, False):
                    both = int(np.ceil(t / (1 + t) * (n + m) - 1e-9)) if partners else m // 3
                    x = rng.choice(len(pool), n + m - both, False)
                    of = np.concatenate([np.sort(x[:n]), np.sort(x[n - both :])])
                    sig, owner, level = jaccard._signed(pool[of], np.array([n, m]), counts[of], frequent, t)
                    _, i, j = np.intersect1d(sig[owner == 0], sig[owner == 1], return_indices=True)
                    i, j = np.flatnonzero(owner == 0)[i], np.flatnonzero(owner == 1)[j]
                    fine = (sig[i] & np.uint64(1)) == (min(n, m) < jaccard.SMALL)
                    within = fine & jaccard._within(np.array(n), np.array(m), level[i], t) & jaccard._within(np.array(m), np.array(n), level[j], t)
                    if partners:
                        assert within.sum() >= jaccard.shares(np.array([n]), np.array([m]), t)[0], (frequent, n, m)
                    else:
                        kept, total = kept + within.sum(), total + fine.sum()
    assert kept < 0.6 * total
