from __future__ import annotations

import random

import numpy as np
import pytest

from docweave.llm import decontaminate, substring
from docweave.llm.common import WordHash, table

L, G = 12, 4


def corpus(seed, n=50, repeat=0.5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [words(rng.randrange(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = words(rng.choice((0, 3, 20, 80)))
        while rng.random() < repeat:
            p = rng.choice(shared)
            a = rng.randrange(len(p) - 14)
            w += p[a : a + rng.randrange(14, len(p) - a + 1)] + words(rng.randrange(10))
        rows.append((i, " ".join(w)))
    return rows


def windows(rows, k):
    """Where each run of k words stands, first to last."""
    out: dict = {}
    for i, t in sorted(rows):
        w = t.split()
        for a in range(len(w) - k + 1):
            out.setdefault(tuple(w[a : a + k]), []).append((i, a))
    return out


@pytest.mark.parametrize("seed, broadcast", [(1, 10**9), (2, 10**9), (1, 0), (2, 0), (3, 0)])
def test_spans_against_brute_force(spark, docs_of, monkeypatch, seed, broadcast):
    monkeypatch.setattr(substring, "BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(substring, "SHARD_WORDS", 400)
    rows = corpus(seed)
    removed = {r["doc"]: {k for s in r["spans"] for k in range(s["a"], s["b"])} for r in substring.spans(docs_of(rows), L, G).collect()}
    # every window of L words goes wherever it isn't first, and nothing else does
    gone: dict = {}
    for places in windows(rows, L).values():
        for i, a in places[1:]:
            gone.setdefault(i, set()).update(range(a, a + L))
    assert gone and removed == gone


def test_threshold(spark, docs_of):
    """A passage of LENGTH words goes where it isn't first, one of a word less stays, whatever stands around it."""
    rng = random.Random(7)
    own = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    rows, want = [], {}
    for n in range(substring.LENGTH - 6, substring.LENGTH + 8):
        for _ in range(4):
            p = own(n)
            for k in range(3):
                before = own(rng.randrange(12))
                if k and n >= substring.LENGTH:
                    want[len(rows)] = set(range(len(before), len(before) + n))
                rows.append((len(rows), " ".join(before + p + own(rng.randrange(12)))))
    got = {r["doc"]: {k for s in r["spans"] for k in range(s["a"], s["b"])} for r in substring.spans(docs_of(rows)).collect()}
    assert got == want


def test_filter_and_what_is_sent(spark, docs_of, monkeypatch):
    """Every repeated sample is in the filter, few others are, and no text goes through an exchange to find the windows that repeat."""
    monkeypatch.setattr(substring, "LOT", 500)
    rows = corpus(5)
    docs = docs_of(rows, 4).selectExpr("doc_id as _doc", "text")
    hashes, times = WordHash(), {}
    for _, t in rows:
        h, ends = substring._words([t], hashes)
        for x in windows_of(h, ends):
            times[x] = times.get(x, 0) + 1
    filter_ = substring._repeated(docs, L - G + 1, G)
    has = dict(zip(times, filter_.has(np.array(list(times), np.uint64))))
    assert all(has[x] for x, n in times.items() if n > 1) and any(n > 1 for n in times.values())
    assert sum(has[x] for x, n in times.items() if n == 1) < 0.05 * len(times)
    sent = []
    monkeypatch.setattr(substring, "joined", lambda big, *a: sent.append(big.columns))
    substring._copies(docs, L, G)
    assert not sent


def windows_of(h, ends):
    at = substring.sampled(h, ends, L - G + 1, G)
    return substring.windows(h, L - G + 1)[at].tolist() if len(at) else []


def test_dedup_edges(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(1, f"one {passage} end"), (2, f"two\n{passage}\nrest here"), (3, None), (4, ""), (5, "short"), (None, passage), (6, f"{passage} mid {passage}"), (7, passage), (7, passage)]
    docs = docs_of(rows).withColumnsRenamed({"source": "spans", "lang": "_doc"}).selectExpr("*", "1 as _hash", "2 as _spans", "3 as shard")
    out = substring.dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert got == sorted([(1, f"one {passage} end", len(passage) + 8), (2, "two\nrest here", 13), (3, None, None), (4, "", 0), (5, "short", 5), (0, passage, len(passage)), (6, "mid", 3), (7, "", 0), (7, "", 0)], key=str)
    assert substring.dedup(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup(docs, report=True).collect()}[6] == 160


def test_matching_statistics_against_brute_force():
    rng = random.Random(9)
    text = [rng.randrange(6) for _ in range(300)]
    own = substring.Automaton()
    own.add(1, 0, text)
    query = [rng.randrange(6) for _ in range(100)] + text[40:90] + [rng.randrange(6) for _ in range(50)] + text[200:240]
    covered = {k for a, b in own.repeats(2, query, 5) for k in range(a, b)}
    runs = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
    assert covered == {k for i in range(len(query) - 4) if tuple(query[i : i + 5]) in runs for k in range(i, i + 5)}


# decontamination


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30))) for _ in range(2))
        assert decontaminate.least_distance(a, b, 99) == slow_distance(a, b)


def hurt(rng, text, share, vocabulary):
    """text with single characters and words changed, up to an edit distance of share of its length."""
    budget, t = int(len(text) * share), text
    while budget > 0:
        i = rng.randrange(len(t))
        k = rng.random()
        if k < 0.35:
            t = t[:i] + rng.choice("abcdefgh") + t[i + 1 :]
            budget -= 1
        elif k < 0.7:
            t = t[:i] + t[i + 1 :] if rng.random() < 0.5 else t[:i] + rng.choice("abcdefgh") + t[i:]
            budget -= 1
        else:
            w = t.split(" ")
            j = rng.randrange(len(w))
            new = rng.choice(vocabulary)
            cost = max(len(new), len(w[j]))
            if cost > budget:
                budget -= 1
                continue
            budget -= cost
            w[j] = new
            t = " ".join(w)
    return t


def test_recall_and_precision(spark, docs_of):
    rng = random.Random(6)
    vocabulary = sorted({"".join(rng.choice(["an", "th", "er", "on", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 5))) for _ in range(800)})
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, words(rng.randrange(15, 60))) for i in range(60)]
    rows, true = [], set()
    for d in range(400):
        t = words(rng.randrange(5, 120))
        if d % 2:
            i, item = rng.choice(items)
            t = f"{t} {hurt(rng, item, rng.choice((0, 0.03, 0.08, 0.12)), vocabulary)} {words(rng.randrange(60))}"
        rows.append((d, t))
    for d, t in rows:
        low = decontaminate.normal(t)
        for i, item in items:
            if decontaminate.least_distance(decontaminate.normal(item), low, 10**6) <= int(len(decontaminate.normal(item)) * decontaminate.THETA):
                true.add((d, i))
    for chars in (32_000_000, 2000):  # one shard, and several
        found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs_of(rows), spark.createDataFrame(items, "item_id bigint, text string"), chars).collect()}
        assert found <= true and len(found & true) >= 0.95 * len(true) > 150


def held(rows, items):
    """(document, item) pairs by the edit distance of every pair."""
    out = set()
    for i, item in items:
        low = decontaminate.normal(item)
        out |= {(d, i) for d, t in rows if slow_distance(low, decontaminate.normal(t)) <= int(len(low) * decontaminate.THETA)}
    return out


def found(spark, docs_of, rows, items, chars=decontaminate.SHARD_CHARS):
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs_of(rows), spark.createDataFrame(items, "item_id bigint, text string"), chars).collect()}


def test_duplicated_and_templated_items(spark, docs_of):
    rng = random.Random(12)
    vocabulary = sorted({"".join(rng.choice("aeioubdfgklmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)})
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    copied, short = words(16), "three equal words"
    template = words(12).split()
    filled = [" ".join(template[:6] + [rng.choice(vocabulary)] + template[6:]) for _ in range(12)]
    items = list(enumerate([copied] * 15 + [short] * 2 + filled + [words(14) for _ in range(3)]))
    texts = [copied, hurt(rng, copied, 0.1, vocabulary), short, filled[0], hurt(rng, filled[3], 0.12, vocabulary), items[-1][1], words(10)]
    rows = [(d, f"{words(8)} {t} {words(8)}") for d, t in enumerate(texts)]
    true = held(rows, items)
    assert len(true) >= 15 * 2 + 2 + 12
    for chars in (decontaminate.SHARD_CHARS, 1000, 200, 1):
        assert found(spark, docs_of, rows, items, chars) == true


def test_edits_in_every_second_word(spark, docs_of):
    """No two words that stand together are left whole, and the distance is within THETA."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    items, rows = [], []
    for i, n in enumerate((3, 5, 8, 15, 25, 40, 60, 100)):
        w = words(n)
        items.append((i, " ".join(w)))
        for first in (0, 1):
            bad = [x[:2] + "z" + x[3:] if k % 2 == first else x for k, x in enumerate(w)]
            rows.append((2 * i + first, " ".join(words(20) + bad + words(20))))
    true = held(rows, items)
    assert len(true) == 16 and found(spark, docs_of, rows, items) == true


def test_long_insertions(spark, docs_of):
    """Words put into an item in one place, up to THETA of its characters."""
    rng = random.Random(22)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    item = words(100)
    rows = [(k, " ".join(words(30) + item[:at] + words(k) + item[at:] + words(30))) for k, at in zip(range(1, 17), (50, 30, 70, 50) * 4)]
    low = " ".join(item)
    true = {(d, 0) for d, t in rows if decontaminate.least_distance(low, t, 10**6) <= int(len(low) * decontaminate.THETA)}
    assert {(d, 0) for d in range(1, 15)} <= true and found(spark, docs_of, rows, [(0, low)]) == true


def test_scripts_without_spaces(spark, docs_of):
    rng = random.Random(23)
    run = lambda low, n: "".join(chr(low + rng.randrange(60)) for _ in range(n))
    items = [(0, run(0x4E00, 60)), (1, run(0x3041, 30)), (2, run(0x0E01, 80)), (3, run(0x20000, 40)), (4, run(0x4E00, 6)), (5, "two words"), (6, run(0x4E00, 2))]
    rows = [(d, run(0x4E80, 50) + t + run(0x4E80, 50)) for d, (_, t) in enumerate(items)]
    rows += [(10 + d, run(0x4E80, 9) + t[:7] + "x" + t[8:20] + t[21:] + run(0x4E80, 9)) for d, (_, t) in enumerate(items[:4])]
    true = held(rows, items[:5])
    assert len(true) >= 9 and found(spark, docs_of, rows, items) == true


def test_cgk_keys_meet():
    """Strings within the allowed distance share a key with probability 0.9 and more; unrelated ones seldom do."""
    rng = random.Random(8)
    vocabulary = ["an", "the", "other", "onthe", "reen", "hean", "ined"]
    index = decontaminate.Index([(i, " ".join(rng.choice(vocabulary) + str(rng.randrange(99)) for _ in range(30))) for i in range(40)])
    near = [hurt(rng, t, 0.1, vocabulary)[: index.embedding.size] for _, t in index.items]
    keys = index.embedding.keys(near, index.chars)
    assert (keys == index.keys).any(1).mean() >= 0.9
    assert (np.roll(keys, 1, 0) == index.keys).mean() < 0.2 * (keys == index.keys).mean()


def test_decontaminate_edges(spark, docs_of):
    item = "which of these many words would be the one that stands in both the tables of the test"
    items = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, ""), (5, "two words"), (None, item)], "item_id bigint, text string")
    docs = docs_of([(1, item), (1, item), (2, None), (3, ""), (4, f"{'filler text ' * 20000}{item}"), (5, "two words"), (None, item)]).withColumnRenamed("lang", "item_id")
    found = decontaminate.find(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found) == sorted([(0, 1), (0, 2)] + [(1, 1), (1, 2)] * 2 + [(4, 1), (4, 2)]) and all(r["distance"] == 0 for r in found)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert decontaminate.find(docs, items.limit(0)).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == 7
    assert decontaminate.find(docs.limit(0), items).count() == 0


def test_planted_benchmark_passages(spark):
    docs, items = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "benchmark"))
    held = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect()}
    texts = {r["item_id"]: decontaminate.normal(r["text"]) for r in items.collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if t in decontaminate.normal(r["text"])}
    assert exact and exact <= held
    assert len(WordHash().of(["a", "b"])) == 2
