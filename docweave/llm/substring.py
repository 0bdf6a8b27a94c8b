"""Operator 5: substring dedup with suffix automata of reference shards.

Words are runs of non-space characters. A window of LENGTH words that occurs more than once, in any documents or places, stays only where it
occurs first, by (doc_id, place); what goes of a document is the union of its other windows, as maximal spans, and nothing else goes.

Candidates are found by samples: of every GAP consecutive windows of LENGTH - GAP + 1 words, the one with the least hash is sampled, so each window of LENGTH
words holds a sampled one. Around the samples that occur more than once, the windows of LENGTH words are compared, and the first occurrences of
those that repeat are the reference text. It is split into shards
of bounded size, kept together by the earliest document they lead to, and every shard becomes a suffix automaton over words whose
states know their earliest end. Documents that repeat a window of a shard stream through its automaton: where the matching
statistics reach LENGTH and the window's earliest occurrence is not here, it goes.

Only hashes of samples are exchanged, in packed blocks; those that repeat become a filter of at most 2 ** (PART_BITS + CHUNK_BITS) bits, which is broadcast, and documents are
read again with it, so that no text moves. A sample that the filter takes for a repeated one costs a comparison of its windows, and changes nothing else. The windows
around repeated samples are read in order, a batch at a time, however many documents share one.
All automata are broadcast if the reference text is at most BROADCAST_WORDS words; else documents are sent to the shards that
they share a window with. No shard and no task holds more than SHARD_WORDS words of reference.

Edge cases: a null text stays null; an empty text stays as it is; an empty table stays empty; very long texts are streamed whole; repeated rows with one doc_id
leave each other alone, for their passages stand at one place; passages that repeat within a document lose their later occurrence too; null doc_ids are passed on as
they are. Other columns are passed on whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import WordHash, drop, fresh_name, joined, mix, slices, windows, written

LENGTH, GAP = 50, 7
#: Sampled windows that a task sorts at once.
LOT = 1_000_000
#: Parts of the samples, by the first bits of their hashes, and bits of the filter that a part has at most.
PART_BITS, CHUNK_BITS = 10, 18
SHARD_WORDS, BROADCAST_WORDS = 100_000, 20_000
_WORD = re.compile(r"\S+")


def sampled(h: np.ndarray, ends: np.ndarray, length: int, gap: int) -> np.ndarray:
    """Starts, in h, of the sampled windows of texts that end at ends: the last least hash of every gap windows, and of all windows of a text with fewer."""
    w = windows(h, length)
    n = len(w)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    owner = np.searchsorted(ends, place, "right")
    last = ends[owner] - length
    inside = place <= last
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    w = np.where(inside, w, top)
    best, at = w.copy(), place.copy()
    for s in range(1, min(gap, n)):
        # a run of windows must lie in one text
        better = np.flatnonzero((w[s:] <= best[:-s]) & (place[s:] <= last[:-s]))
        best[better], at[better] = w[s:][better], better + s
    # a start counts if gap windows follow it in its text, or if it is the text's first
    starts = np.concatenate([[0], ends[:-1]])[owner]
    return np.unique(at[inside & ((place + gap - 1 <= last) | (place == starts))])


class Automaton:
    """Suffix automaton of word runs, added in the order of their places; first[v] is the earliest place where the words of state v end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        self.doc: list = []
        self.at: list[int] = []

    def add(self, doc, start: int, words: list[int]) -> None:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        last = 0
        for i, c in enumerate(words):
            place = len(self.doc)
            self.doc.append(doc)
            self.at.append(start + i)
            if c in nxt[last]:
                q = nxt[last][c]
                if length[last] + 1 == length[q]:
                    last = q
                    continue
                clone = len(length)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                first.append(first[q])
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            new = len(length)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(place)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(length)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link[q] = link[new] = clone
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = new

    def repeats(self, doc, words: list[int], least: int) -> list[list[int]]:
        """Maximal spans of words whose every window of least words occurs here, first at an earlier place."""
        nxt, link, length, first, docs, at = self.next, self.link, self.len, self.first, self.doc, self.at
        out: list[list[int]] = []
        v = n = 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if (u := nxt[v].get(c)) is None:
                n = 0
                continue
            v = u
            n += 1
            if n >= least:
                while length[link[u]] >= least:
                    u = link[u]
                e = first[u]
                if docs[e] < doc or docs[e] == doc and at[e] < i:
                    a = i - least + 1
                    if out and a <= out[-1][1]:
                        out[-1][1] = i + 1
                    else:
                        out.append([a, i + 1])
        return out


def _words(texts: list, hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    split = [(t or "").split() for t in texts]
    return hashes.of([w for x in split for w in x]), np.cumsum([len(x) for x in split])


class Filter:
    """Which hashes may repeat: a row of bits for each part, of two places a hash."""

    def __init__(self, chunks: dict[int, bytes]):
        many = np.array([8 * len(chunks.get(k, b"\0" * 8)) for k in range(1 << PART_BITS)])
        self.base, self.mask = np.cumsum(many) - many, (many - 1).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(chunks.get(k, b"\0" * 8) for k in range(1 << PART_BITS)), np.uint8)

    @staticmethod
    def split(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - PART_BITS)).astype(np.int64), (h >> np.uint64(32 - PART_BITS)).astype(np.uint32)

    @staticmethod
    def places(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(rest.astype(np.uint64) + np.uint64(1))
        return x, x >> np.uint64(32)

    @staticmethod
    def chunk(rest: np.ndarray) -> bytes:
        bits = np.zeros(1 << min(CHUNK_BITS, max(6, int(np.ceil(np.log2(32 * len(rest)))))), bool)
        for x in Filter.places(rest):
            bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def has(self, h: np.ndarray) -> np.ndarray:
        part, rest = self.split(h)
        out = np.ones(len(h), bool)
        for x in self.places(rest):
            at = self.base[part] + (x & self.mask[part]).astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def _repeated(docs: DataFrame, length: int, gap: int) -> Filter:
    """The sampled windows of length words that occur more than once."""

    def sample(batches):
        hashes, held, have = WordHash(), [], 0

        def close():
            nonlocal held, have
            h = np.sort(np.concatenate(held))
            held, have = [], 0
            # one that repeats here goes twice, however often it occurs
            few = np.ones(len(h), bool)
            few[2:] = h[2:] != h[:-2]
            part, rest = Filter.split(h[few])
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array([rest[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())], names=["part", "rest"])

        for part in slices(batches):
            h, ends = _words(part.column(0).to_pylist(), hashes)
            at = sampled(h, ends, length, gap)
            if len(at):
                held.append(windows(h, length)[at])
                have += len(at)
                if have > LOT:
                    yield close()
        if held:
            yield close()

    def repeated(batches):
        """Of rows in the order of parts: the bits of those of a part that stand twice."""
        now, held = None, []

        def close():
            x = np.sort(np.concatenate(held))
            if len(many := np.unique(x[1:][x[1:] == x[:-1]])):
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([Filter.chunk(many)], pa.binary())], names=["part", "bits"])

        for batch in slices(batches):
            for part, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and held:
                    yield from close()
                    held = []
                now = part
                held.append(np.frombuffer(rest, np.uint32))
        if held:
            yield from close()

    found = docs.where("_doc is not null and text is not null").select("text").mapInArrow(sample, "part int, rest binary")
    rows = found.repartition("part").sortWithinPartitions("part").mapInArrow(repeated, "part int, bits binary").collect()
    return Filter({r["part"]: bytes(r["bits"]) for r in rows})


def _copies(docs: DataFrame, length: int, gap: int) -> DataFrame:
    """Of the windows of length words that occur more than once, where each occurs first: kind 0, doc, at; and which documents have others of them: kind 1, doc, owner."""
    repeats = docs.sparkSession.sparkContext.broadcast(_repeated(docs, length - gap + 1, gap))

    def near(batches):
        hashes = WordHash()
        for part in slices(batches):
            h, ends = _words(part.column(1).to_pylist(), hashes)
            at = sampled(h, ends, length - gap + 1, gap)
            at = at[repeats.value.has(windows(h, length - gap + 1)[at])] if len(at) else at
            if not len(at):
                continue
            owner, start = np.repeat(np.searchsorted(ends, at, "right"), gap), np.concatenate([[0], ends[:-1]])
            at = (at[:, None] + np.arange(1 - gap, 1)).ravel()
            at = np.unique(at[(at >= start[owner]) & (at + length <= ends[owner])])
            if len(at):
                owner = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array(windows(h, length)[at].view(np.int64)), part.column(0).take(pa.array(owner)), pa.array((at - start[owner]).astype(np.int32))], names=["w", "doc", "at"])

    base = docs.where("_doc is not null and text is not null").select("_doc", "text")

    def firsts(batches):
        """Of rows in the order of w, doc and at; no more is held than a batch, the first row of the run that goes on, and pairs that are being gathered."""
        held, have, open_, told = [], 0, None, False

        def pairs():
            nonlocal held, have
            doc, owner = (np.concatenate(x) for x in zip(*held))
            held, have = [], 0
            order = np.lexsort((owner, doc))
            doc, owner = doc[order], owner[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])])
            return rows(1, doc[new], owner[new])

        def rows(kind, a, b):
            for k in range(0, len(a), 100_000):
                x = a[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x.astype(np.int64)), pa.array(b[k : k + 100_000].astype(np.int64))], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            w, doc, at = (batch.column(i).to_numpy() for i in range(3))
            if open_ is not None:
                w, doc, at = (np.concatenate([[x], y]) for x, y in zip(open_, (w, doc, at)))
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            other = np.flatnonzero((doc != doc[first]) | (at != at[first]))
            runs = np.unique(first[other])
            yield from rows(0, doc[fresh := runs[1:] if told and len(runs) and runs[0] == 0 else runs], at[fresh])
            if len(other):
                held.append((doc[other], doc[first[other]]))
                have += len(other)
                if have > LOT:
                    yield from pairs()
            last = int(first[-1])
            told = bool(len(runs) and runs[-1] == last) or told and last == 0
            open_ = w[last], doc[last], at[last]
        if held:
            yield from pairs()

    found = base.mapInArrow(near, "w bigint, doc bigint, at int").repartition("w").sortWithinPartitions("w", "doc", "at")
    return written(found.mapInArrow(firsts, "kind tinyint, a bigint, b bigint"), "copies")


def _runs(owners: DataFrame, length: int) -> DataFrame:
    """(owner, starts, ends, cost): the windows that begin at an owner's places as runs of words."""

    def run(batches):
        for part in slices(batches, 4096):
            lists = part.column(1)
            many = lists.value_lengths().to_numpy()
            p, of = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(many)), many)
            order = np.lexsort((p, of))
            p, of = p[order], of[order]
            head = np.ones(len(p), bool)
            head[1:] = (of[1:] != of[:-1]) | (p[1:] > p[:-1] + length)
            tail = np.concatenate([head[1:], [True]])[: len(p)]
            starts, ends = p[head].astype(np.int32), (p[tail] + length).astype(np.int32)
            edges = np.concatenate([[0], np.cumsum(np.bincount(of[head], minlength=len(many)))]).astype(np.int32)
            cost = np.bincount(of[head], (ends - starts).astype(float), len(many)).astype(np.int64)
            column = lambda x: pa.ListArray.from_arrays(pa.array(edges), pa.array(x))
            yield pa.RecordBatch.from_arrays([part.column(0), column(starts), column(ends), pa.array(cost)], names=["owner", "starts", "ends", "cost"])

    return owners.mapInArrow(run, "owner bigint, starts array<int>, ends array<int>, cost bigint")


def spans(docs: DataFrame, length: int = LENGTH, gap: int = GAP) -> DataFrame:
    """(doc, text_hash, spans): word offsets [start, end) of what goes, for the documents that lose something."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), "text")
    copies = _copies(docs, length, gap)
    pairs = copies.where("kind = 1").select(F.col("a").alias("doc"), F.col("b").alias("owner")).distinct()
    root = pairs.groupBy("doc").agg(F.min("owner").alias("root"))
    owners = _runs(copies.where("kind = 0").groupBy(F.col("a").alias("owner")).agg(F.collect_list(F.col("b").cast("int")).alias("places")), length)
    owners = owners.join(root.withColumnRenamed("doc", "owner"), "owner", "left").withColumn("root", F.least(F.coalesce("root", "owner"), "owner"))
    owners = written(owners, "owners")
    cost = owners.groupBy("root").agg(F.ceil(F.sum("cost") / F.lit(SHARD_WORDS)).alias("parts"), F.sum("cost").alias("total"))
    total = owners.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    shards = owners.join(cost, "root").select("owner", "starts", "ends", F.xxhash64("root", F.pmod(F.xxhash64("owner"), F.col("parts"))).alias("shard"))
    refs_of = shards.withColumnRenamed("owner", "_doc")
    wanted = pairs.join(shards.select("owner", "shard"), "owner").groupBy("doc").agg(F.collect_set("shard").alias("shards"))
    plan = written(refs_of.join(wanted.withColumnRenamed("doc", "_doc"), "_doc", "full"), "plan")
    many = lambda c: F.greatest(F.size(c), F.lit(0))
    rows, entries = plan.agg(F.count("*"), F.coalesce(F.sum(many("starts") + many("shards")), F.lit(0))).first()
    drop(copies, owners)

    def cut(batches):
        """Rows of reference text (role 0) and of documents to stream (role 1), as 32-bit words."""
        hashes = WordHash()
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            h, ends = _words(texts, hashes)
            small = (h >> np.uint64(32)).astype("<u4")
            shard, role, doc, start, packed, of = [], [], [], [], [], []
            doc_ids = part.column(0).to_pylist()
            for k, (starts, stops, own, go, text_hash) in enumerate(zip(*(part.column(i).to_pylist() for i in range(2, 7)))):
                words = small[ends[k - 1] if k else 0 : ends[k]]
                for a, b in zip(starts or (), stops or ()):
                    shard.append(own), role.append(0), doc.append(doc_ids[k]), start.append(a), packed.append(words[a:b].tobytes()), of.append(text_hash)
                for s in go or ():
                    shard.append(s), role.append(1), doc.append(doc_ids[k]), start.append(0), packed.append(words.tobytes()), of.append(text_hash)
            if shard:
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(role, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(packed, pa.binary()), pa.array(of, pa.int64())], names=["shard", "role", "doc", "start", "words", "text_hash"])

    base = docs.where("_doc is not null and text is not null").select("_doc", "text")
    picked = joined(base, plan, 96 * rows + 8 * entries, "_doc", "inner").select("_doc", "text", "starts", "ends", "shard", "shards", F.xxhash64("text"))
    schema = "shard bigint, role int, doc bigint, start int, words binary, text_hash bigint"
    found = "doc bigint, text_hash bigint, a int, b int"

    def emit(rows):
        d, t, a, b = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc", "text_hash", "a", "b"])

    if total <= BROADCAST_WORDS:
        texts = picked.where("starts is not null").mapInArrow(cut, schema).where("role = 0").orderBy("doc", "start").collect()
        automata: dict[int, Automaton] = {}
        for r in texts:
            automata.setdefault(r["shard"], Automaton()).add(r["doc"], r["start"], np.frombuffer(r["words"], "<u4").tolist())
        shared = spark.sparkContext.broadcast(automata)

        def stream(batches):
            for part in batches:
                out = []
                for s, d, w, t in zip(*(part.column(i).to_pylist() for i in (0, 2, 4, 5))):
                    out += [(d, t, a, b) for a, b in shared.value[s].repeats(d, np.frombuffer(w, "<u4").tolist(), length)]
                if out:
                    yield emit(out)

        hits = picked.where("shards is not null").mapInArrow(cut, schema).where("role = 1").mapInArrow(stream, found)
    else:

        def stream(batches):
            now, automaton = None, None
            for part in slices(batches, 256):
                out = []
                for s, role, d, start, w, t in zip(*(part.column(i).to_pylist() for i in range(6))):
                    if s != now:
                        now, automaton = s, Automaton()
                    words = np.frombuffer(w, "<u4").tolist()
                    if role:
                        out += [(d, t, a, b) for a, b in automaton.repeats(d, words, length)]
                    else:
                        automaton.add(d, start, words)
                if out:
                    yield emit(out)

        hits = picked.mapInArrow(cut, schema).repartition("shard").sortWithinPartitions("shard", "role", "doc", "start").mapInArrow(stream, found)
    return hits.distinct().groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup(docs: DataFrame, length: int = LENGTH, gap: int = GAP, report: bool = False) -> DataFrame:
    """docs with the repeated spans taken out of text, and n_chars, if it is there, counted anew. report: with n_removed words, and without any column but doc_id and text."""
    if report:
        docs = docs.select("doc_id", "text")
    gone = written(spans(docs, length, gap), "spans")
    rows, entries = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    names = docs.columns
    doc, text_hash, marks = (fresh_name(docs, x) for x in ("doc", "hash", "spans"))
    both = docs.withColumns({doc: F.col("doc_id").cast("bigint"), text_hash: F.xxhash64("text")})
    both = joined(both, gone.toDF(doc, text_hash, marks), 96 * rows + 32 * entries, [doc, text_hash], "left").select(*[f"`{n}`" for n in names], marks)
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    schema = T.StructType([*docs.schema, *([T.StructField("n_removed", T.IntegerType())] if report else [])])

    def run(batches):
        for part in slices(batches):
            columns = [part.column(i) for i in range(len(names))]
            removed = np.zeros(part.num_rows, np.int32)
            marks = part.column(len(names))
            if marks.null_count < part.num_rows:
                texts = columns[at].to_pylist()
                sizes = columns[chars].to_pylist() if chars >= 0 else None
                for k, found in enumerate(marks.to_pylist()):
                    if found and texts[k] is not None:
                        ends = [m.span() for m in _WORD.finditer(texts[k])]
                        pieces, after = [], 0
                        for x in found:
                            a, b = max(x["a"], after), min(x["b"], len(ends))
                            if b > a:
                                pieces.append(texts[k][ends[after - 1][1] if after else 0 : ends[a][0]])
                                removed[k] += b - a
                                after = b
                        pieces.append(texts[k][ends[after - 1][1] :] if after else texts[k])
                        texts[k] = "\n".join(p for p in map(str.strip, pieces) if p)
                        if sizes:
                            sizes[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes:
                    columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(removed)] if report else [])], names=[*names, *(["n_removed"] if report else [])])

    return both.mapInArrow(run, schema)
