"""Operator 10: BPE encoding and decoding with a contiguous rank array.

A word is split by the public pattern and held as an array of part boundaries beside an array of the ranks of adjacent
parts. The array is scanned for its least rank, that boundary is deleted, and the two neighbouring ranks are refreshed,
until no adjacent parts merge. Words beyond LONG bytes, for which repeated scans would be quadratic, use a heap over the
same boundaries and give the same parts.

Edge cases: a null text gives null tokens and null counts; an empty text gives an empty list; repeated rows each give a
row; very long texts are encoded whole; an empty table gives an empty result; of equal ranks in a word the leftmost merges first; any other column is left
out of the result, whatever its name, unless it is asked for.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docweave.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beyond which a word is merged with a heap.
LONG = 256
NEVER = 1 << 60
_DOUBLE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    adjacent = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while adjacent and (least := min(adjacent)) < NEVER:
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], NEVER)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    version = [0] * n
    heap = [(r, i, 0) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n

    def refresh(i: int) -> None:
        version[i] += 1
        if (mid := after[i]) < n and (r := ranks.get(word[i : after[mid]])) is not None:
            heapq.heappush(heap, (r, i, version[i]))

    while heap:
        _, i, v = heapq.heappop(heap)
        if not alive[i] or version[i] != v:
            continue
        gone = after[i]
        after[i] = after[gone]
        alive[gone] = 0
        if after[i] < n:
            before[after[i]] = i
        refresh(i)
        if before[i] >= 0:
            refresh(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes whole texts. Chunks between single spaces, and their words, are kept packed, for LIMIT of each; new words are merged many at once."""

    LIMIT = 400_000
    #: Words up to so many bytes share two-dimensional rank arrays, by width.
    WIDTHS = (8, 16, 32)

    def __init__(self, path: str = VOCABULARY):
        self.ranks = read_ranks(path)
        self.wide = max(self.ranks.values(), default=0) >= 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.split = regex.compile(PATTERN).findall
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, i in self.ranks.items():
            self.bytes_of[i] = word
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = [(x << 32 | y, r) for w, r in self.ranks.items() for k in range(1, len(w)) if (x := get(w[:k])) is not None and (y := get(w[k:])) is not None]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [NEVER], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [NEVER], np.int64)
        self.byte_pairs = np.full((257, 257), NEVER, np.int64)  # the last row and column stand for no byte
        self.byte_pairs[:256, :256] = self._adjacent(*np.meshgrid(self.byte_id, self.byte_id, indexing="ij"))
        self.tails = {c: self._pack(c) for c in ".,"}

    def _pack(self, word: str) -> bytes:
        ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
        return struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)

    def _adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of part ids, NEVER where it doesn't merge or a part is absent (-1)."""
        keys = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge() for words of at most WIDTHS[-1] bytes, packed: each row is a word's contiguous array of parts and of adjacent ranks."""
        n, width = len(words), max(map(len, words))
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.full((n, width + 1), 256, np.int64)
        raw[np.arange(width + 1) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        parts = np.append(self.byte_id, -1)[raw]
        ranks = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        row, out = np.arange(n), [b""] * n
        column = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(1)
            every = np.arange(len(row))
            least = ranks[every, at]
            over = least == NEVER
            if over.any():
                done = parts[over]
                packed = done[done >= 0].astype(self.dtype).tobytes()
                ends = np.cumsum((done >= 0).sum(1)) * self.dtype.itemsize
                start = 0
                for r, end in zip(row[over].tolist(), ends.tolist()):
                    out[r] = packed[start:end]
                    start = end
                more = ~over
                row, parts, ranks, at, least = row[more], parts[more], ranks[more], at[more], least[more]
                every = np.arange(len(row))
                if not len(row):
                    break
            # delete the boundary behind part `at`, then refresh the ranks on either side of the new part
            source = column + (column > at[:, None])
            source[:, -1] = len(column) - 1
            parts = np.take_along_axis(parts, source, 1)
            parts[:, -1] = -1
            parts[every, at] = least
            source = column[:-1] + (column[:-1] >= at[:, None])
            source[:, -1] = len(column) - 2
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = NEVER
            ranks[every, at] = self._adjacent(least, parts[every, at + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._adjacent(parts[left, at[left] - 1], least[left])
        return out

    def _learn(self, unseen: set[str]) -> None:
        """Packs chunks, each with the space before it, that haven't been seen. One of letters is a word, and with a point or comma behind it that word and one more."""
        known, split, tails, words = self.chunks, self.split, self.tails, self.words
        alone, tailed, other, new = set(), [], {}, set()
        for chunk in unseen:
            if chunk.isalpha():
                alone.add(chunk)
            elif chunk[-1:] in tails and chunk[:-1].isalpha():
                tailed.append(chunk)
                if (word := chunk[:-1]) not in known:
                    alone.add(word)
            else:
                found = other[chunk] = split(" " + chunk)
                new.update([w for w in found if w not in words])
        self._merge_words(alone, known, " ")
        for chunk in tailed:
            known[chunk] = known[chunk[:-1]] + tails[chunk[-1]]
        self._merge_words(new, words)
        for chunk, found in other.items():
            known[chunk] = b"".join([words[w] for w in found])

    def _merge_words(self, new: set[str], to: dict[str, bytes], before: str = "") -> None:
        """Puts each new word's ids, with the space before it, into `to`."""
        by_width: list[tuple[list[str], list[bytes]]] = [([], []) for _ in self.WIDTHS]
        form, get = f"<{'I' if self.wide else 'H'}", self.ranks.get
        for word in new:
            raw = (before + word).encode("utf-8", "surrogatepass")
            size = len(raw)
            if (whole := get(raw)) is not None:
                to[word] = struct.pack(form, whole)
            elif size > self.WIDTHS[-1]:
                to[word] = self._pack(before + word)
            else:
                names, raws = by_width[(size > self.WIDTHS[0]) + (size > self.WIDTHS[1])]
                names.append(word)
                raws.append(raw)
        for names, raws in by_width:
            if names:
                to.update(zip(names, self.merge_many(raws)))

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian. A single space between two other characters always starts a word of the pattern, so texts may be cut there."""
        if len(self.words) > self.LIMIT or len(self.chunks) > self.LIMIT:
            self.words.clear()
            self.chunks.clear()
        cut, firsts, unseen = [], set(), set()
        for text in texts:
            parts = (_CUT.split(text) if _DOUBLE.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")) if text else [""]
            cut.append(parts)
            firsts.update(self.split(parts[0]))
            unseen.update(parts[1:])
        self._merge_words(firsts.difference(self.words), self.words)
        self._learn(unseen.difference(self.chunks))
        words, get = self.words, self.chunks.__getitem__
        return [b"".join([words[w] for w in self.split(parts[0])]) + b"".join(map(get, parts[1:])) for parts in cut]

    def packed(self, text: str) -> bytes:
        return self.packed_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.dtype).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Columns that encode() adds.
MADE = ("token_ids", "n_tokens", "n_bytes", "round_trip")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, verify: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, token_ids, n_tokens, n_bytes[, round_trip]) and the columns in keep, for every row of docs.

    round_trip: the decoded ids give the text's bytes again. No shuffle: the rows stay in their partitions.
    """
    fields = [(f.name, f.dataType) for f in docs.schema if f.name in ("doc_id", *keep)]
    schema = ", ".join(f"`{n}` {t.simpleString()}" for n, t in fields) + ", token_ids array<int>, n_tokens int, n_bytes bigint" + ", round_trip boolean" * verify
    names = [n for n, _ in fields]

    def run(batches):
        own = encoder(vocabulary)
        for part in slices(batches):
            texts = part.column(part.num_columns - 1).to_pylist()
            null = np.array([t is None for t in texts])
            packs = own.packed_many([t or "" for t in texts])
            sizes = np.array([len(p) // own.dtype.itemsize for p in packs], np.int64)
            flat = np.frombuffer(b"".join(packs), own.dtype).astype(np.int32)
            ends = np.zeros(len(packs) + 1, np.int32)
            np.cumsum(sizes, out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(null))
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            columns = [part.column(i) for i in range(part.num_columns - 1)]
            columns += [ids, pa.array(sizes.astype(np.int32), mask=null), pa.array(np.array([len(r) for r in raw], np.int64), mask=null)]
            if verify:
                back = own.decode(flat.tolist())
                joined = b"".join(raw)
                if back == joined:
                    fine = np.ones(len(texts), bool)
                else:
                    fine = np.array([own.decode(flat[a:b].tolist()) == r for a, b, r in zip(ends, ends[1:], raw)])
                columns.append(pa.array(fine, mask=null))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "token_ids", "n_tokens", "n_bytes", *["round_trip"] * verify])

    return docs.select(*[f"`{n}`" for n in names], "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids). Null ids, or one outside the vocabulary, give a null text; bytes that are no UTF-8 give U+FFFD."""

    def run(batches):
        own = encoder(vocabulary)
        for part in slices(batches):
            texts = []
            for ids in part.column(1).to_pylist():
                fine = ids is not None and all(i is not None and 0 <= i < len(own.bytes_of) for i in ids)
                texts.append(own.decode(ids).decode("utf-8", "replace") if fine else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
