"""Operator 2: token ids as binary blocks of a static range asymmetric numeral system.

One frequency table, counted over all tokens and scaled to 2**SCALE, is shared by every block. A block is independent: its
tokens go round-robin to LANES interleaved states, whose 32-bit words share one stream. Every STRIDE rounds the states and the
place in the stream are noted as a checkpoint, and each part from one checkpoint to the next has a CRC-32 of its tokens: parts
decode in tasks of their own. The table is stored beside the blocks, as a row without a block_id; each block names it by table_id, so that the
stored rows decode alone.

Edge cases: null and empty texts have no tokens; null keeps a length of -1 in the block, so it comes back as null. Repeated
rows are stored once each; a long document continues over as many blocks as it needs. An empty table gives only an empty
frequency table; ties in scaling go to the smaller token; very long texts are split among blocks. Columns
other than the two named are left out, whatever their names.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: log2 of what the scaled frequencies add up to; the vocabulary must be smaller.
SCALE = 20
LANES, STRIDE = 256, 256
#: Tokens of a block.
BLOCK = LANES * STRIDE * 4
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BLOCKS = "block_id bigint, table_id bigint, doc_ids array<bigint>, lengths array<int>, n_tokens int, payload binary, checkpoints binary, crc32 array<bigint>"
PARTS = "block_id bigint, part int, ord int, doc_ids array<bigint>, lengths array<int>, n_tokens int, payload binary, checkpoint binary, crc32 bigint, table_id bigint"

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENIZERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n, ids): the ids packed as unsigned 16- or 32-bit numbers; n is -1 for a null text."""

    def run(batches):
        own = _tokenizer(vocabulary)
        kind = np.dtype("<u2" if own.max_token_value < 1 << 16 else "<u4")
        for part in slices(batches):
            ids = [None if t is None else own.encode_to_numpy(t, disallowed_special=()).astype(kind).tobytes() for t in part.column(1).to_pylist()]
            n = [-1 if i is None else len(i) // kind.itemsize for i in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array([i or b"" for i in ids], pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n int, ids binary")


def _numbers(binary: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.dtype]:
    raw = b"".join(binary.to_pylist())
    total = int(np.maximum(n, 0).sum())
    kind = np.dtype("<u4" if total and len(raw) // total == 4 else "<u2")
    return np.frombuffer(raw, kind), kind


def counts(tokens: DataFrame) -> DataFrame:
    """(token, n) over all tokens; each partition sends at most one row a token of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for part in slices(batches, 4096):
            own = np.bincount(_numbers(part.column(1), part.column(0).to_numpy())[0])
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen].astype(np.int64))], names=["token", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def scaled(token: np.ndarray, n: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies by token id, at least 1 for each token that occurs, adding up to 2**scale; and where each one's range starts."""
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    if len(token) > 1 << scale:
        raise ValueError("more tokens than the scale can hold")
    room = (1 << scale) - len(token)
    share = n / n.sum() * room
    whole = np.floor(share).astype(np.int64)
    rest = room - int(whole.sum())
    whole[np.lexsort((token, whole - share))[:rest]] += 1
    freq = np.zeros(int(token.max()) + 1, np.int64)
    freq[token] = whole + 1
    return freq, np.concatenate([[0], np.cumsum(freq)])


def encode_block(tokens: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, stride: int = STRIDE, scale: int = SCALE) -> tuple[bytes, bytes]:
    """The stream, in the order in which it is decoded, and the checkpoints: (round, place in the stream, state of each lane) from the first round on, each as 64-bit numbers."""
    n = len(tokens)
    rounds = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    f, s = freq[tokens].astype(np.uint64), start[tokens].astype(np.uint64)
    bits, limit = np.uint64(scale), np.uint64((1 << 31) >> scale) << WORD
    chunks, points, out = [], [], 0
    for r in range(rounds - 1, -1, -1):
        a, b = r * lanes, min(n, (r + 1) * lanes)
        x, fr = state[: b - a], f[a:b]
        over = x >= limit * fr
        if over.any():
            chunk = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            chunks.append(chunk[::-1])
            out += len(chunk)
            x = np.where(over, x >> WORD, x)
        q = x // fr
        state[: b - a] = (q << bits) + (x - q * fr) + s[a:b]
        if r % stride == 0:
            points.append((r, out, state.copy()))
    stream = np.concatenate(chunks)[::-1] if chunks else np.zeros(0, np.uint32)
    rows = [np.concatenate([np.array([r, out - at], np.uint64), x]) for r, at, x in reversed(points)]
    return stream.astype("<u4").tobytes(), (np.concatenate(rows) if rows else np.zeros(0, np.uint64)).astype("<u8").tobytes()


def decode_part(payload: bytes, checkpoints: bytes, n: int, k: int, symbol: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES, stride: int = STRIDE, scale: int = SCALE) -> np.ndarray:
    """Tokens from checkpoint k to the next one."""
    point = np.frombuffer(checkpoints, "<u8").reshape(-1, lanes + 2)[k]
    first, at, state = int(point[0]), int(point[1]), point[2:].copy()
    stream = np.frombuffer(payload, "<u4").astype(np.uint64)
    end = min(n, (first + stride) * lanes)
    out = np.empty(end - first * lanes, np.int64)
    mask, bits = np.uint64((1 << scale) - 1), np.uint64(scale)
    f, s = freq.astype(np.uint64), start.astype(np.uint64)
    for a in range(first * lanes, end, lanes):
        m = min(lanes, end - a)
        x = state[:m]
        slot = x & mask
        token = symbol[slot.astype(np.int64)]
        out[a - first * lanes : a - first * lanes + m] = token
        x = f[token] * (x >> bits) + slot - s[token]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << WORD) | stream[at : at + len(low)]
            at += len(low)
        state[:m] = x
    return out


def symbols(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freq)), freq)


def frequency_table(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shared table. Its size is bounded by the vocabulary, not by the data."""
    rows = counts(tokens).toPandas()
    return scaled(rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def encode(tokens: DataFrame, freq: np.ndarray, start: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of the rows of each partition, in their order. lengths: the tokens of each document that lie in the block, -1 for a null text; the next block of the partition goes on where this one ends."""
    shared = tokens.sparkSession.sparkContext.broadcast((freq, start))
    table = table_id(freq)

    def run(batches):
        from pyspark import TaskContext

        f, s = shared.value
        seq = (TaskContext.get().partitionId()) << 32
        ids: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        have = 0

        def close():
            nonlocal seq, ids, sizes, held, have
            flat = np.concatenate(held) if held else np.zeros(0, np.int64)
            payload, points = encode_block(flat, f, s, LANES, STRIDE)
            size = LANES * STRIDE
            crc = [zlib.crc32(flat[k : k + size].astype("<u4").tobytes()) for k in range(0, len(flat), size)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int64()), pa.array([table], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(flat)], pa.int32()), pa.array([payload], pa.binary()), pa.array([points], pa.binary()), pa.array([crc], pa.list_(pa.int64()))],
                names=["block_id", "table_id", "doc_ids", "lengths", "n_tokens", "payload", "checkpoints", "crc32"],
            )
            seq, ids, sizes, held, have = seq + 1, [], [], [], 0
            return row

        for part in slices(batches):
            n = part.column(1).to_numpy()
            flat, _ = _numbers(part.column(2), n)
            at = 0
            for doc, size in zip(part.column(0).to_pylist(), n.tolist()):
                left = max(size, 0)
                while True:
                    take = min(left, block - have)
                    ids.append(doc)
                    sizes.append(take if size >= 0 else -1)
                    held.append(flat[at : at + take].astype(np.int64))
                    at, have, left = at + take, have + take, left - take
                    if have == block:
                        yield close()
                    if not left:
                        break
        if ids:
            yield close()

    return tokens.select("doc_id", "n", "ids").mapInArrow(run, BLOCKS)


def table_id(freq: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(freq.astype("<u4").tobytes()) >> 1


def table_row(spark, freq: np.ndarray) -> DataFrame:
    """The frequency table as a row of the archive: frequencies by token id, squeezed, with their checksum."""
    raw = freq.astype("<u4").tobytes()
    return spark.createDataFrame([(None, table_id(freq), [], [], len(freq), bytearray(zlib.compress(raw, 6)), bytearray(), [zlib.crc32(raw)])], BLOCKS)


def tables(archive: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The frequency tables of an archive by table_id, each no larger than its vocabulary; one for each store() that wrote to it."""
    out = {}
    for r in archive.where("block_id is null").select("table_id", "payload", "crc32").distinct().collect():
        raw = zlib.decompress(r["payload"])
        if zlib.crc32(raw) != r["crc32"][0]:
            raise ValueError(f"table {r['table_id']} doesn't match its checksum")
        freq = np.frombuffer(raw, "<u4").astype(np.int64)
        out[r["table_id"]] = freq, np.concatenate([[0], np.cumsum(freq)])
    return out


def split(archive: DataFrame) -> DataFrame:
    """A row for each part of each block, with what it needs: its words of the stream, its checkpoint, and the entries of the documents in it."""

    def run(batches):
        for batch in slices(batches, 8):
            for b in batch.to_pylist():
                points = np.frombuffer(b["checkpoints"], "<u8").reshape(-1, LANES + 2)
                stream = np.frombuffer(b["payload"], "<u4")
                n = np.array(b["lengths"], np.int64)
                ends = np.cumsum(np.maximum(n, 0))
                starts = ends - np.maximum(n, 0)
                size, total, parts = LANES * STRIDE, b["n_tokens"], max(1, len(points))
                rows = []
                for k in range(parts):
                    lo, hi, last = k * size, min(total, (k + 1) * size), k == parts - 1
                    inside = (np.maximum(starts, lo) < np.minimum(ends, hi)) | (n <= 0) & (starts >= lo) & ((starts < hi) | last)
                    own = np.flatnonzero(inside)
                    a, e = (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)
                    words, point = b"", b""
                    if len(points):
                        head = points[k].copy()
                        words = stream[int(head[1]) : int(points[k + 1][1]) if not last else len(stream)].tobytes()
                        head[1] = 0
                        point = head.tobytes()
                    whole = [int(min(x, hi) - max(y, lo)) if z >= 0 else -1 for x, y, z in zip(ends[a:e], starts[a:e], n[a:e])]
                    rows.append((b["block_id"], k, a, b["doc_ids"][a:e], whole, total, words, point, b["crc32"][k] if len(points) else 0, b["table_id"]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PART_TYPES)], names=_PART_NAMES)

    return archive.where("block_id is not null").select("block_id", "table_id", "doc_ids", "lengths", "n_tokens", "payload", "checkpoints", "crc32").mapInArrow(run, PARTS)


_PART_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
_PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def decode(archive: DataFrame) -> DataFrame:
    """(block_id, ord, part, doc_id, n, token_ids): the pieces of documents, in the order of the first three, from the stored rows alone. Parts are spread over all tasks. Raises where a checksum differs."""
    shared = archive.sparkSession.sparkContext.broadcast(tables(archive))

    def run(batches):
        ready = {}
        for batch in slices(batches, 16):
            for b in batch.to_pylist():
                t = b["table_id"]
                if t not in ready:
                    ready[t] = (symbols(shared.value[t][0]), *shared.value[t])
                flat = decode_part(b["payload"], b["checkpoint"], b["n_tokens"], 0, *ready[t], LANES, STRIDE) if b["checkpoint"] else np.zeros(0, np.int64)
                if zlib.crc32(flat.astype("<u4").tobytes()) != b["crc32"]:
                    raise ValueError(f"part {b['part']} of block {b['block_id']} doesn't match its checksum")
                n = np.array(b["lengths"], np.int64)
                many = len(n)
                ends = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)), mask=pa.array(n < 0))
                columns = [pa.array(np.full(many, b["block_id"])), pa.array(b["ord"] + np.arange(many, dtype=np.int32)), pa.array(np.full(many, b["part"], np.int32)), pa.array(b["doc_ids"], pa.int64()), pa.array(n.astype(np.int32)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["block_id", "ord", "part", "doc_id", "n", "token_ids"])

    return split(archive).repartition("block_id", "part").mapInArrow(run, "block_id bigint, ord int, part int, doc_id bigint, n int, token_ids array<int>")


def store(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """An archive of all rows of docs: blocks and their frequency table. The packed ids are written once to the shared folder: they are counted, then encoded."""
    tokens = written(tokenize(docs, vocabulary), "ids", "none")
    freq, start = frequency_table(tokens)
    return encode(tokens, freq, start).unionByName(table_row(docs.sparkSession, freq))
