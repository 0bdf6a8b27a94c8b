"""Operator 7: a content-addressed archive of WARC records.

A record's bytes fall into its exact headers (the WARC header, and the HTTP header where there is one), the payload, and what
follows it. Headers are kept for each record; payload bytes once for each SHA-256 digest, from the record with the smallest id. A
digest that a record declares, as SHA-256, SHA-1, SHA-384, SHA-512 or MD5 in hexadecimal or base 32, is held against the payload. Records are
reconstructed by a join on the digest, and the digest of what comes out of the store is computed again. One pass of Arrow batches finds the places
in each record's bytes, which Spark's expressions would decode again for each place.

Edge cases: a null record has null columns and comes back null; an empty record, one without the end of a header, or one shorter than its
Content-Length is kept whole as its header, with an empty payload; without a Content-Length the payload goes to the end. Repeated records,
and records with equal ids, each come back. A record whose id is null is stored with its own payload like any other. An empty table gives
an empty archive. Columns other than the two named are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import drop, joined, slices, written

END = "\r\n\r\n"
GZIP = b"\x1f\x8b"
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n")
_HTTP = re.compile(rb"(?i)\r\ncontent-type:[ \t]*application/http")
_DIGEST = re.compile(rb"(?i)\r\nwarc-payload-digest:[ \t]*([a-z0-9-]+):([a-z0-9=]+)[ \t]*\r\n")


def from_pages(pages: DataFrame) -> DataFrame:
    """(record_id, record): a response record for each page."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.translate(F.coalesce("url", F.lit("")), "\r\n", ""),
        F.lit("\r\nWARC-Date: 2026-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(END),
    )
    return pages.select(F.col("page_id").cast("bigint").alias("record_id"), F.concat(F.encode(head, "UTF-8"), F.encode(http, "UTF-8"), body, F.encode(F.lit(END), "UTF-8")).alias("record"))


def unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a file, out of gzip members if it begins with one. A member that is cut short or broken gives what could be unpacked of it; bytes behind it that begin no member come as they are."""
    chunks, opened, plain = iter(chunks), None, False
    rest = b""
    for chunk in chunks:
        rest += chunk
        while rest:
            if plain:
                yield rest
                rest = b""
            elif opened is None:
                if len(rest) < 2:
                    break
                if rest[:2] == GZIP:
                    opened = zlib.decompressobj(31)
                else:
                    plain = True
            else:
                try:
                    out, rest = opened.decompress(rest, 1 << 24), opened.unconsumed_tail
                except zlib.error:
                    plain = True
                    continue
                if out:
                    yield out
                if opened.eof:
                    rest, opened = opened.unused_data, None
    if opened is not None and (out := opened.flush()):
        yield out
    if rest:
        yield rest


def split_stream(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a WARC file, plain or of gzip members, of which no more is held than one record and a chunk; what can't be told apart comes as one record."""
    held, chunks = bytearray(), unpacked(chunks)
    more = True

    def fill(size: int) -> bool:
        nonlocal more
        while more and len(held) < size:
            chunk = next(chunks, None)
            if chunk is None:
                more = False
            else:
                held.extend(chunk)
        return len(held) >= size

    seen = 0
    while fill(1):
        end = held.find(b"\r\n\r\n", max(0, seen - 3))
        if end < 0 and more:
            seen = len(held)
            fill(seen + 1)
            continue
        seen = 0
        says = _LENGTH.search(bytes(held[: end + 2])) if end >= 0 else None
        if says is None:
            fill(1 << 62)
            yield bytes(held)
            return
        stop = end + 4 + int(says[1])
        fill(stop + 4)
        if held[stop : stop + 4] == b"\r\n\r\n":
            stop += 4
        yield bytes(held[:stop])
        del held[:stop]


def read(spark: SparkSession, path: str, chunk: int = 1 << 23) -> DataFrame:
    """(record_id, record) of WARC files of any size, each read by one task chunk by chunk; ids are 64-bit hashes of the files' paths and the records' places."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, at = fs.FileSystem.from_uri(name)
                with where.open_input_file(at) as f:
                    for k, record in enumerate(split_stream(iter(lambda f=f: f.read(chunk), b""))):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([record], pa.binary())], names=["path", "k", "record"])

    files = spark.read.format("binaryFile").load(path).selectExpr("replace(path, 'file:/', 'file:///') as path").repartition("path")
    return files.mapInArrow(run, "path string, k bigint, record binary").select(F.xxhash64("path", "k").alias("record_id"), "record")


def _places(record: bytes) -> tuple[int, int, bytes]:
    """Where the payload starts and stops, and the WARC header with the line end of its last line."""
    end, size = record.find(b"\r\n\r\n"), len(record)
    if end < 0:
        return size, size, b""
    head, block = record[: end + 2], end + 4
    found = _LENGTH.search(head)
    says = int(found[1]) if found else None
    if says is not None and block + says > size:
        return size, size, head
    stop = size if says is None else block + says
    inner = record.find(b"\r\n\r\n", block) if _HTTP.search(head) else -1
    # an HTTP header that doesn't end in the record's block is part of the payload
    return (inner + 4 if 0 <= inner and inner + 4 <= stop else block), stop, head


def _declared(head: bytes, payload: bytes) -> bool | None:
    """Whether the payload has the digest that the header declares, in hexadecimal or base 32; None without one in an algorithm known here."""
    found = _DIGEST.search(head)
    kind = found and found[1].decode().lower().replace("-", "")
    if not found or kind not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    own, said = hashlib.new(kind, payload).digest(), found[2].strip()
    if len(said) not in (2 * len(own), -(-8 * len(own) // 5), -(-len(own) // 5) * 8):  # no digest of that kind
        return None
    return said.lower() == own.hex().encode() or said.upper().rstrip(b"=") == base64.b32encode(own).rstrip(b"=")


def parse(records: DataFrame, whole: bool = True) -> DataFrame:
    """(record_id, header, tail, digest, declared_fits) of each record, or (record_id, digest, payload) unless whole."""

    def run(batches):
        for part in slices(batches, 256):
            rows = []
            for record in part.column(1).to_pylist():
                if record is None:
                    rows.append((None,) * (4 if whole else 2))
                    continue
                start, stop, head = _places(record)
                payload = record[start:stop]
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((record[:start], record[stop:], digest, _declared(head, payload)) if whole else (digest, payload))
            if rows:
                kinds = [pa.binary(), pa.binary(), pa.string(), pa.bool_()] if whole else [pa.string(), pa.binary()]
                names = ["header", "tail", "digest", "declared_fits"] if whole else ["digest", "payload"]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names=["record_id", *names])

    schema = "record_id bigint, header binary, tail binary, digest string, declared_fits boolean" if whole else "record_id bigint, digest string, payload binary"
    return records.select(F.col("record_id").cast("bigint").alias("record_id"), "record").mapInArrow(run, schema)


def store(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written: headers (record_id, header, tail, digest, declared_fits) of every record; payloads (digest, owner, payload), one of each digest.

    Payload bytes aren't shuffled to find the copies: the owner of each digest, the record of the smallest id, is found from the headers alone.
    """
    headers = written(parse(records), "headers")
    same = headers.where("digest is not null").groupBy("digest").agg(F.min("record_id").alias("owner"), F.count("*").alias("many"))
    owners = written(same, "owners")
    few = owners.where("many > 1")
    # of most payloads there is one record: those that aren't kept are named, by their ids
    gone = headers.join(few.select("digest", "owner"), "digest").where("record_id is not null and record_id <> owner").select("record_id", "digest").distinct()
    gone = written(gone, "gone")
    rows = parse(records, False).where("digest is not null")
    mine = joined(rows, gone, 128 * gone.count(), ["record_id", "digest"], "left_anti")
    # the same id can come with the same payload more than once, and a payload may have no record with an id
    again = headers.where("digest is not null").groupBy("digest", "record_id").count().where("count > 1 or record_id is null").select("digest").distinct()
    again = written(again, "again")
    if n := again.count():
        once = joined(rows, again, 128 * n, "digest", "left_semi").groupBy("digest").agg(F.min("record_id").alias("owner"), F.first("payload").alias("payload"))
        mine = joined(mine, again, 128 * n, "digest", "left_anti")
        payloads = mine.select("digest", F.col("record_id").alias("owner"), "payload").unionByName(once)
    else:
        payloads = mine.select("digest", F.col("record_id").alias("owner"), "payload")
    payloads = written(payloads, "payloads")
    drop(owners, gone, again)
    return headers, payloads


def restore(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record_id, digest, owner, header_bytes, payload_bytes, declared_fits, verified, record): verified says that the stored payload still has its digest."""
    both = headers.join(payloads, "digest", "left")
    return both.select(
        "record_id",
        "digest",
        "owner",
        F.octet_length("header").alias("header_bytes"),
        F.octet_length("payload").alias("payload_bytes"),
        "declared_fits",
        (F.sha2("payload", 256) == F.col("digest")).alias("verified"),
        F.concat("header", "payload", "tail").alias("record"),
    )
