"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into strings at once; bounds its memory, not the result.
SLICE = 512
#: Bytes in memory up to which a table is broadcast; beyond it, it is joined by shuffle.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of this machine in local mode, as in tests, and an error on a cluster."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone, and with it its folder
        pass


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: it is computed once, and the loss of an executor costs a read, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t.written_at)


def joined(big: DataFrame, small: DataFrame, size: int, on: str | list[str], how: str) -> DataFrame:
    """big joined with a table of so many bytes in memory, which is broadcast if they are few, else shuffled."""
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs stay equal, others are spread evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHash(dict):
    """64-bit hashes of words, kept for words already seen by this worker."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, 2 * len(_POWERS))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE)]))
            _INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inverse)]))
    return _POWERS[:n], _INVERSE[:n]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k hashes; equal runs have equal hashes wherever they stand. Empty if h is shorter than k."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])
