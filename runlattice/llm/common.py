"""What the operators share: tables, shared storage, text handling and hashing."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.storage import dropped, fresh, shared_dir, stored  # noqa: F401

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Most words that a worker remembers at once; beyond it the memory is emptied, which changes no result.
MEMO_WORDS = 120_000
#: Most rows of a batch that a Python worker holds.
ARROW_ROWS = 1000
#: Text bytes that one reduce-side bucket is meant to stand for.
BUCKET_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_bytes(df: DataFrame) -> int:
    """Size estimate of df's scan from Spark's statistics; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bucket_count(df: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for a shuffle of df: in proportion to its input, never fewer than the session's partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = scan_bytes(df)
    return max(least, min(size // per_bucket, 1 << 20) if size < 1 << 62 else least)


def ensure_workers_import(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't on their path already, and keeps their batches small.

    Texts are long, so batches hold ARROW_ROWS rows at most instead of Spark's 10,000.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > ARROW_ROWS:
        spark.conf.set(batch, str(ARROW_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; bytes.split() splits at exactly these."""
    return text.split()


class WordHashes(dict):
    """64-bit hash of each word, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hash of each k-word shingle in order; with fewer words, of the whole sequence; none without words."""
    h = word_hashes(words)
    n = len(h)
    if n == 0:
        return h
    m = min(n, k)
    acc = np.full(n - m + 1, np.uint64(m), dtype=np.uint64)
    for i in range(m):
        acc += mix64(h[i : n - m + 1 + i] + _ODD[i]) * _ODD[i]
    return mix64(acc)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; nulls give no bytes."""
    return [b or b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def text_strings(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]


def native_bytes(column) -> object:
    """A Column of the UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.encode(column, "UTF-8"), F.lit(b""))
