"""Helpers that the operators share: staging, hashing, packed blobs, span arithmetic."""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CODES = ["u1", "u2", "u4", "u8", "i8", "i4"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset, a temporary one for a local master; an error for any other."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "quillspark-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Settings while a staged table is written: its shuffle files go at once, Python gets small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind the written table go at once, the table itself with `unstage` or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    settings = spark._jsparkSession.sessionState().conf()
    before = {k: spark.conf.get(k) if settings.contains(k) else None for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    _on_path(spark, path, "deleteOnExit")
    out = spark.read.schema(schema).parquet(path)
    out._qs_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in staged:
        _on_path(df.sparkSession, df._qs_path, "delete", True)


def _on_path(spark: SparkSession, path: str, method: str, *rest) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark._jsc.hadoopConfiguration()), method)(p, *rest)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of `df`, or the length of its texts where there is none; only parallelism is derived from it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
        size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8)).cast("long")).alias("n")).first().n or 0
    return size


#: Shuffle partitions at most; what a task holds at once is bounded by buckets, of which there may be more.
MOST_PARTS = 200_000


def n_parts(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Shuffle partitions for an input: one per `bytes_each`, never fewer than the session's default parallelism."""
    return int(max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_PARTS, -(-input_bytes(df) // bytes_each))))


def n_buckets(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Hash buckets for an input: a task reads one after the other, so their size bounds its memory."""
    return int(max(4 * df.sparkSession.sparkContext.defaultParallelism, min(1 << 31, -(-input_bytes(df) // bytes_each))))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit hash, by its low half."""
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """(bucket, blob) rows with the blobs of each bucket together."""
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches):
    """The unpacked blobs of one bucket after the other, from `dealt`."""
    last, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != last:
                if held:
                    yield held
                last, held = bucket, []
            held.append(unpack(blob.as_buffer().to_pybytes()))
    if held:
        yield held


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied element by element (wraps on purpose)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pack(*arrays: np.ndarray) -> bytes:
    """Several one-dimensional arrays as one blob."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        code = _CODES.index(a.dtype.str[1:])
        out += [struct.pack("<BQ", code, len(a)), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """Inverse of `pack`."""
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    for _ in range(n):
        code, length = struct.unpack_from("<BQ", blob, at)
        at += 9
        a = np.frombuffer(blob, dtype="<" + _CODES[code], count=length, offset=at)
        at += a.nbytes
        out.append(a)
    return out


def group_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    """The document group of each id; `group_col` is the same on the JVM."""
    d = doc_id.astype(np.int64)
    return np.mod(d ^ (d >> 17) ^ (d >> 33), n)


def group_col(doc_id: Column, n: int) -> Column:
    d = doc_id.cast("long")
    return F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 33)), F.lit(n)).cast("int")


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each maximal run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def first_per_value(sorted_values: np.ndarray) -> np.ndarray:
    """Indices at which a new value begins in a sorted array."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes sorted, and where each was: hash and index share a word, since a plain sort is far faster than an argsort.

    The low bits make room for the index, so hashes that agree in all others count as equal here.
    """
    bits = np.uint64(max(1, len(hashes).bit_length()))
    both = np.sort((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64))
    return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
