"""What the operators share: scratch tables, Arrow chunks, vectorised hashes.

All scratch tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor and the driver can read, so a lost executor loses nothing that a
later stage needs. Only where the setting is absent and there are no other machines
(tests, a notebook) a folder below /tmp/checkpoints is chosen.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; set here only where unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"/tmp/checkpoints/rillflow-{uuid.uuid4().hex}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage at files that survive executors; the schema stays as it is.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillflow/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path  # type: ignore[attr-defined]
    return back


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store, as other readers than Spark need it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def erase(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            erase(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts that no live table needs.

    It deletes them when the driver's garbage is collected, which a driver with memory
    to spare does too late for jobs of many steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch small enough for texts of any length in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: what splits training from held-out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Return freed memory to the system: a worker that idles after a task would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with at most ``max_bytes`` of text, or one longer text.

    A null text comes as empty bytes.
    """
    for batch in batches:
        raw = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= max_bytes):
                size += len(raw[end])
                end += 1
            yield batch.slice(at, end - at), raw[at:end]
            at = end
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of each word of lower-cased texts, in order.

    A word is a run of bytes other than blank, tab to carriage return; only A-Z
    are lower-cased. The hash is polynomial, then mixed.
    """
    joined = b"\n".join(raw).lower()
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts])
    first = np.cumsum([0] + [len(x) + 1 for x in raw[:-1]])
    return np.searchsorted(first, starts, side="right") - 1, h
