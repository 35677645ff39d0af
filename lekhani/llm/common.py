"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: str, n: int):
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one takes a temporary folder; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            named = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
    return named.rstrip("/")


#: Spark's setting that drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes that a batch of rows on its way to a Python worker holds.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths that settle() wrote and nothing has deleted yet.
_WRITTEN: set[str] = set()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, *spent: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write the rows to the shared folder and read them again: cuts the lineage, survives lost executors.

    spent: settled rows that nothing reads after this write; they are deleted.
    """
    path = f"{shared_dir(df.sparkSession)}/lekhani-{uuid.uuid4().hex}"
    with setting(df.sparkSession, CLEANUP, "true"):  # shuffle files of this write go when it ends; nothing reads them again
        df.write.option("compression", compression).parquet(path)
    _WRITTEN.add(path)
    for old in spent:
        discard(old)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete rows that settle() wrote, once all that was made of them is settled too."""
    path = getattr(df, "written_path", None)
    if path in _WRITTEN:
        _delete(df.sparkSession, path)


def sweep(docs: DataFrame) -> None:
    """Delete all that settle() wrote in this process but what docs reads. For use between stages whose results are written."""
    read = docs.inputFiles()
    for path in list(_WRITTEN):
        if not any(path.rpartition("/")[2] in f for f in read):
            _delete(docs.sparkSession, path)


def small_batches(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `limit` bytes of column `text` (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()))
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of each (nulls are empty)."""
    column = pa.concat_arrays([column.fill_null("")])  # own buffers, offset 0
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


# Fixed odd multipliers of the splitmix64 finaliser and of the word hash.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX_2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("p", _BASE), ("q", inverse)):
            full = np.full(size, np.uint64(base))
            full[0] = 1
            _POWERS[name] = np.cumprod(full)
    return _POWERS["p"], _POWERS["q"]


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes whose class is inside; and for each text the index of its first run (n + 1 values)."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = inside[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes whose sums are held at a time; a longer word stands alone.
WINDOW = 1 << 21


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, whatever stands around it."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + WINDOW, side="right")))
        part, a, b = raw[base : ends[stop - 1]], starts[at:stop] - base, ends[at:stop] - base
        p, q = _powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[part] * p[: len(part)], out=total[1:])
        out[at:stop] = mix((total[b] - total[a]) * q[a])
        at = stop
    return out


def lower_table() -> np.ndarray:
    """Each byte, A-Z as a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def inside_table(outside: list[tuple[int, int]]) -> np.ndarray:
    """True for all bytes but those of the ranges (both ends count)."""
    t = np.ones(256, bool)
    for a, b in outside:
        t[a : b + 1] = False
    return t


LOWER = lower_table()
#: Fixed: the contract's separators of words.
NOT_BLANK = inside_table([(0x20, 0x20), (0x09, 0x0D)])
