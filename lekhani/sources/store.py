"""Tables that queries of one session share: written once to the folder that all executors see, and read by each query."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (application, name, state of the source files) -> where the rows are.
_WRITTEN: dict[tuple, str] = {}
#: Bytes that one task reads of a table that isn't small.
TASK_BYTES = 128 << 20
#: Bytes of a Parquet table of texts whose postings one task sums in memory.
PART_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Only a local session may do without and takes a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] == "local":
        named = f"file://{tempfile.gettempdir()}/checkpoints"
    if not named:
        raise ValueError("spark.checkpoint.dir names no folder that executors share")
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state(spark: SparkSession, path: str) -> tuple:
    """What tells whether the files of a table have changed: its number of files, bytes and time."""
    where, system = _path(spark, path)
    size = system.getContentSummary(where)
    return path, size.getFileCount(), size.getLength(), system.getFileStatus(where).getModificationTime()


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One too small to give every core a split of its own is dealt out first, as a row group is read by one task."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    where, system = _path(spark, path)
    return rows.repartition(cores) if system.getContentSummary(where).getLength() < cores * TASK_BYTES else rows


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The rows of make(), written when first asked for (in folders by a column, if named) and again when a source has changed."""
    key = (spark.sparkContext.applicationId, name, *(state(spark, s) for s in sources))
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/lekhani-table-{uuid.uuid4().hex}"
        rows = make()
        writer = rows.sortWithinPartitions(by, "term").write.partitionBy(by) if by and "term" in rows.columns else rows.write.partitionBy(by) if by else rows.write
        writer.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def parts_of(spark: SparkSession, path: str) -> int:
    """Into how many parts a table's rows are dealt by a key: one for each core, and more where they would hold over PART_BYTES."""
    where, system = _path(spark, path)
    return max(spark.sparkContext.defaultParallelism, math.ceil(system.getContentSummary(where).getLength() / PART_BYTES))


def kept_by_zone(spark: SparkSession, name: str, zones: list[str], sources: list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
    """As kept, for rows with a zone: those of zones that aren't written yet are made together, each in its folder."""
    at = [state(spark, s) for s in sources]
    keys = {z: (spark.sparkContext.applicationId, name, z, *at) for z in zones}
    if missing := [z for z in zones if keys[z] not in _WRITTEN]:
        path, rows = f"{shared_folder(spark)}/lekhani-table-{uuid.uuid4().hex}", make(missing)
        if "term" in rows.columns:
            # Equal terms side by side are stored small; sorting by one number is far cheaper than by zone and term.
            place = F.element_at(F.create_map(*(F.lit(x) for i, z in enumerate(sorted(missing)) for x in (z, i))), F.col("zone"))
            order = F.shiftleft(place.cast("long"), 59).bitwiseOR(F.shiftrightunsigned(F.xxhash64("term"), 5))
            rows = rows.withColumn("order", order).sortWithinPartitions("order").drop("order")
        rows.write.partitionBy("zone").option("compression", "zstd").parquet(path)
        # A zone without rows has no folder; the rows' form is kept for it.
        rows.where(F.lit(False)).drop("zone").write.parquet(f"{path}/none")
        for z in missing:
            where, system = _path(spark, f"{path}/zone={z}")
            _WRITTEN[keys[z]] = f"{path}/zone={z}" if system.exists(where) else f"{path}/none"
    out = None
    for z in zones:
        rows = spark.read.parquet(_WRITTEN[keys[z]]).select(F.lit(z).alias("zone"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def settled(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows, written: read more than once they aren't made again, and Spark knows their size."""
    path = f"{shared_folder(spark)}/lekhani-table-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    _WRITTEN[spark.sparkContext.applicationId, "settled", path] = path
    return spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all kept tables of this session."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        where, system = _path(spark, _WRITTEN.pop(key))
        system.delete(where, True)
