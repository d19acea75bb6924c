"""Written intermediate tables, gapless numbers and running sums over rows that no task holds alone."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION_MASK = (1 << 33) - 1  # the bits of monotonically_increasing_id() below the partition's number

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only a local session without one, as in tests, gets a temporary folder; on a cluster its
    absence is an error, as executors could not see each other's files.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors and fixes whatever depends on the physical
    layout (partition numbers, positions).  The files go with ``discard``, at the end of a
    ``scratch`` block, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._tm_path = path
    return table


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; what is written there goes as the tables of ``materialise`` do."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` returned and that nothing reads any more."""
    for entry in [x for x in _written if x[1] == table._tm_path]:
        _written.remove(entry)
        _delete(*entry)


def release() -> None:
    """Delete the tables that ``materialise`` wrote, and the folders of ``folder``."""
    while _written:
        _delete(*_written.pop())


@contextmanager
def scratch() -> Iterator[Callable]:
    """Tables and folders that are made inside go when the block ends, but for those that are given to the function it yields."""
    before, kept = len(_written), set()

    def keep(table):  # noqa: ANN001, ANN202
        kept.add(table if isinstance(table, str) else table._tm_path)
        return table

    try:
        yield keep
    finally:
        for entry in _written[before:]:
            if entry[1] not in kept:
                _written.remove(entry)
                _delete(*entry)


atexit.register(release)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, label: str) -> DataFrame:
    """Add the gapless number (from 0) of each row within its group, in the given order.

    No group is held in one task: the rows are range-partitioned and sorted, written once,
    and each (group, partition) gets an offset from a small table of counts, which has at
    most one row per group plus one per partition.  Rows that tie in ``order`` are numbered
    in the order in which they were written.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    sorted_rows = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    table = materialise(
        sorted_rows.withColumn("_tm_pid", F.spark_partition_id()).withColumn("_tm_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK))),
        label,
    )
    counts = table.groupBy(*group, "_tm_pid").agg(F.min("_tm_pos").alias("_tm_first"), F.count(F.lit(1)).alias("_tm_n"))
    before = Window.partitionBy(*group).orderBy("_tm_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_tm_base", F.coalesce(F.sum("_tm_n").over(before), F.lit(0)) - F.col("_tm_first")).drop("_tm_first", "_tm_n")
    return table.join(offsets, [*group, "_tm_pid"]).withColumn(name, F.col("_tm_pos") + F.col("_tm_base")).drop("_tm_pid", "_tm_pos", "_tm_base")


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], label: str) -> DataFrame:
    """Add, for each column of ``sums``, its sum over the rows before this one in the given order, under the new name.

    As in ``numbered`` no task holds all rows: sums run within range partitions, and a table of
    one row per partition gives what lies before them.  ``order`` must not tie.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(partitions(spark), *order).withColumn("_tm_pid", F.spark_partition_id())
    table = materialise(spread, label)
    totals = table.groupBy("_tm_pid").agg(*[F.sum(c).alias(f"_tm_{n}") for c, n in sums.items()])
    earlier = Window.orderBy("_tm_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_tm_pid", *[F.coalesce(F.sum(f"_tm_{n}").over(earlier), F.lit(0)).alias(f"_tm_{n}") for n in sums.values()])
    within = Window.partitionBy("_tm_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = table.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for c, n in sums.items()]).join(offsets, "_tm_pid")
    return rows.withColumns({n: F.col(n) + F.col(f"_tm_{n}") for n in sums.values()}).drop("_tm_pid", *[f"_tm_{n}" for n in sums.values()])
