"""Intermediate tables in the shared checkpoint folder.

A posting table is read several times by one classification.  It is written
once as Parquet under ``spark.checkpoint.dir`` instead of being cached, so a
lost executor costs a re-read and not a recomputation of the whole corpus, and
later readers still prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_SETTING = "spark.checkpoint.dir"
DATABASE = "labelloom_scratch"
#: Input bytes that one partition of a wide step should get.
TARGET_BYTES = 64 * 1024 * 1024
# what the innermost open scope of this thread has written: (table or None, path)
_written: ContextVar[list[tuple[str | None, str]] | None] = ContextVar("written", default=None)


def _note(table: str | None, path: str) -> None:
    if (open_scope := _written.get()) is not None:
        open_scope.append((table, path))


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder.

    Only a local session may fall back to a folder of its own.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/labelloom/{app}/{name}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """Size of the files and tables that ``df`` reads, from the plan.

    Sources of unknown size (which the planner takes for endless) count as 0.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def width_for(size: int, least: int, target: int = TARGET_BYTES) -> int:
    """Partitions for ``size`` input bytes, never below ``least``."""
    return max(least, -(-size // target))


def shuffle_width(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """Explicit partition count, so that adaptive coalescing (which goes by
    shuffled bytes) cannot starve a step that expands its input.  It follows the
    input's size; the session's setting is the least."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return width_for(input_bytes(df), least, target)


def positions(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order.

    The rows are range-partitioned by the sort and written with their place in
    the partition; only one count per partition is added up in one task.
    """
    at = F.monotonically_increasing_id()  # partition number << 33 | place in it
    rows = materialize(df.orderBy(*order).withColumn("_at", at), "sorted")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    placed = rows.withColumn("_part", part).join(before, "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, place).drop("_part", "_at", "_before")


def widen(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that comes in fewer partitions than there are cores, or most
    of whose rows are in a few of them, so that work before the first shuffle is
    parallel too.

    A file is cut into splits by its bytes, but all rows of a row group go to one
    split; the rows of every partition are counted, which reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        rows = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
        largest, total = rows.agg(F.max("n"), F.sum("n")).first()
        if not total or largest * cores <= 2 * total:
            return df
    return df.repartition(shuffle_width(df), key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader over the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _note(None, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, width: int) -> DataFrame:
    """Write ``df`` in ``width`` buckets by ``key``; readers then join, group and
    window on ``key`` without another shuffle.

    ``df`` should already be spread by ``repartition(width, key)``, so that every
    task writes one bucket.
    """
    spark = df.sparkSession
    table = f"{DATABASE}.{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")
    df.write.bucketBy(width, key).option("path", path).saveAsTable(table)
    _note(table, path)
    return spark.table(table)


@contextmanager
def scope(spark: SparkSession):
    """Delete the intermediate tables written inside the block when it ends.

    For callers that have stored their result by then, such as a run with an
    output path or one micro-batch of a stream.  Every scope knows its own
    tables only, so scopes of several threads do not touch each other's.
    """
    mine: list[tuple[str | None, str]] = []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for table, path in mine:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(folder, True)
