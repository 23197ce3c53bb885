"""Session helpers: scratch tables, bounded small sides."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="flowlens-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch root; no two calls return the same one."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts the lineage and survives the loss of executors, unlike a cache.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """Write ``df`` once, dealt by ``key`` into as many buckets as a shuffle has partitions, and return the written table.

    What groups or joins it by ``key`` shuffles the other side only. The name leaves the catalog at once; the files stay.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(table)
    written = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return written


#: Rows of a partition that a learner reads: the least, the most, and how many partitions lie between.
LEAST_ROWS, MOST_ROWS, USUAL_PARTITIONS = 2_500, 1_000_000, 200


def layout_partitions(rows: int) -> int:
    """Partitions for so many training rows, whatever the cluster: up to 200 of 2,500 rows, then 200 that
    grow to a million rows each, then more of that size."""
    each = min(max(rows // USUAL_PARTITIONS, LEAST_ROWS), MOST_ROWS)
    return max(1, -(-rows // each))


def laid_out(df: DataFrame, keys: list[str] | None = None, partitions: Callable[[int], int] | int = layout_partitions) -> DataFrame:
    """The same rows in the same partitions and order, however they were laid out before.

    Learners that draw or average per partition then give the same model on any cluster. The number of
    partitions follows from the number of rows, which are counted unless it is given. Rows are dealt out by ``keys``, which do not come back, or by
    all their values without any; equal rows may change places.
    """
    place = F.xxhash64(*[column(c) for c in keys or df.columns])
    number = partitions if isinstance(partitions, int) else partitions(df.count())
    placed = df.withColumn("_place", place).repartition(number, "_place")
    return placed.sortWithinPartitions("_place").drop("_place", *(keys or []))


def spread(df: DataFrame) -> DataFrame:
    """The same rows over a task for each core at least, for work that takes long for each row: a short table may lie in a single file."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


# Models fitted side by side; each fit is itself spread over the executors.
SIDE_BY_SIDE = 4


def side_by_side(spark: SparkSession, tasks: dict) -> dict:
    """Run independent fits from a few driver threads; results under the tasks' names."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(task)) for name, task in tasks.items()}
        return {name: future.result() for name, future in running.items()}


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``max_rows`` rows, else ``df`` unchanged.

    At most ``max_rows + 1`` rows reach the driver. Beyond the bound the caller's join is an
    ordinary shuffle join over the same rows.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    if table.num_rows == 0:
        return F.broadcast(df.sparkSession.createDataFrame([], df.schema))
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that must be small; raise rather than truncate when it is not."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return rows


def quoted(name: str) -> str:
    """A column name in backticks, for names with blanks, dots or slashes."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))
