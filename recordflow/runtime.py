"""Session-level helpers: sessions, shared scratch space, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Row bound under which a side table may be broadcast.
BROADCAST_ROWS = 200_000


def local_session(cores: str = "8", app: str = "recordflow") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Larger generated methods are not compiled by HotSpot; Spark then runs operators one by one.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own. A cluster
    session without it is an error: a machine-local folder would not survive executor loss.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="recordflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, the plan starts
    anew, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def distributed_rank(df: DataFrame, order_by: list[str], out: str) -> DataFrame:
    """Row number from 1 over the whole table, without moving it into one task.

    Range partitions are written once with their number; ranks count inside each partition and are
    shifted by the sizes of the partitions before it (one row per partition).
    """
    ranged = df.repartitionByRange(*order_by).withColumn("_pid", F.spark_partition_id())
    stored = cut_lineage(ranged, "rank")
    sizes = stored.groupBy("_pid").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_pid").orderBy(*order_by)
    return (
        stored.join(F.broadcast(shifts), "_pid")
        .withColumn(out, (F.row_number().over(inside) + F.col("_shift")).cast("bigint"))
        .drop("_pid", "_shift")
    )


def rank_in_groups(df: DataFrame, group: list[str], order_by: list[str], out: str) -> DataFrame:
    """Row number from 1 inside each group, a hot group being spread over many range partitions.

    Partitions are stored with their number; ranks count inside (partition, group) and are shifted by
    the group's sizes in the partitions before. ``group`` columns hold no nulls.
    """
    ranged = df.repartitionByRange(*group, *order_by).withColumn("_pid", F.spark_partition_id())
    stored = cut_lineage(ranged, "ranges")
    sizes = stored.groupBy("_pid", *group).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_pid", *group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_pid", *group).orderBy(*order_by)
    return (
        stored.join(shifts, ["_pid", *group])
        .withColumn(out, (F.row_number().over(inside) + F.col("_shift")).cast("bigint"))
        .drop("_pid", "_shift")
    )


def by_shuffle(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast. Spark's size estimate does not see the rows that ``inline`` and
    ``explode`` make, nor how far files were compressed, so a large side may look small to it."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks. A small file of many rows is one or two splits, so heavy work on
    each row would take as many tasks only; adaptive execution fits the number of partitions to the data."""
    return df.hint("rebalance")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``max_rows`` rows.

    Runs one bounded count. A larger side is returned unhinted and joins by shuffle.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
