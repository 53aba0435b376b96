"""Where intermediate tables go: the folder of spark.checkpoint.dir, our own only where it is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strophe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in that folder, which is smaller than a checkpoint; the shuffles that led to it are dropped. It goes when the session ends."""
    spark = df.sparkSession
    path, clean = f"{folder(spark)}/strophe-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: str | list[str], name: str = "rank", by: str | None = None) -> DataFrame:
    """Each row's place (from 0) in the order, of all rows or of those of equal `by`, without a window over them.

    Rows go to ranges of the order, are numbered inside, and shifted by the totals of earlier ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([by] if by else []), *([order] if isinstance(order, str) else order)]
    group = [by] if by else []
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id()}))
    counts = placed.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__in").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", *group, "__first", before.alias("__before"))
    starts = starts if by else F.broadcast(starts)  # one row for each range, or for each group in a range
    return placed.join(starts, ["__part", *group]).withColumn(name, F.col("__before") + F.col("__in") - F.col("__first")).drop("__part", "__in", "__first", "__before")


def cumulated(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of `value` over all rows up to each in the order, without a window over all of them; `order` has no ties."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))  # a row for each range
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order))
    starts = F.broadcast(totals.select("__part", before.alias("__before")))
    return placed.join(starts, "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before")
