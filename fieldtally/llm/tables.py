"""Reading the test tables, written intermediate tables, and numbering rows without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally.session import scratch_dir, scratch_root
from fieldtally.sources.storage import remove


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared scratch folder and read again: it survives lost executors and cuts the lineage."""
    spark = frame.sparkSession
    path = scratch_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these frames, or for those that they read; other folders stay."""
    for frame in frames:
        spark = frame.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
        root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
        folders = {spark._jvm.org.apache.hadoop.fs.Path(file).getParent() for file in frame.inputFiles()}
        remove(spark, sorted({where.toString() for where in folders if where.getParent().toString() == root}))


def running_sums(frame: DataFrame, group: list[str], order: list[str], bucket: Column, value: Column, into: str) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the earlier rows of the row's group.

    ``bucket`` must rise with ``order``. Sums of whole buckets are added up first, so that a window only ever holds the
    rows of one bucket; a group with a third of all rows is as many tasks as it has buckets.
    """
    cut = frame.withColumn("_bucket", bucket).withColumn("_value", value)
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*group, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(group)], F.col("_bucket").alias("_b"), "_base")
    )
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    return (
        cut.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(totals, same)
        .withColumn(into, (F.col("_base") + F.col("_within")).cast("bigint"))
        .drop("_bucket", "_value", "_within", "_b", "_base", *[f"_{i}" for i in range(len(group))])
    )
