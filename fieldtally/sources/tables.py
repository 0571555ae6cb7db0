"""Partitioned tables: facts by day, monthly table by month, rollup snapshots, JSON reports."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from fieldtally import schemas as M
from fieldtally.functions.predicates import ntz, where_days
from fieldtally.session import scratch_dir


def partitioned(df: DataFrame, by: str, sort: list[str]):
    """Writer whose files follow the partitions.

    The rebalance hint lets adaptive execution split a heavy partition over several tasks and join
    light ones; sorting within tasks gives useful row-group statistics.
    """
    placed = df.hint("rebalance", F.col(by)).sortWithinPartitions(by, *sort)
    return placed.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")


def write_facts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Day-partitioned facts. ``overwrite`` replaces only the days present in ``df``."""
    partitioned(df, "day_date", [c for c in df.columns if c == "area_id"]).mode(mode).parquet(path)


def write_months(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Month-partitioned accumulation table; same overwrite rule."""
    partitioned(df, "month_year", ["area_id"]).mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table with its declared column order; an absent path is an empty table."""
    empty = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path).select(*empty.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def read_facts(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_table(spark, path, M.FACT_SCHEMAS[name])


def write_rollup(rollup: DataFrame, path: str) -> None:
    """A rollup in day partitions, sorted by area and bucket, under a new path. Windows over it prune whole days."""
    rows = rollup.withColumn("day", F.col("bucket").cast("date")).hint("rebalance", F.col("day"))
    placed = rows.sortWithinPartitions("day", "area", "bucket")
    placed.write.partitionBy("day").option("compression", "zstd").mode("errorifexists").parquet(path)


def read_rollup(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A stored rollup with its ``day``, which window filters use and reports leave out. One without rows has no files to
    take a schema from; ``schema`` (without the day) makes it an empty frame."""
    return spark.read.parquet(path) if schema is None else spark.read.schema(StructType([*schema.fields, StructField("day", DateType())])).parquet(path)


def snapshot_rollups(
    current: DataFrame, previous: DataFrame | None, retention_hours: int, now: datetime, key: tuple[str, ...] = ("area", "bucket")
) -> DataFrame:
    """Rows of the next snapshot.

    Current rows inside the retention (0 keeps all: weekly and monthly rollups) replace the stored rows
    that share their key; other stored rows stay. ``backed_up_at`` tells when a row was last seen.
    """
    rows = current
    if retention_hours > 0:
        rows = current.where(F.col("bucket") >= ntz(now - timedelta(hours=retention_hours)))
    fresh = rows.withColumn("backed_up_at", ntz(now))
    if previous is None:
        return fresh
    kept = previous.join(rows.select(*key).distinct(), list(key), "left_anti").select(*fresh.columns)
    return kept.unionByName(fresh)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A first snapshot under a new path, in day partitions. Later ones go through :func:`update_snapshot`."""
    partitioned(df.withColumn("day", F.col("bucket").cast("date")), "day", ["area", "bucket"]).mode("errorifexists").parquet(path)


def changed_days(current: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("area", "bucket")) -> list[date]:
    """Days with a key whose rows differ between ``current`` and ``stored``, or that is not stored yet.

    Rows of a key are compared by their number and two sums of their hashes, so that nothing but one row a key is shuffled.
    """
    values = [c for c in current.columns if c not in (*key, "day", "backed_up_at")]

    def digest(rows: DataFrame) -> DataFrame:
        one = F.xxhash64(*values)
        sums = F.struct(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(F.pmod(one, F.lit((1 << 31) - 1))).alias("s"))
        return rows.groupBy(*key).agg(sums.alias("digest"))

    days = current.select(F.col("bucket").cast("date").alias("day")).agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if days["first"] is None:
        return []
    before = digest(stored.where(F.col("day").between(F.lit(days["first"]), F.lit(days["last"])))).withColumnRenamed("digest", "before")
    differ = digest(current).join(before, list(key), "left").where(~F.col("digest").eqNullSafe(F.col("before")))
    return sorted(r["day"] for r in differ.select(F.col("bucket").cast("date").alias("day")).distinct().collect())  # one row a day


def update_snapshot(spark: SparkSession, path: str, current: DataFrame, retention_hours: int, now: datetime, refresh: bool = False) -> list[date]:
    """Bring a stored snapshot up to ``current`` (see :func:`snapshot_rollups`) and return the days that were written.

    Only days in which something changed are written; the files of all others stay, with their ``backed_up_at``, which so
    tells when the day was last written. ``refresh`` writes every day that ``current`` has: for series, which expire by it.
    """
    rows = current if retention_hours == 0 else current.where(F.col("bucket") >= ntz(now - timedelta(hours=retention_hours)))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        fresh = snapshot_rollups(rows, None, 0, now).withColumn("day", F.col("bucket").cast("date"))
        partitioned(fresh, "day", ["area", "bucket"]).mode("overwrite").parquet(path)
        return sorted(r["day"] for r in fresh.select("day").distinct().collect())
    day = F.col("bucket").cast("date")
    days = sorted(r["day"] for r in rows.select(day.alias("day")).distinct().collect()) if refresh else changed_days(rows, stored)
    if days:
        next_rows = snapshot_rollups(rows.where(day.isin(days)), stored.where(F.col("day").isin(days)).drop("day"), 0, now).withColumn("day", day)
        staged = scratch_dir(spark, "snapshot")  # what is read can't be overwritten
        next_rows.write.parquet(staged)
        partitioned(spark.read.schema(next_rows.schema).parquet(staged), "day", ["area", "bucket"]).mode("overwrite").parquet(path)
    return days


def restore_rollups(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The rollup of a snapshot; with ``since`` only its buckets from then on, and only their days are read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = where_days(rows, ntz(since), None).where(F.col("bucket") >= ntz(since))
    return rows.drop("backed_up_at", "day")


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(path)
