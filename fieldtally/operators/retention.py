"""Retention as filters, and on stored tables.

On partitioned tables the filters prune whole partitions. The functions on paths remove folders of expired partitions, which
they find by name: kept partitions are neither read nor written.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.predicates import ntz, where_days
from fieldtally.functions.timewindow import shift_months, yymm_of
from fieldtally.session import scratch_dir
from fieldtally.sources.storage import Folder, partitions, remove

SERIES_HOURS = 72
HOURLY_HOURS = 168
DAILY_HOURS = 30 * 24
FACT_DAYS = 15


def expire_rollup(rollup: DataFrame, now: datetime, keep_hours: int = 0) -> DataFrame:
    """Rollup rows not older than ``keep_hours``; 0 keeps all."""
    first = ntz(now - timedelta(hours=keep_hours))
    return rollup if keep_hours == 0 else where_days(rollup, first, None).where(F.col("bucket") >= first)


def _kept(n: int, at_least: int) -> int:
    if n < 1:
        raise ValueError("at least the current day or month is kept")
    return max(n, at_least)


def first_kept_day(today: date, n: int, at_least: int = 1) -> date:
    """Start of the last ``n`` days, today included; ``at_least`` is a floor for a configured ``n``."""
    return today - timedelta(days=_kept(n, at_least) - 1)


def first_kept_month(today: date, n: int, at_least: int = 1) -> int:
    """YYMM of the first of the last ``n`` months, the current one included; ``at_least`` as for days."""
    first = datetime(today.year, today.month, 1)
    return yymm_of(shift_months(first, 1 - _kept(n, at_least)))


def keep_days(facts: DataFrame, today: date, n: int = FACT_DAYS, at_least: int = 1) -> DataFrame:
    return facts.where(F.col("day_date") >= F.lit(first_kept_day(today, n, at_least)))


def keep_months(months: DataFrame, today: date, n: int, at_least: int = 1) -> DataFrame:
    return months.where(F.col("month_year") >= first_kept_month(today, n, at_least))


def retention_plan(df: DataFrame, today: date, n: int, unit: str) -> DataFrame:
    """Dry run: every stored partition with ``keep`` or ``drop``. ``unit`` is ``day`` or ``month``."""
    if unit not in ("day", "month"):
        raise ValueError("unit must be 'day' or 'month'")
    col = "day_date" if unit == "day" else "month_year"
    first = F.lit(first_kept_day(today, n)) if unit == "day" else F.lit(first_kept_month(today, n))
    return df.select(col).distinct().select(
        F.col(col).cast("string").alias("partition"), F.when(F.col(col) >= first, "keep").otherwise("drop").alias("action")
    )


def expire_snapshot(
    snapshot: DataFrame, now: datetime, retention_hours: int, interval_s: int | None = None
) -> DataFrame:
    """Snapshot clean-up.

    Counter rows go by their bucket. Series rows (``interval_s`` given) go by their last refresh, with
    two snapshot intervals and an hour of grace. A retention of 0 keeps everything.
    """
    if retention_hours == 0:
        return snapshot
    if interval_s is None:
        return expire_rollup(snapshot, now, retention_hours)
    grace = 2 * interval_s // 3600 + 1
    return snapshot.where(F.col("backed_up_at") >= ntz(now - timedelta(hours=retention_hours + grace)))


def _settle(spark: SparkSession, found: list[Folder], expired: set[str], dry_run: bool) -> DataFrame:
    """One row per partition value with ``keep`` or ``drop``; unless it is a dry run, the dropped ones are gone by then."""
    if not dry_run:
        remove(spark, [folder.path for folder in found if folder.value in expired])
    rows = [(value, "drop" if value in expired else "keep") for value in sorted({folder.value for folder in found})]
    return spark.createDataFrame(rows, "partition string, action string")


def drop_days(spark: SparkSession, path: str, today: date, n: int = FACT_DAYS, at_least: int = 1, column: str = "day_date", dry_run: bool = False) -> DataFrame:
    """Remove the stored days before the last ``n``, of a table or of its (folded) deltas; a second call finds none."""
    first = first_kept_day(today, n, at_least).isoformat()
    found = partitions(spark, path, column)
    return _settle(spark, found, {f.value for f in found if f.value < first}, dry_run)


def drop_months(spark: SparkSession, path: str, today: date, n: int, at_least: int = 1, dry_run: bool = False) -> DataFrame:
    """Remove the stored months before the last ``n``."""
    first = first_kept_month(today, n, at_least)
    found = partitions(spark, path, "month_year")
    return _settle(spark, found, {f.value for f in found if f.value.isdigit() and int(f.value) < first}, dry_run)


def drop_rollup(spark: SparkSession, path: str, now: datetime, keep_hours: int, dry_run: bool = False) -> DataFrame:
    """Remove the rows of a rollup stored by day that are older than ``keep_hours``; 0 keeps all.

    Days that are wholly older go as folders. Of the day in which the limit lies, the younger rows are written anew, unless
    it has no older ones; the other days are not touched.
    """
    limit = now - timedelta(hours=keep_hours)
    found = partitions(spark, path, "day")
    border = limit.date().isoformat()
    expired = {f.value for f in found if f.value < border} if keep_hours else set()
    out = _settle(spark, found, expired, dry_run)
    if keep_hours and not dry_run and any(f.value == border for f in found):
        day = spark.read.parquet(path).where(F.col("day") == F.lit(limit.date()))
        if not day.where(F.col("bucket") < ntz(limit)).isEmpty():
            kept = scratch_dir(spark, "kept")
            day.where(F.col("bucket") >= ntz(limit)).write.parquet(kept)
            left = spark.read.schema(day.schema).parquet(kept)
            if left.isEmpty():
                remove(spark, [f.path for f in found if f.value == border])
            else:
                left.sortWithinPartitions("area", "bucket").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return out
