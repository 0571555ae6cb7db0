"""Tables as they are stored: the one-pass build, retention on folders, snapshots that write what changed."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import NOW, Frames, query
from checks.payload_files import write_payloads
from checks.report_queries import ALL_ROLLUPS_SQL, all_facts, all_facts_sql, all_rollups
from fieldtally.operators import build as BD
from fieldtally.operators import merge as G
from fieldtally.operators import retention as RT
from fieldtally.schemas import SHINY_MONTHS
from fieldtally.session import scratch_dir
from fieldtally.sources import tables as ST
from fieldtally.sources.payloads import read_payloads
from fieldtally.sources.storage import remove


def built(f: Frames) -> str:
    path, payloads = scratch_dir(f.spark, "built"), write_payloads(f)
    BD.build_all(read_payloads(f.spark, payloads), f.areas, path)
    remove(f.spark, [payloads])
    return path


@query("E_build_all", ALL_ROLLUPS_SQL)
def build_all_rollups(f: Frames) -> DataFrame:
    """All 21 rollups from payload files, which are read and parsed once."""
    path = built(f)
    return all_rollups(lambda family, grain: ST.read_rollup(f.spark, f"{path}/{family}/{grain}"))


@query(
    "G_build_all",
    f"""{all_facts_sql()} UNION ALL SELECT 'spawnpoints', CAST(spawnpoint AS VARCHAR), concat_ws('|', CAST(lat AS VARCHAR), CAST(lon AS VARCHAR)) FROM spawnpoints
    UNION ALL SELECT 'gyms', gym, concat_ws('|', gym_name, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR)) FROM gyms
    UNION ALL SELECT 'pokestops', pokestop, concat_ws('|', pokestop_name, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR)) FROM pokestops
    UNION ALL SELECT 'months', concat_ws('|', CAST(month_year AS VARCHAR), username, CAST(species AS VARCHAR), form, CAST(shiny AS VARCHAR), CAST(area_id AS VARCHAR)), CAST(total_count AS VARCHAR) FROM shiny_months""",
)
def build_all_facts(f: Frames) -> DataFrame:
    """The same build's facts, points and monthly counts."""
    path = built(f)
    out = all_facts(lambda name: ST.read_facts(f.spark, f"{path}/{name}", name))
    for name, (key, schema) in BD.POINTS.items():
        rows = ST.read_table(f.spark, f"{path}/{name}", schema)
        out = out.unionByName(rows.select(F.lit(name).alias("name"), F.col(key).cast("string").alias("fact"), F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns if c != key]).alias("held")))
    months = ST.read_table(f.spark, f"{path}/{BD.MONTHS}", SHINY_MONTHS)
    keys = F.concat_ws("|", *[F.col(c).cast("string") for c in months.columns if c != "total_count"])
    return out.unionByName(months.select(F.lit("months").alias("name"), keys.alias("fact"), F.col("total_count").cast("string").alias("held")))


for _id, _family, _grain, _hours in (("J1_drop_minutes", "sightings", "minute", RT.SERIES_HOURS * 5), ("J2_drop_hours", "raids", "hour", RT.HOURLY_HOURS), ("J3_drop_days", "sightings", "day", RT.DAILY_HOURS)):

    @query(_id, f"SELECT * FROM r_{_family}_{_grain} WHERE bucket >= TIMESTAMP '{NOW}' - to_hours({_hours})")
    def dropped(f: Frames, family: str = _family, grain: str = _grain, hours: int = _hours) -> DataFrame:
        """What is left of a stored rollup."""
        path = scratch_dir(f.spark, "rollup")
        ST.write_rollup(f.roll(family, grain), path)
        RT.drop_rollup(f.spark, path, NOW, hours)
        return ST.read_rollup(f.spark, path).drop("day")


@query(
    "J4_drop_days",
    """SELECT *, (SELECT count(DISTINCT day_date) FROM sighting_facts WHERE day_date < DATE '2024-02-06') AS days_gone
       FROM sighting_facts WHERE day_date >= DATE '2024-02-06'""",
)
def drop_days(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "facts")
    ST.write_facts(f.facts("sighting_facts"), path)
    plan = RT.drop_days(f.spark, path, NOW.date(), 15)
    gone = plan.where("action = 'drop'").count()  # one row a day
    return ST.read_facts(f.spark, path, "sighting_facts").withColumn("days_gone", F.lit(gone).cast("bigint"))


@query("J5_drop_months", "SELECT * FROM shiny_months WHERE month_year >= 2402")
def drop_months(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "months")
    ST.write_months(G.shiny_counts(f.events("sightings")), path)
    RT.drop_months(f.spark, path, date(2024, 4, 10), 1, at_least=3)
    return ST.read_table(f.spark, path, SHINY_MONTHS)


@query(
    "J6_stored_plan",
    """SELECT DISTINCT CAST(day_date AS VARCHAR) AS partition, CASE WHEN day_date >= DATE '2024-02-06' THEN 'keep' ELSE 'drop' END AS action
       FROM sighting_facts""",
)
def stored_plan(f: Frames) -> DataFrame:
    """The dry run on a stored table, from the names of its folders."""
    path = scratch_dir(f.spark, "facts")
    ST.write_facts(f.facts("sighting_facts"), path)
    return RT.drop_days(f.spark, path, NOW.date(), 15, dry_run=True)


@query(
    "A8_update_snapshot",
    """SELECT *, CASE WHEN CAST(bucket AS DATE) IN (SELECT CAST(bucket AS DATE) FROM r_sightings_hour WHERE day(bucket) % 7 = 3)
                      THEN TIMESTAMP '2024-02-20 12:00:00' ELSE TIMESTAMP '2024-02-19 12:00:00' END AS backed_up_at FROM r_sightings_hour""",
)
def update_snapshot(f: Frames) -> DataFrame:
    """A day-old snapshot in which some days are wrong is brought up to date; only these days are written."""
    path, current = scratch_dir(f.spark, "snapshot"), f.roll("sightings", "hour")
    wrong = current.withColumn("cnt", F.when(F.dayofmonth("bucket") % 7 == 3, F.col("cnt") + 1).otherwise(F.col("cnt")))
    ST.update_snapshot(f.spark, path, wrong, 0, datetime(2024, 2, 19, 12))
    ST.update_snapshot(f.spark, path, current, 0, NOW)
    return f.spark.read.parquet(path).drop("day")


@query("A9_restore_since", "SELECT * FROM r_sightings_hour WHERE bucket >= TIMESTAMP '2024-02-01 06:00:00'")
def restore_since(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "snapshot")
    ST.write_snapshot(ST.snapshot_rollups(f.roll("sightings", "hour"), None, 0, NOW), path)
    return ST.restore_rollups(f.spark, path, datetime(2024, 2, 1, 6))
