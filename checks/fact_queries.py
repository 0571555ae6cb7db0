"""Queries for fact and dimension maintenance and the map and rate reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import NOW, Frames, first_by, query
from fieldtally import schemas as M
from fieldtally.operators import merge as G
from fieldtally.plans import maps as PM
from fieldtally.plans import shiny as PH
from fieldtally.plans.selection import FactSelection, map_report, rate_report
from fieldtally.session import scratch_dir
from fieldtally.sources import tables as ST

# --- G: maintenance. The stored half is the rows with an even arrival, the batch the others ---------------


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("arrival") % 2 == 0), rows.where(F.col("arrival") % 2 == 1)


def merged(f: Frames, name: str, keep: str) -> DataFrame:
    rows = f.fact_rows(name)
    if name == "sighting_facts":
        rows = _sightings_with_arrival(f)
    old, new = halves(rows)
    if name == "sighting_facts":
        old, new = old.drop("arrival"), new.drop("arrival")
    empty = f.spark.createDataFrame([], M.FACT_SCHEMAS[name])
    stored = G.merge_facts(empty, old, M.FACT_KEYS[name], keep)
    return G.merge_facts(stored, new, M.FACT_KEYS[name], keep)


def _sightings_with_arrival(f: Frames) -> DataFrame:
    events = f.events("sightings")
    return G.sighting_fact_rows(events.where("arrival % 2 = 0")).withColumn("arrival", F.lit(0)).unionByName(
        G.sighting_fact_rows(events.where("arrival % 2 = 1")).withColumn("arrival", F.lit(1))
    )


@query(
    "G1_sighting_facts",
    first_by(
        "sighting_rows", "day_date, spawnpoint, seen_at",
        "day_date, spawnpoint, seen_at, species, form, iv, level, area_id",
        "arrival % 2, lat, lon, species, form, iv, level, area_id",
    ),
)
def g1(f: Frames) -> DataFrame:
    return merged(f, "sighting_facts", "first")


for _id, _name, _rows, _key, _columns, _order, _keep in (
    ("G2_raid_facts", "raid_facts", "raid_rows", "day_date, gym, seen_at",
     "day_date, gym, seen_at, boss, level, form, team, costume, exclusive, ex_eligible, area_id", "arrival % 2 DESC, arrival DESC", "last"),
    ("G3_quest_item_facts", "quest_item_facts", "quest_item_rows", "day_date, pokestop, seen_at, mode",
     "day_date, pokestop, seen_at, mode, area_id, task_type, item_id, item_amount", "arrival % 2, arrival", "first"),
    ("G4_quest_creature_facts", "quest_creature_facts", "quest_creature_rows", "day_date, pokestop, seen_at, mode",
     "day_date, pokestop, seen_at, mode, area_id, task_type, poke_id, poke_form", "arrival % 2, arrival", "first"),
    ("G5_invasion_facts", "invasion_facts", "invasion_rows", "day_date, pokestop, seen_at",
     "day_date, pokestop, seen_at, display_type, character_id, grunt, confirmed, area_id", "arrival % 2, arrival", "first"),
):

    @query(_id, first_by(_rows, _key, _columns, _order))
    def maintained(f: Frames, name: str = _name, keep: str = _keep) -> DataFrame:
        return merged(f, name, keep)


_SHIFT = "CASE WHEN arrival % 2 = 1 AND arrival % 3 = 0 THEN {c} + 0.25 ELSE {c} END"
for _id, _name, _rows, _key, _names in (
    ("G6_spawnpoints", "spawnpoints", "sighting_rows", "spawnpoint", ""),
    ("G7_gyms", "gyms", "raid_rows", "gym", "gym_name, "),
    ("G8_pokestops", "pokestops", "stop_rows", "pokestop", "pokestop_name, "),
):

    @query(
        _id,
        first_by(
            f"(SELECT {_key}, {_names}{_SHIFT.format(c='lat')} AS lat, lon, arrival FROM {_rows})", _key,
            f"{_key}, {_names}lat, lon", "arrival % 2 DESC, arrival DESC, lat, lon",
        ),
    )
    def upserted(f: Frames, name: str = _name, key: str = _key) -> DataFrame:
        rows = f.point_rows(name).withColumn("lat", F.expr(_SHIFT.format(c="lat")))
        old, new = halves(rows)
        schema = {"spawnpoints": M.SPAWNPOINTS, "gyms": M.GYMS, "pokestops": M.POKESTOPS}[name]
        stored = G.upsert_points(f.spark.createDataFrame([], schema), old, key)
        return G.upsert_points(stored, new, key)


@query("G9_shiny_months", "SELECT * FROM shiny_months")
def g9(f: Frames) -> DataFrame:
    old, new = halves(f.events("sightings"))
    return G.accumulate_shiny(G.shiny_counts(old), new)


@query(
    "G9_shiny_months_long_names",
    """SELECT month_year, concat(repeat('u', 300), username) AS username, species, concat(repeat('f', 20), form) AS form, shiny, area_id, total_count
       FROM shiny_months""",
)
def g9_long(f: Frames) -> DataFrame:
    """Users and forms that differ only after hundreds of equal characters stay apart."""
    events = f.events("sightings").withColumns({"username": F.concat(F.lit("u" * 300), "username"), "form": F.concat(F.lit("f" * 20), "form")})
    return G.shiny_counts(events)


@query("G7_gyms_long_names", "SELECT gym, concat(repeat('g', 300), gym_name) AS gym_name, lat, lon FROM gyms")
def g7_long(f: Frames) -> DataFrame:
    events = f.events("raids").withColumn("gym_name", F.concat(F.lit("g" * 300), "gym_name"))
    return G.upsert_points(f.spark.createDataFrame([], M.GYMS), G.raid_fact_rows(events), "gym")


@query(
    "G10_register_areas",
    """SELECT CAST(CASE WHEN n_nationkey < 5 THEN n_nationkey ELSE 4 + row_number() OVER (ORDER BY n_nationkey < 5, name) END AS INT)
              AS area_id, name AS area
       FROM (SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name ELSE concat('New ', n_name) END AS name FROM nation)""",
)
def g10(f: Frames) -> DataFrame:
    """Five known areas; the known names come again in other case, the others with stray spaces."""
    known = f.areas.where("area_id < 5").select("area_id", "area")
    names = f.areas.select(
        F.when(F.col("area_id") < 5, F.lower("area")).otherwise(F.concat(F.lit("  New   "), "area", F.lit(" "))).alias("area")
    )
    return G.register_areas(known, names)


# --- H: reports ------------------------------------------------------------------------------------------

FROM, TO = datetime(2024, 1, 3, 6), datetime(2024, 2, 8, 18)
AREA = 24
SEEN = f"""area_id = {AREA} AND day_date BETWEEN DATE '2024-01-03' AND DATE '2024-02-08'
    AND seen_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"""


def heatmap_sql(where: str = "true", limit: int = 0) -> str:
    days = f"""SELECT day_date, f.spawnpoint, species, form, lat, lon, count(*) AS cnt
        FROM sighting_facts f JOIN spawnpoints s USING (spawnpoint) WHERE {SEEN} AND {where} GROUP BY ALL"""
    days = top_sql(days, limit, "species, spawnpoint, form")
    return f"""SELECT spawnpoint, species, form, min(lat) AS lat, min(lon) AS lon, CAST(sum(cnt) AS BIGINT) AS cnt
        FROM ({days}) GROUP BY ALL"""


def top_sql(days: str, limit: int, order: str) -> str:
    if not limit:
        return days
    rank = f"row_number() OVER (PARTITION BY day_date ORDER BY cnt DESC, {order})"
    return f"SELECT * FROM (SELECT *, {rank} AS rn FROM ({days})) WHERE rn <= {limit}"


def named_map_sql(facts: str, dim: str, key: str, name: str, dims: str, join: str, order: str, where: str = "true", limit: int = 0) -> str:
    days = f"""SELECT day_date, {key}, {name}, {dims}, lat, lon, count(*) AS cnt
        FROM {facts} f {join} {dim} d USING ({key}) WHERE {SEEN} AND {where} GROUP BY ALL"""
    return f"""SELECT coalesce({name}, 'None') AS {name}, {dims}, arg_min(lat, {key}) AS lat, arg_min(lon, {key}) AS lon,
               CAST(sum(cnt) AS BIGINT) AS cnt FROM ({top_sql(days, limit, order)}) GROUP BY ALL"""


def _heatmap(f: Frames, filters=None, limit=0) -> DataFrame:
    return PM.sighting_heatmap(f.facts("sighting_facts"), f.points("spawnpoints"), AREA, FROM, TO, filters, limit)


@query("H1_sighting_heatmap", heatmap_sql())
def h1(f: Frames) -> DataFrame:
    return _heatmap(f)


@query("H1_sighting_heatmap_filtered", heatmap_sql("form IN ('0', '2') AND (iv >= 60 OR iv = 0) AND level >= 10 AND level <= 35"))
def h1_filtered(f: Frames) -> DataFrame:
    return _heatmap(f, {"form": "0,2", "iv": ">=60,==0", "level_range": (10, 35)})


@query("H1_sighting_heatmap_top", heatmap_sql(limit=5))
def h1_top(f: Frames) -> DataFrame:
    return _heatmap(f, limit=5)


_RAID = ("raid_facts", "gyms", "gym", "gym_name", "boss, form, level", "JOIN", "boss, gym, form, level")
_INVASION = ("invasion_facts", "pokestops", "pokestop", "pokestop_name", "display_type, character_id", "JOIN", "display_type, pokestop, character_id")


@query("H2_raid_map", named_map_sql(*_RAID))
def h2(f: Frames) -> DataFrame:
    return PM.raid_map(f.facts("raid_facts"), f.points("gyms"), AREA, FROM, TO)


@query("H2_raid_map_filtered_top", named_map_sql(*_RAID, where="level IN (1, 3, 5) AND exclusive = 0 AND costume = '0'", limit=3))
def h2_top(f: Frames) -> DataFrame:
    filters = {"level": "1,3,5", "exclusive": "0", "costume": "0"}
    return PM.raid_map(f.facts("raid_facts"), f.points("gyms"), AREA, FROM, TO, filters, 3)


@query("H3_invasion_map", named_map_sql(*_INVASION))
def h3(f: Frames) -> DataFrame:
    return PM.invasion_map(f.facts("invasion_facts"), f.points("pokestops"), AREA, FROM, TO)


@query("H3_invasion_map_filtered_top", named_map_sql(*_INVASION, where="confirmed = 1", limit=4))
def h3_top(f: Frames) -> DataFrame:
    return PM.invasion_map(f.facts("invasion_facts"), f.points("pokestops"), AREA, FROM, TO, {"confirmed": "1"}, 4)


for _id, _kind, _plan, _filter, _where in (
    ("H4_quest_item_map", "quest_item_facts", PM.quest_item_map, {"ar_item_ids": "4,10,16,22"},
     "(mode = 1 AND item_id IN (4, 10, 16, 22))"),
    ("H5_quest_creature_map", "quest_creature_facts", PM.quest_creature_map, {"ar_task_types": "2,4,6,8", "mode": "1"},
     "mode = 1 AND task_type IN (2, 4, 6, 8)"),
):
    _spec = (_kind, "pokestops", "pokestop", "pokestop_name", "mode, task_type", "LEFT JOIN", "pokestop, mode, task_type")

    @query(_id, named_map_sql(*_spec))
    def quest_map(f: Frames, kind: str = _kind, plan=_plan) -> DataFrame:
        return plan(f.facts(kind), f.points("pokestops"), AREA, FROM, TO)

    @query(f"{_id}_filtered_top", named_map_sql(*_spec, where=_where, limit=2))
    def quest_map_top(f: Frames, kind: str = _kind, plan=_plan, filters: dict = _filter) -> DataFrame:
        return plan(f.facts(kind), f.points("pokestops"), AREA, FROM, TO, filters, 2)


def shiny_sql(where: str = "true", having: str = "true", tail: str = "") -> str:
    return f"""SELECT species, form, round(avg(s / n) * 100, 4) AS shiny_pct_macro, round(sum(s) / sum(n) * 100, 4) AS shiny_pct_pooled,
               CAST(count(*) AS BIGINT) AS users_contributing, CAST(sum(n) AS BIGINT) AS total_encounters
        FROM (SELECT species, form, username, sum(total_count) AS n, sum(CASE WHEN shiny = 1 THEN total_count ELSE 0 END) AS s
              FROM shiny_months WHERE {where} GROUP BY ALL HAVING {having}) GROUP BY ALL {tail}"""


@query("H6_shiny_rates", shiny_sql("month_year BETWEEN 2401 AND 2402"))
def h6(f: Frames) -> DataFrame:
    return PH.shiny_rates(G.shiny_counts(f.events("sightings")), 2401, 2402)


@query(
    "H6_shiny_rates_filtered",
    shiny_sql("month_year = 2401 AND username IN ('user_1', 'user_2', 'user_3', 'user_7', 'user_9') AND form IN ('0', '1')", "n >= 2"),
)
def h6_filtered(f: Frames) -> DataFrame:
    return PH.shiny_rates(
        G.shiny_counts(f.events("sightings")), 2401, 2401, users="USER_1,user_2,User_3,user_7,user_9", forms="0,1", min_user_n=2
    )


@query("H6_shiny_rates_limited", shiny_sql("month_year BETWEEN 2312 AND 2402", tail="ORDER BY species, form, shiny_pct_macro DESC LIMIT 40"))
def h6_limited(f: Frames) -> DataFrame:
    return PH.shiny_rates(G.shiny_counts(f.events("sightings")), 2312, 2402, limit=40)


# --- windows as texts ------------------------------------------------------------------------------------


def _stored_facts(f: Frames, name: str) -> DataFrame:
    path = scratch_dir(f.spark, name)
    ST.write_facts(f.facts(name), path)
    return ST.read_facts(f.spark, path, name)


def _asked(f: Frames, start: str, end: str, **filters) -> FactSelection:
    return FactSelection(f.areas, "NATION_24", start, end, NOW, filters)


_WINDOWS = {
    "H1_window_month_to_yesterday": ("202401", "yesterday", "2024-01-01 00:00:00", "2024-02-19 00:00:00"),
    "H1_window_days_to_today": ("30 days", "today", "2024-01-21 12:00:00", "2024-02-20 00:00:00"),
}
for _id, (_start, _end, _low, _high) in _WINDOWS.items():

    @query(_id, heatmap_sql().replace(SEEN, f"area_id = {AREA} AND seen_at BETWEEN TIMESTAMP '{_low}' AND TIMESTAMP '{_high}'"))
    def window_heatmap(f: Frames, start: str = _start, end: str = _end) -> DataFrame:
        return map_report(PM.sighting_heatmap, _stored_facts(f, "sighting_facts"), f.points("spawnpoints"), _asked(f, start, end))


@query("H6_window_months", shiny_sql("month_year BETWEEN 2401 AND 2402"))
def window_rates(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "months")
    ST.write_months(G.shiny_counts(f.events("sightings")), path)
    months = ST.read_table(f.spark, path, M.SHINY_MONTHS)
    return rate_report(PH.shiny_rates, months, FactSelection(f.areas, "global", "2024-01", "today", NOW))
