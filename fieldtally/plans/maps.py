"""Map reports over the fact tables.

Facts are counted per day and point first; only the counts are joined with the point dimension.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.predicates import (
    where_all_in, where_between, where_expr, where_in, where_quest_creatures, where_quest_items, where_seen,
)
from fieldtally.operators.joins import attach_point

_SALTS = 32


def top_per_day(rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of each day.

    Ranked in two steps: within random parts of the day, then among the parts' leaders, so that a
    busy day is not ranked by a single task.
    """
    part = Window.partitionBy("day_date", "_part").orderBy(*order)
    day = Window.partitionBy("day_date").orderBy(*order)
    leaders = (
        rows.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(_SALTS)))
        .withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= limit)
    )
    return leaders.withColumn("_rank", F.row_number().over(day)).where(F.col("_rank") <= limit).drop("_rank", "_part")


def _counted(
    facts: DataFrame, dim: DataFrame, key: str, dims: list[str], how: str, limit: int, order: list[Column]
) -> DataFrame:
    days = ["day_date"] if limit > 0 else []
    counts = facts.groupBy(*days, key, *dims).agg(F.count("*").alias("cnt"))
    joined = attach_point(counts, dim, key, how)
    return top_per_day(joined, limit, order) if limit > 0 else joined


def _by_name(joined: DataFrame, key: str, name: str, dims: list[str]) -> DataFrame:
    """Merge over days by point name. Points that share a name merge; the smallest id gives the coordinates."""
    place = F.min(F.struct(key, "lat", "lon")).alias("p")
    shown = F.coalesce(name, F.lit("None")).alias(name)
    return joined.groupBy(shown, *dims).agg(F.sum("cnt").alias("cnt"), place).select(
        name, *dims, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), "cnt"
    )


def sighting_heatmap(
    facts: DataFrame, spawnpoints: DataFrame, area_id: int, start: datetime, end: datetime,
    filters: dict | None = None, limit_per_day: int = 0,
) -> DataFrame:
    """Count per spawnpoint, species and form.

    Filters: ``species`` and ``form`` lists; ``iv`` and ``level`` comparison lists (joined by OR);
    ``iv_range`` and ``level_range`` as ``(low, high)``.
    """
    filters = filters or {}
    rows = where_seen(facts.where(F.col("area_id") == area_id), start, end)
    rows = where_all_in(rows, {c: filters.get(c) for c in ("species", "form")})
    for col in ("iv", "level"):
        rows = where_expr(rows, col, filters.get(col))
        rows = where_between(rows, col, *filters.get(f"{col}_range", ()))
    dims = ["species", "form"]
    order = [F.desc("cnt"), F.asc("species"), F.asc("spawnpoint"), F.asc("form")]
    joined = _counted(rows, spawnpoints, "spawnpoint", dims, "inner", limit_per_day, order)
    # a spawnpoint has one dimension row, so its coordinates are the same on every day
    merged = joined.groupBy("spawnpoint", *dims).agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.sum("cnt").alias("cnt")
    )
    return merged.orderBy(*order)


RAID_FILTERS = ("gym", "boss", "form", "level", "team", "costume", "exclusive", "ex_eligible")
INVASION_FILTERS = ("pokestop", "display_type", "character_id", "grunt", "confirmed")


def raid_map(
    facts: DataFrame, gyms: DataFrame, area_id: int, start: datetime, end: datetime,
    filters: dict | None = None, limit_per_day: int = 0,
) -> DataFrame:
    rows = where_seen(facts.where(F.col("area_id") == area_id), start, end)
    rows = where_all_in(rows, {c: (filters or {}).get(c) for c in RAID_FILTERS})
    dims = ["boss", "form", "level"]
    order = [F.desc("cnt"), F.asc("boss"), F.asc("gym"), F.asc("form"), F.asc("level")]
    joined = _counted(rows, gyms, "gym", dims, "inner", limit_per_day, order)
    merged = _by_name(joined, "gym", "gym_name", dims)
    return merged.orderBy(F.desc("cnt"), "boss", "gym_name", "form", "level")


def invasion_map(
    facts: DataFrame, stops: DataFrame, area_id: int, start: datetime, end: datetime,
    filters: dict | None = None, limit_per_day: int = 0,
) -> DataFrame:
    rows = where_seen(facts.where(F.col("area_id") == area_id), start, end)
    rows = where_all_in(rows, {c: (filters or {}).get(c) for c in INVASION_FILTERS})
    dims = ["display_type", "character_id"]
    order = [F.desc("cnt"), F.asc("display_type"), F.asc("pokestop"), F.asc("character_id")]
    joined = _counted(rows, stops, "pokestop", dims, "inner", limit_per_day, order)
    merged = _by_name(joined, "pokestop", "pokestop_name", dims)
    return merged.orderBy(F.desc("cnt"), "display_type", "pokestop_name", "character_id")


def _quest_map(rows: DataFrame, stops: DataFrame, start, end, filters: dict, limit_per_day: int, where_mode) -> DataFrame:
    rows = where_seen(rows, start, end)
    rows = where_in(where_in(rows, "pokestop", filters.get("pokestop")), "mode", filters.get("mode"))
    rows = where_mode(rows, **{k: v for k, v in filters.items() if k not in ("pokestop", "mode")})
    dims = ["mode", "task_type"]
    order = [F.desc("cnt"), F.asc("pokestop"), F.asc("mode"), F.asc("task_type")]
    joined = _counted(rows, stops, "pokestop", dims, "left", limit_per_day, order)
    merged = _by_name(joined, "pokestop", "pokestop_name", dims)
    return merged.orderBy("mode", F.desc("cnt"), "task_type", "pokestop_name")


def quest_item_map(
    facts: DataFrame, stops: DataFrame, area_id: int, start: datetime, end: datetime,
    filters: dict | None = None, limit_per_day: int = 0,
) -> DataFrame:
    """Filters: ``pokestop``, ``mode`` and the mode-coupled ones of :func:`where_quest_items`."""
    rows = facts.where(F.col("area_id") == area_id)
    return _quest_map(rows, stops, start, end, filters or {}, limit_per_day, where_quest_items)


def quest_creature_map(
    facts: DataFrame, stops: DataFrame, area_id: int, start: datetime, end: datetime,
    filters: dict | None = None, limit_per_day: int = 0,
) -> DataFrame:
    """Filters: ``pokestop``, ``mode`` and the mode-coupled ones of :func:`where_quest_creatures`."""
    rows = facts.where(F.col("area_id") == area_id)
    return _quest_map(rows, stops, start, end, filters or {}, limit_per_day, where_quest_creatures)
