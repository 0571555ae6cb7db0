"""Queries over the minute rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.predicates import where_in
from fieldtally.plans.selection import Selection, chosen_areas, select_rows
from fieldtally.plans.totals import breakdowns, check_mode, total, with_hour


def sighting_series(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return total(rows, "metric")
    if mode == "grouped":
        return total(rows, "metric", "species", "form")
    return total(with_hour(rows), "metric", "hour")


def tth_series(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    """``grouped`` keeps every minute apart."""
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return total(rows, "tth_bucket")
    if mode == "grouped":
        return total(rows, "tth_bucket", "bucket")
    return total(with_hour(rows), "tth_bucket", "hour")


def raid_series(rollup: DataFrame, sel: Selection, mode: str = "sum", raid_type: str = "all") -> DataFrame:
    """``raid_type`` chooses among the four series. With ``all`` they are added up, so a raid with a
    costume counts once for itself and once for the costume series; ``total`` is the plain count."""
    check_mode(mode)
    rows = where_in(select_rows(rollup, sel), "metric", raid_type)
    parts = {"raid_level": ["level"]}
    if mode == "sum":
        return breakdowns(rows, parts)
    parts = {"raid_pokemon+raid_form": ["boss", "form"], **parts}
    if mode == "grouped":
        return breakdowns(rows, parts)
    return breakdowns(with_hour(rows), parts, "hour")


def invasion_series(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    """``grouped`` keeps every minute apart, per display type, grunt and confirmation."""
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return breakdowns(rows, {"confirmed": ["confirmed"]})
    if mode == "grouped":
        return total(rows, "display_type", "grunt", "confirmed", "bucket")
    return total(with_hour(rows), "display_type", "grunt", "confirmed", "hour")


QUEST_DIMS = ("mode", "task_type", "reward_type", "item_id", "amount", "creature_id", "creature_form")


def quest_series(rollup: DataFrame, sel: Selection, mode: str = "sum", stops: DataFrame | None = None) -> DataFrame:
    """Filters: ``mode`` and ``task_type``.

    ``sum`` gives ``(area, breakdown, key, cnt)`` with both modes present even at 0. With ``stops``
    (per-area stop counts) it is the report over all areas instead: one row per area with quests and
    its stop count, and rows ``grand_total`` and ``mode:<mode>``.
    """
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "grouped":
        return total(rows, *QUEST_DIMS)
    if mode == "surged":
        return total(with_hour(rows), *QUEST_DIMS, "hour")
    return _quest_sum(rows, sel) if stops is None else _quest_overview(rows, stops)


def _quest_sum(rows: DataFrame, sel: Selection) -> DataFrame:
    counted = breakdowns(rows, {"quest_mode": ["mode"]})
    wanted = F.array(
        *[F.struct(F.lit(b).alias("breakdown"), F.lit(k).alias("key"))
          for b, k in (("total", "total"), ("quest_mode", "ar"), ("quest_mode", "normal"))]
    )
    frame = chosen_areas(sel.areas, sel.area).select("area", F.inline(wanted))
    return frame.join(counted, ["area", "breakdown", "key"], "left").select(
        "area", "breakdown", "key", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def _quest_overview(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Sums per area, per mode and over all come from the counts per area and mode by one aggregation with grouping sets.

    A row of each mode with 0 makes modes without quests, and the total without any, appear.
    """
    none = rows.sparkSession.createDataFrame([(None, "ar", 0), (None, "normal", 0)], "area string, mode string, cnt bigint")
    by_mode = total(rows, "mode").select("area", "mode", "cnt").unionByName(none)
    sums = by_mode.groupingSets([["area"], ["mode"], []], "area", "mode").agg(F.sum("cnt").alias("cnt"), F.grouping_id().alias("set"))
    per_area, per_mode, all_of_it = 1, 2, 3  # bits of the columns that are summed over
    named = sums.where(
        ((F.col("set") == per_area) & F.col("area").isNotNull()) | ((F.col("set") == per_mode) & F.col("mode").isin("ar", "normal"))
        | (F.col("set") == all_of_it)
    ).join(stops.select("area", F.col("stops").alias("own")), "area", "left")
    all_stops = F.coalesce(stops.agg(F.sum("stops")).scalar(), F.lit(0))
    return named.select(
        F.when(F.col("set") == per_area, "area").when(F.col("set") == per_mode, "mode").otherwise("total").alias("section"),
        F.when(F.col("set") == per_area, F.col("area")).when(F.col("set") == per_mode, F.col("mode")).otherwise("grand_total").alias("key"),
        "cnt",
        F.when(F.col("set") == per_area, F.coalesce("own", F.lit(0))).when(F.col("set") == all_of_it, all_stops).alias("stops"),
    )
