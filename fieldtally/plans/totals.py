"""Queries over the counter rollups: modes ``sum``, ``grouped`` and ``surged`` (by hour of day).

Results are long frames, one row per area and group. Each query is one scan, one small join with
the chosen areas and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.predicates import where_quest_rollup
from fieldtally.functions.scalars import hour_of_day, month_key
from fieldtally.operators.derive import label
from fieldtally.plans.selection import Selection, select_rows, where_areas

MODES = ("sum", "grouped", "surged")


def check_mode(mode: str, allowed: tuple[str, ...] = MODES) -> None:
    if mode not in allowed:
        raise ValueError(f"mode must be one of {allowed}, not {mode!r}")


def total(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("area", *keys).agg(F.sum("cnt").alias("cnt"))


def with_hour(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", hour_of_day(F.col("bucket")))


def breakdowns(rows: DataFrame, parts: dict[str, list[str]], *keys: str) -> DataFrame:
    """Several one-way breakdowns plus the total, as rows ``(breakdown, key, cnt)``.

    Every rollup row is repeated once per breakdown and counted in one aggregation; the repeats are
    combined before the shuffle.
    """

    def entry(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("breakdown"), key.alias("key"))

    entries = [entry("total", F.lit("total"))]
    for name, cols in parts.items():
        entries.append(entry(name, F.concat_ws(":", *[label(F.col(c)) for c in cols])))
    spread = rows.select("area", *keys, "cnt", F.inline(F.array(*entries)))
    return total(spread, *keys, "breakdown", "key")


def sighting_totals(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return total(rows, "metric")
    if mode == "grouped":
        return total(rows, "species", "form", "metric")
    return total(with_hour(rows), "hour", "species", "form", "metric")


def tth_totals(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    """``grouped`` is the mean over the time buckets that contain the class; empty ones do not count as 0."""
    check_mode(mode)
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return total(rows, "tth_bucket")
    if mode == "grouped":
        return rows.groupBy("area", "tth_bucket").agg(F.bround(F.avg("cnt"), 3).alias("avg"))
    return total(with_hour(rows), "hour", "tth_bucket")


def weather_iv(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    """The filter ``weather_flag`` chooses flags; a month counts when its first day is in the window."""
    check_mode(mode, ("sum", "grouped"))
    rows = select_rows(rollup, sel)
    if mode == "sum":
        return total(rows, "weather_flag", "iv_bucket")
    return total(rows.withColumn("month", month_key(F.col("bucket"))), "month", "weather_flag", "iv_bucket")


RAID_PARTS = {
    "raid_pokemon+raid_form": ["boss", "form"],
    "raid_level": ["level"],
    "raid_costume": ["costume"],
    "raid_is_exclusive": ["exclusive"],
    "raid_ex_eligible": ["ex_eligible"],
}
INVASION_PARTS = {
    "display_type+character": ["display_type", "character_id"],
    "grunt": ["grunt"],
    "confirmed": ["confirmed"],
}
QUEST_PARTS = {
    "quest_mode": ["mode"],
    "reward_type": ["reward_type"],
    "reward_item": ["item_id"],
    "reward_item_amount": ["amount"],
    "reward_poke": ["creature_id"],
    "reward_poke_form": ["creature_form"],
}


def _broken_down(rows: DataFrame, mode: str, sum_part: str, parts: dict[str, list[str]]) -> DataFrame:
    check_mode(mode)
    if mode == "sum":
        return breakdowns(rows, {sum_part: parts[sum_part]})
    if mode == "grouped":
        return breakdowns(rows, parts)
    return breakdowns(with_hour(rows), parts, "hour")


def raid_totals(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    return _broken_down(select_rows(rollup, sel), mode, "raid_level", RAID_PARTS)


def invasion_totals(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    return _broken_down(select_rows(rollup, sel), mode, "confirmed", INVASION_PARTS)


def quest_totals(rollup: DataFrame, sel: Selection, mode: str = "sum") -> DataFrame:
    """Filters as in :func:`where_quest_rollup`. ``grouped`` keeps every time bucket apart."""
    check_mode(mode)
    rows = where_quest_rollup(where_areas(rollup, sel), **sel.filters)
    if mode == "sum":
        return breakdowns(rows, {"quest_mode": ["mode"]})
    if mode == "grouped":
        return breakdowns(rows, QUEST_PARTS, "bucket")
    return breakdowns(with_hour(rows), QUEST_PARTS, "hour")
