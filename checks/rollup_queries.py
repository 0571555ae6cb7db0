"""Queries over the rollups: counter totals and minute series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from checks.base import Frames, query, window
from fieldtally.operators.spatial import count_points_by_area
from fieldtally.plans import series as PS
from fieldtally.plans import totals as PT

W = window()
CNT = "CAST(sum(cnt) AS BIGINT) AS cnt"
HOUR = "CAST(hour(bucket) AS INT) AS hour"


def total(table: str, keys: str, where: str = W) -> str:
    return f"SELECT area, {keys}, {CNT} FROM {table} WHERE {where} GROUP BY ALL"


def parts(table: str, names: dict[str, str], keys: str = "", where: str = W) -> str:
    """Breakdowns plus total, one SELECT each."""
    extra = f"{keys}, " if keys else ""
    all_names = {"total": "'total'", **names}
    return " UNION ALL ".join(
        f"SELECT area, {extra}'{name}' AS breakdown, {key} AS key, {CNT} FROM {table} WHERE {where} GROUP BY ALL"
        for name, key in all_names.items()
    )


def text(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'None')"


RAIDS = {
    "raid_pokemon+raid_form": "concat(boss, ':', form)", "raid_level": text("level"), "raid_costume": text("costume"),
    "raid_is_exclusive": text("exclusive"), "raid_ex_eligible": text("ex_eligible"),
}
LEVEL = {"raid_level": text("level")}
INVASIONS = {
    "display_type+character": "concat(display_type, ':', character_id)", "grunt": text("grunt"), "confirmed": text("confirmed"),
}
CONFIRMED = {"confirmed": text("confirmed")}
QUESTS = {
    "quest_mode": "mode", "reward_type": text("reward_type"), "reward_item": text("item_id"),
    "reward_item_amount": text("amount"), "reward_poke": text("creature_id"), "reward_poke_form": text("creature_form"),
}
MODE = {"quest_mode": "mode"}


def add(name: str, sql: str, family: str, grain: str, plan, mode: str, filters: dict | None = None, **options):
    @query(name, sql)
    def run(f: Frames) -> DataFrame:
        return plan(f.roll(family, grain), f.sel(**(filters or {})), mode, **options)


for _grain in ("hour", "day", "week"):
    add(f"F1_sighting_totals_sum_{_grain}", total(f"r_sightings_{_grain}", "metric"), "sightings", _grain, PT.sighting_totals, "sum")
    add(f"F4_tth_totals_sum_{_grain}", total(f"r_tth_{_grain}", "tth_bucket"), "tth", _grain, PT.tth_totals, "sum")
    add(
        f"F4_tth_totals_grouped_{_grain}",
        f"SELECT area, tth_bucket, round_even(avg(cnt), 3) AS avg FROM r_tth_{_grain} WHERE {W} GROUP BY ALL",
        "tth", _grain, PT.tth_totals, "grouped",
    )
    add(f"F8_raid_totals_sum_{_grain}", parts(f"r_raids_{_grain}", LEVEL), "raids", _grain, PT.raid_totals, "sum")
    add(f"F11_invasion_totals_sum_{_grain}", parts(f"r_invasions_{_grain}", CONFIRMED), "invasions", _grain, PT.invasion_totals, "sum")
    add(f"F14_quest_totals_sum_{_grain}", parts(f"r_quests_{_grain}", MODE), "quests", _grain, PT.quest_totals, "sum")

add("F2_sighting_totals_grouped", total("r_sightings_hour", "species, form, metric"), "sightings", "hour", PT.sighting_totals, "grouped")
add(
    "F2_sighting_totals_grouped_filtered",
    total("r_sightings_day", "species, form, metric", f"{W} AND species IN (5, 25, 77) AND form = '1' AND metric IN ('total', 'iv100')"),
    "sightings", "day", PT.sighting_totals, "grouped", {"species": "5,25,77", "form": "1", "metric": "total,iv100"},
)
add("F3_sighting_totals_surged", total("r_sightings_hour", f"{HOUR}, species, form, metric"), "sightings", "hour", PT.sighting_totals, "surged")
add("F5_tth_totals_surged", total("r_tth_hour", f"{HOUR}, tth_bucket"), "tth", "hour", PT.tth_totals, "surged")
_MONTHS = {"start": "2024-01-01T00:00:00", "end": "2024-03-01T00:00:00"}
_WM = window(_MONTHS["start"], _MONTHS["end"])
add("F6_weather_iv_sum", total("r_weather_iv_month", "weather_flag, iv_bucket", _WM), "weather_iv", "month", PT.weather_iv, "sum", _MONTHS)
add(
    "F7_weather_iv_grouped", total("r_weather_iv_month", "strftime(bucket, '%Y%m') AS month, weather_flag, iv_bucket", _WM),
    "weather_iv", "month", PT.weather_iv, "grouped", _MONTHS,
)
add("F9_raid_totals_grouped", parts("r_raids_hour", RAIDS), "raids", "hour", PT.raid_totals, "grouped")
add(
    "F9_raid_totals_grouped_filtered", parts("r_raids_day", RAIDS, where=f"{W} AND level IN (3, 5) AND costume = '0'"),
    "raids", "day", PT.raid_totals, "grouped", {"level": "3,5", "costume": "0"},
)
add("F10_raid_totals_surged", parts("r_raids_hour", RAIDS, HOUR), "raids", "hour", PT.raid_totals, "surged")
add("F12_invasion_totals_grouped", parts("r_invasions_hour", INVASIONS), "invasions", "hour", PT.invasion_totals, "grouped")
add("F13_invasion_totals_surged", parts("r_invasions_hour", INVASIONS, HOUR), "invasions", "hour", PT.invasion_totals, "surged")
add("F15_quest_totals_grouped", parts("r_quests_day", QUESTS, "bucket"), "quests", "day", PT.quest_totals, "grouped")
add(
    "F15_quest_totals_grouped_filtered",
    parts("r_quests_day", QUESTS, "bucket", f"{W} AND mode = 'normal' AND reward_type IN (2, 3)"),
    "quests", "day", PT.quest_totals, "grouped", {"with_ar": "false", "normal_reward_type": "2,3"},
)
add("F16_quest_totals_surged", parts("r_quests_hour", QUESTS, HOUR), "quests", "hour", PT.quest_totals, "surged")

M = "r_sightings_minute"
add("F17_sighting_series_sum", total(M, "metric"), "sightings", "minute", PS.sighting_series, "sum")
add("F17_sighting_series_grouped", total(M, "metric, species, form"), "sightings", "minute", PS.sighting_series, "grouped")
add("F17_sighting_series_surged", total(M, f"metric, {HOUR}"), "sightings", "minute", PS.sighting_series, "surged")
M = "r_tth_minute"
add("F18_tth_series_sum", total(M, "tth_bucket"), "tth", "minute", PS.tth_series, "sum")
add("F18_tth_series_grouped", total(M, "tth_bucket, bucket"), "tth", "minute", PS.tth_series, "grouped")
add("F18_tth_series_surged", total(M, f"tth_bucket, {HOUR}"), "tth", "minute", PS.tth_series, "surged")
M, _BOSS = "r_raids_minute", {"raid_pokemon+raid_form": "concat(boss, ':', form)", **LEVEL}
add("F19_raid_series_sum", parts(M, LEVEL), "raids", "minute", PS.raid_series, "sum")
add("F19_raid_series_sum_total_only", parts(M, LEVEL, where=f"{W} AND metric = 'total'"), "raids", "minute", PS.raid_series, "sum", raid_type="total")
add("F19_raid_series_grouped", parts(M, _BOSS), "raids", "minute", PS.raid_series, "grouped")
add("F19_raid_series_surged", parts(M, _BOSS, HOUR), "raids", "minute", PS.raid_series, "surged")
M = "r_invasions_minute"
add("F20_invasion_series_sum", parts(M, CONFIRMED), "invasions", "minute", PS.invasion_series, "sum")
add("F20_invasion_series_grouped", total(M, "display_type, grunt, confirmed, bucket"), "invasions", "minute", PS.invasion_series, "grouped")
add("F20_invasion_series_surged", total(M, f"display_type, grunt, confirmed, {HOUR}"), "invasions", "minute", PS.invasion_series, "surged")

M = "r_quests_minute"
add(
    "F21_quest_series_sum",
    f"""SELECT 'NATION_24' AS area, w.breakdown, w.key, coalesce(c.cnt, 0) AS cnt
        FROM (VALUES ('total', 'total'), ('quest_mode', 'ar'), ('quest_mode', 'normal')) w(breakdown, key)
        LEFT JOIN (SELECT * FROM ({parts(M, MODE, where=f"{W} AND mode = 'ar'")}) WHERE area = 'NATION_24') c
        ON c.breakdown = w.breakdown AND c.key = w.key""",
    "quests", "minute", PS.quest_series, "sum", {"area": "nation_24", "mode": "ar"},
)


@query(
    "F22_quest_series_overview",
    f"""WITH c AS (SELECT area, mode, {CNT} FROM {M} WHERE {W} GROUP BY ALL)
        SELECT 'area' AS section, c.area AS key, CAST(sum(c.cnt) AS BIGINT) AS cnt, max(s.stops) AS stops
          FROM c JOIN stops_by_area s USING (area) GROUP BY c.area
        UNION ALL SELECT 'total', 'grand_total', (SELECT CAST(sum(cnt) AS BIGINT) FROM c), (SELECT CAST(sum(stops) AS BIGINT) FROM stops_by_area)
        UNION ALL SELECT 'mode', mode, CAST(sum(cnt) AS BIGINT), NULL FROM c GROUP BY mode""",
)
def f22(f: Frames) -> DataFrame:
    stops = count_points_by_area(f.points("pokestops"), f.areas, f.index)
    return PS.quest_series(f.roll("quests", "minute"), f.sel(), "sum", stops)


_TUPLE = "mode, task_type, reward_type, item_id, amount, creature_id, creature_form"
add(
    "F23_quest_series_grouped", total(M, _TUPLE, f"{W} AND mode = 'normal' AND task_type IN (1, 3, 5)"),
    "quests", "minute", PS.quest_series, "grouped", {"mode": "normal", "task_type": "1,3,5"},
)
add("F23_quest_series_surged", total(M, f"{_TUPLE}, {HOUR}"), "quests", "minute", PS.quest_series, "surged")
