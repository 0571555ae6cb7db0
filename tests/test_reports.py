"""Rollup queries, map reports and derived tables on small literal data."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.operators import retention as RT
from fieldtally.plans import derived as PD
from fieldtally.plans import maps as PM
from fieldtally.plans import series as PS
from fieldtally.plans import totals as PT
from fieldtally.plans.selection import Selection
from fieldtally.plans.shiny import shiny_rates

NOW = datetime(2024, 2, 1)


@pytest.fixture
def sel(spark):
    areas = spark.createDataFrame([("A", 0), ("B", 0)], "area string, offset_hours int")
    return lambda **kw: Selection(areas, "2024-01-01T00:00:00", "2024-01-02T00:00:00", NOW, **kw)


def test_remaining_time_mean_skips_absent_hours(spark, rows, sel):
    data = [("A", datetime(2024, 1, 1, 1), "0_5", "total", 4), ("A", datetime(2024, 1, 1, 2), "0_5", "total", 2),
            ("A", datetime(2024, 1, 1, 3), "5_10", "total", 9)]
    rollup = spark.createDataFrame(data, "area string, bucket timestamp_ntz, tth_bucket string, metric string, cnt bigint")
    assert rows(PT.tth_totals(rollup, sel(), "grouped")) == [("A", "0_5", 3.0), ("A", "5_10", 9.0)]
    with pytest.raises(ValueError):
        PT.tth_totals(rollup, sel(), "median")


def test_raid_breakdowns_each_sum_to_the_total(spark, sel):
    data = [("A", datetime(2024, 1, 1, h), b, h % 3, "0", "0", 0, h % 2, "total", h) for h in range(1, 9) for b in (1, 2)]
    rollup = spark.createDataFrame(
        data, "area string, bucket timestamp_ntz, boss int, level int, form string, costume string, exclusive int, ex_eligible int, metric string, cnt bigint"
    )
    sums = PT.raid_totals(rollup, sel(), "grouped").groupBy("breakdown").agg(F.sum("cnt").alias("s")).collect()
    assert {r.s for r in sums} == {72} and len(sums) == 6
    hours = PT.raid_totals(rollup, sel(), "surged").where("breakdown = 'total'").agg(F.sum("cnt")).first()[0]
    assert hours == 72


def test_quest_sum_is_zero_filled(spark, rows, sel):
    schema = "area string, bucket timestamp_ntz, mode string, task_type int, reward_type int, item_id int, amount int, creature_id int, creature_form int, metric string, cnt bigint"
    rollup = spark.createDataFrame([("A", datetime(2024, 1, 1), "ar", 1, 2, 3, 4, None, None, "total", 5)], schema)
    got = rows(PS.quest_series(rollup, sel(), "sum"))
    assert ("A", "quest_mode", "normal", 0) in got and ("B", "total", "total", 0) in got and ("A", "total", "total", 5) in got
    assert len(got) == 6


def test_shiny_rate_example(spark):
    months = spark.createDataFrame(
        [(2401, "u1", 1, "0", 1, 1, 1), (2401, "u1", 1, "0", 0, 1, 2), (2402, "u1", 1, "0", 0, 1, 1), (2402, "u2", 1, "0", 0, 1, 1)], M.SHINY_MONTHS
    )
    row = shiny_rates(months, 2401, 2402).first()
    assert (row.shiny_pct_macro, row.shiny_pct_pooled, row.users_contributing, row.total_encounters) == (12.5, 20.0, 2, 5)
    assert shiny_rates(months, 2401, 2402, min_user_n=2, users="U1, U2").first().users_contributing == 1
    assert shiny_rates(months, 2402, 2402, min_user_n=2).count() == 0


def test_top_per_day_equals_plain_ranking(spark, rows):
    data = [(date(2024, 1, d), f"p{i:03d}", (i * 7 + d) % 13) for d in (1, 2) for i in range(200)]
    df = spark.createDataFrame(data, "day_date date, p string, cnt int")
    order = [F.desc("cnt"), F.asc("p")]
    want = sorted(
        (r for d in (1, 2) for r in sorted((x for x in data if x[0].day == d), key=lambda x: (-x[2], x[1]))[:17]), key=repr
    )
    assert rows(PM.top_per_day(df, 17, order)) == want


def test_quest_map_keeps_unknown_stops(spark, rows):
    t = datetime(2024, 1, 1, 5)
    facts = spark.createDataFrame([(t.date(), "s1", t, 1, 9, 3, 4, 1), (t.date(), "gone", t, 0, 9, 3, 4, 1)], M.QUEST_ITEM_FACTS)
    stops = spark.createDataFrame([("s1", "Stop", 1.0, 2.0)], M.POKESTOPS)
    got = rows(PM.quest_item_map(facts, stops, 9, t, t + timedelta(hours=1)))
    assert got == [("None", 0, 3, None, None, 1), ("Stop", 1, 3, 1.0, 2.0, 1)]


def test_points_with_one_name_merge(spark, rows):
    t = datetime(2024, 1, 1, 5)
    facts = spark.createDataFrame([(t.date(), g, t, 5, 1, "0", 0, "0", 0, 0, 9) for g in ("g1", "g2")], M.RAID_FACTS)
    gyms = spark.createDataFrame([("g2", "Same", 2.0, 2.0), ("g1", "Same", 1.0, 1.0)], M.GYMS)
    assert rows(PM.raid_map(facts, gyms, 9, t, t)) == [("Same", 5, "0", 1, 1.0, 1.0, 2)]


def test_daily_series_is_cut_and_filled(spark):
    rollup = spark.createDataFrame([("A", datetime(2024, 3, 1, 5), 1, 3)], "area string, bucket timestamp_ntz, confirmed int, cnt bigint")
    got = PD.daily_series(rollup, "invasions", "a", date(2023, 1, 1), date(2024, 3, 1), max_days=90)
    assert got.count() == 91 * 3
    assert got.where("cnt > 0").count() == 2
    with pytest.raises(ValueError):
        PD.daily_series(rollup, "invasions", "a", date(2024, 3, 2), date(2024, 3, 1))


def test_grid_cells(spark):
    df = spark.createDataFrame([(0.0001, 0.0001, 1, "0", 3), (0.0004, 0.0002, 2, "0", 5), (-0.0001, 0.0, 1, "0", 4)], "lat double, lon double, species int, form string, cnt bigint")
    cells = {(r.lat_cell, r.lon_cell): r for r in PD.grid_bins(df, ["species", "form"]).collect()}
    assert cells[0, 0].total == 8 and cells[0, 0].share == 1.0 and cells[-1, 0].share == 0.5
    assert [(i.species, i.cnt) for i in cells[0, 0]["items"]] == [(2, 5), (1, 3)]


def test_retention_limits(spark, rows):
    assert RT.first_kept_day(date(2025, 9, 26), 15) == date(2025, 9, 12)
    assert RT.first_kept_month(date(2025, 9, 26), 3) == 2507
    assert RT.first_kept_month(date(2025, 1, 26), 1, at_least=3) == 2411
    assert RT.first_kept_month(date(2025, 1, 26), 1) == 2501
    df = spark.createDataFrame([(2506,), (2507,)], "month_year int")
    assert rows(RT.retention_plan(df, date(2025, 9, 26), 3, "month")) == [("2506", "drop"), ("2507", "keep")]
