"""Filters and window texts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import predicates as P
from fieldtally.functions import timewindow as W
from fieldtally.plans.selection import Selection, where_areas

NOW = datetime(2024, 3, 31, 12)


def test_comparison_list_is_or(spark, rows):
    df = spark.createDataFrame([(0,), (50,), (90,)], "iv int")
    assert rows(P.where_expr(df, "iv", ">=90,==0")) == [(0,), (90,)]
    assert rows(P.where_expr(df, "iv", "all")) == [(0,), (50,), (90,)]
    with pytest.raises(ValueError):
        P.where_expr(df, "iv", ">=90;drop")


def test_multi_select(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n int, s string")
    assert rows(P.where_in(df, "n", " 1 ,x"), "s") == [("a",)]
    assert rows(P.where_in(df, "n", "x"), "s") == []
    assert rows(P.where_in(df, "n", "None,2"), "s") == [("b",), ("c",)]
    assert P.where_in(df, "n", " ALL ") is df and P.where_in(df, "n", "") is df


def test_spawnpoint_text(spark, rows):
    df = spark.createDataFrame([("1234567",), ("12345678",), ("12g45678",), ("0x123456",), (" 12345678 ",)], "x string")
    assert rows(df.where(P.valid_spawnpoint(F.col("x")))) == [(" 12345678 ",), ("12345678",)]


def test_coordinates(spark, rows):
    data = [("a", 1.0, 2.0), ("b", 0.0, 2.0), ("c", 91.0, 0.0), ("d", float("nan"), 1.0), ("e", 1.0, float("inf")), ("f", None, 1.0)]
    df = spark.createDataFrame(data, "n string, lat double, lon double")
    assert rows(df.where(P.valid_coords(F.col("lat"), F.col("lon"))), "n") == [("a",), ("b",)]
    assert rows(df.where(P.valid_coords(F.col("lat"), F.col("lon"), strict=True)), "n") == [("a",)]


def test_fact_window_includes_its_end(spark, rows):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), datetime(2024, 1, 1, 9)), (date(2024, 1, 2), datetime(2024, 1, 2, 9)), (date(2024, 1, 2), datetime(2024, 1, 2, 9, 0, 1))],
        "day_date date, seen_at timestamp_ntz",
    )
    kept = P.where_seen(df, datetime(2024, 1, 1, 9), datetime(2024, 1, 2, 9))
    assert kept.count() == 2


def test_rollup_window_excludes_its_end(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h),) for h in (1, 2, 3)], "bucket timestamp_ntz")
    assert P.where_buckets(df, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 3)).count() == 2


def test_window_texts():
    assert W.rollup_point("1 month").at(NOW) == datetime(2024, 2, 29, 12)
    assert W.rollup_point("2 years").at(NOW) == datetime(2022, 3, 31, 12)
    assert W.rollup_point("now").at(NOW, -3) == datetime(2024, 3, 31, 9)
    assert W.rollup_point("2024-01-01T02:00:00+02:00").at(NOW, 5) == datetime(2024, 1, 1)
    assert W.fact_time("202403", NOW) == datetime(2024, 3, 1)
    assert W.fact_time("20240305", NOW) == datetime(2024, 3, 5)
    assert W.fact_time("yesterday", NOW) == datetime(2024, 3, 30)
    assert W.fact_time("10 days", NOW) == datetime(2024, 3, 21, 12)
    assert W.month_start("2024-03") == W.month_start("20240315") == date(2024, 3, 1)
    assert W.months_between(date(2024, 11, 1), date(2025, 2, 1)) == [2411, 2412, 2501, 2502]
    for bad in ("", "soon", "3 fortnights"):
        with pytest.raises(ValueError):
            W.rollup_point(bad)


def test_month_distance_per_area_matches_the_driver(spark):
    point = W.rollup_point("1 month")
    df = spark.createDataFrame([(o,) for o in (-12, -1, 0, 3, 13)], "o int")
    for row in df.select("o", point.column(NOW, F.col("o")).alias("t")).collect():
        assert row.t == point.at(NOW, row.o)


def test_each_area_has_its_own_window(spark, rows):
    areas = spark.createDataFrame([("East", 3), ("West", -3)], "area string, offset_hours int")
    data = [(a, datetime(2024, 3, 31, h), h) for a in ("East", "West") for h in range(6, 18)]
    rollup = spark.createDataFrame(data, "area string, bucket timestamp_ntz, h int")
    got = rows(where_areas(rollup, Selection(areas, "2 hours", "now", NOW)), "area", "h")
    assert got == [("East", 13), ("East", 14), ("West", 7), ("West", 8)]
    one = rows(where_areas(rollup, Selection(areas, "2 hours", "now", NOW, "eAst, nowhere")), "area", "h")
    assert one == [("East", 13), ("East", 14)]


def test_raid_rsvps(spark, rows):
    cols = "gym string, ex_eligible int, exclusive int, lvl int, boss int, form string, costume string, lat double, lon double, spawn bigint, start_ts bigint, end_ts bigint, rsvps string"
    base = ("g", 0, 0, 1, 5, "0", "0", 1.0, 1.0, 1, 2, 3)
    df = spark.createDataFrame([(*base, r) for r in (None, "", "null", "NULL", "[1]")], cols)
    assert P.valid_raids(df).count() == 4
    assert P.valid_raids(df.withColumn("boss", F.lit(0))).count() == 0


def test_quest_mode_arms(spark, rows):
    df = spark.createDataFrame([(1, 5, 9), (1, 6, 9), (0, 5, 9), (0, 5, 8)], "mode int, task_type int, item_id int")
    assert rows(P.where_quest_items(df, ar_task_types="5")) == [(1, 5, 9)]
    assert rows(P.where_quest_items(df, ar_task_types="5", normal_item_ids="8")) == [(0, 5, 8), (1, 5, 9)]
    assert P.where_quest_items(df) is df


def test_fact_selection(spark, tmp_path, rows):
    import re

    import pytest

    from fieldtally.plans.maps import sighting_heatmap
    from fieldtally.plans.selection import FactSelection, map_report, rate_report
    from fieldtally.plans.shiny import shiny_rates
    from fieldtally.sources import tables as ST

    now = datetime(2024, 3, 31, 12)
    areas = spark.createDataFrame([(3, "Here", 2)], "area_id int, area string, offset_hours int")
    sel = lambda start, end, area="here": FactSelection(areas, area, start, end, now)
    assert sel("yesterday", "today").window() == (datetime(2024, 3, 30), datetime(2024, 3, 31))
    assert sel("202403", "now").window() == (datetime(2024, 3, 1), now) and sel("20240305", "2 days").window() == (datetime(2024, 3, 5), datetime(2024, 3, 29, 12))
    assert sel("2023-11", "2024-02").months() == [2311, 2312, 2401, 2402] and sel("2 months", "today").months() == [2401, 2402, 2403]
    for bad in (lambda: sel("now", "yesterday").window(), lambda: sel("some day", "now").window(), lambda: sel("some day", "now").months(), lambda: rate_report(shiny_rates, None, sel("2024-02", "2024-01"))):
        with pytest.raises(ValueError):
            bad()
    facts = spark.sql(
        "SELECT date_add(DATE'2024-03-01', CAST(id AS INT)) AS day_date, id AS spawnpoint, CAST(date_add(DATE'2024-03-01', CAST(id AS INT)) AS TIMESTAMP_NTZ) AS seen_at, "
        "1 AS species, '0' AS form, 1 AS iv, 1 AS level, 3 AS area_id FROM range(31)"
    )
    ST.write_facts(facts, str(tmp_path / "facts"))
    points = spark.sql("SELECT id AS spawnpoint, 1.0D AS lat, 2.0D AS lon FROM range(31)")
    found = map_report(sighting_heatmap, ST.read_facts(spark, str(tmp_path / "facts"), "sighting_facts"), points, sel("3 days", "yesterday"))
    assert [r[0] for r in rows(found, "spawnpoint")] == [28, 29]  # 12:00 on the 28th to the start of the 30th
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day_date[^\]]*2024-03-28[^\]]*2024-03-30", plan)
