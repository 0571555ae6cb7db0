"""Fact and dimension maintenance."""

from datetime import date, datetime

from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.operators import merge as G

T0 = datetime(2024, 1, 1, 10)
KEY = M.FACT_KEYS["invasion_facts"]


def facts(spark, data):
    return spark.createDataFrame([(T0.date(), s, T0, d, 1, 1, 0, 1) for s, d in data], M.INVASION_FACTS)


def batch(spark, data):
    return spark.createDataFrame([(T0.date(), s, T0, d, 1, 1, 0, 1, a) for s, d, a in data], f"{M.INVASION_FACTS}, arrival bigint")


def test_first_and_last_wins(spark, rows):
    stored, new = facts(spark, [("a", 1)]), batch(spark, [("a", 2, 5), ("b", 3, 7), ("b", 4, 6)])
    assert rows(G.merge_facts(stored, new, KEY), "pokestop", "display_type") == [("a", 1), ("b", 4)]
    assert rows(G.merge_facts(stored, new, KEY, "last"), "pokestop", "display_type") == [("a", 2), ("b", 3)]
    assert rows(G.new_facts(stored, new, KEY), "pokestop", "display_type") == [("b", 4)]


def test_merging_is_idempotent(spark, rows):
    stored, new = facts(spark, [("a", 1)]), batch(spark, [("a", 2, 5), ("b", 3, 7)])
    for keep in ("first", "last"):
        once = G.merge_facts(stored, new, KEY, keep)
        assert rows(G.merge_facts(once, new, KEY, keep)) == rows(once)


def test_copies_collapse_before_the_shuffle(spark):
    """Nine tenths of the rows are one key; each map task sends at most one row of it."""
    rows = spark.range(0, 20_000, 1, 4).select(
        F.lit(date(2024, 1, 1)).alias("day_date"), F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("pokestop"),
        F.lit(T0).cast("timestamp_ntz").alias("seen_at"), F.lit(1).alias("display_type"), F.lit(1).alias("character_id"),
        F.lit(1).alias("grunt"), F.lit(0).alias("confirmed"), F.lit(1).alias("area_id"), F.col("id").alias("arrival"),
    )
    merged = G.merge_facts(spark.createDataFrame([], M.INVASION_FACTS), rows, KEY)
    assert merged.count() == 2001
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_points_newest_wins_then_smallest_coordinates(spark, rows):
    stored = spark.createDataFrame([("g", "Old", 1.0, 1.0), ("k", "Kept", 2.0, 2.0)], M.GYMS)
    new = spark.createDataFrame(
        [("g", "A", 5.0, 5.0, 1), ("g", "B", 9.0, 3.0, 2), ("g", "B", 4.0, 3.0, 2), ("n", "New", None, 3.0, 1)], f"{M.GYMS}, arrival bigint"
    )
    assert rows(G.upsert_points(stored, new, "gym")) == [("g", "B", 4.0, 3.0), ("k", "Kept", 2.0, 2.0)]


def test_shiny_counts_add_up(spark, rows):
    schema = "username string, species int, form string, shiny boolean, area_id int, seen_at timestamp_ntz"
    events = spark.createDataFrame(
        [("u", 1, None, True, 1, T0), ("u", 1, "", True, 1, T0), ("u|v", 1, "0", True, 1, T0), (" ", 1, "0", True, 1, T0),
         ("u", 0, "0", True, 1, T0), ("u", 1, "0", False, 0, T0), (None, 1, "0", True, 1, T0)], schema,
    )
    stored = spark.createDataFrame([(2401, "u", 1, "0", 1, 1, 40)], M.SHINY_MONTHS)
    assert rows(G.accumulate_shiny(stored, events)) == [(2401, "u", 1, "0", 1, 1, 42)]


def test_area_registry(spark, rows):
    known = spark.createDataFrame([(7, "Old Town")], "area_id int, area string")
    names = spark.createDataFrame([(" old   town ",), ("North  Side",), ("north side",), ("East",)], "area string")
    assert rows(G.register_areas(known, names)) == [(7, "Old Town"), (8, "East"), (9, "North Side")]


def test_areas_are_numbered_by_ranges(spark, rows):
    known = spark.createDataFrame([(4, "Old Town")], "area_id int, area string")
    names = spark.createDataFrame([(f"Area {i % 500:03d}",) for i in range(1_500)] + [("old  town",), (" ",), (None,)], "area string")
    got = G.register_areas(known, names)
    assert rows(got) == sorted([(4, "Old Town")] + [(5 + i, f"Area {i:03d}") for i in range(500)], key=repr)
    assert rows(G.register_areas(known, names.limit(0))) == [(4, "Old Town")]
