"""Registered queries against their SQL in another engine.

All of them run with FIELDTALLY_ALL=1 (or ``python -m checks.run <dir>``); by default one per area of the inventory.
"""

import os

import duckdb
import pytest

from checks import REGISTRY
from checks.run import compare, tables

SF = os.environ.get("FIELDTALLY_SF", "/root/testdata/sf0.001")
SOME = [
    "A1_read_payloads", "A6_write_facts", "A8_snapshot_rollups", "B1_valid_sightings", "B13_where_areas_relative", "C16_first_reward",
    "C26_reward_name", "D1_assign_area_overlap", "D2_count_points_by_area", "D8_first_coords", "E1_sightings_minute", "E9_weather_iv_month",
    "E11_raids_hour", "F1_sighting_totals_sum_hour", "F4_tth_totals_grouped_hour", "F9_raid_totals_grouped", "F16_quest_totals_surged",
    "F22_quest_series_overview", "G1_sighting_facts", "G2_raid_facts", "G10_register_areas", "H1_sighting_heatmap_top", "H6_shiny_rates",
    "I1_daily_sightings", "I13_grid_bins_sightings", "I19_top_names_series", "J6_retention_plan", "K3_merge_late_deltas",
]
NAMES = list(REGISTRY) if os.environ.get("FIELDTALLY_ALL") else SOME
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    tables(connection, SF)
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_every_inventory_id_is_registered():
    counts = {"A": 10, "B": 18, "C": 31, "D": 9, "E": 21, "F": 23, "G": 10, "H": 6, "I": 23, "J": 7, "K": 3}
    have = {name.split("_")[0] for name in REGISTRY}
    assert not [f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1) if f"{k}{i}" not in have]
