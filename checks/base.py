"""Shared frames, the query registry and the SQL building blocks of the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.functions.scalars import hex_to_id
from fieldtally.operators import merge as G
from fieldtally.operators.ingest import ingest
from fieldtally.operators.rollups import ROLLUPS, rollup
from fieldtally.operators.spatial import AreaIndex
from fieldtally.plans.selection import Selection
from fieldtally.session import scratch_dir
from fieldtally.sources import bindings as B
from fieldtally.sources.tables import read_rollup, write_rollup

#: "now" of all queries, and the default window
NOW = datetime(2024, 2, 20, 12, 0)
START, END = "2024-01-01T00:00:00", "2024-02-10T00:00:00"


class Frames:
    """The test tables as event frames. Everything is lazy; only the area index's cell size is fixed once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return B.table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def areas(self) -> DataFrame:
        return B.bind_areas(self.spark, self.sf_dir)

    @cached_property
    def index(self) -> AreaIndex:
        return AreaIndex.build(self.areas)

    def raw(self, family: str) -> DataFrame:
        return B.bind(self.spark, self.sf_dir, family)

    def events(self, family: str) -> DataFrame:
        return ingest(self.raw(family), family, self.index)

    def roll(self, family: str, grain: str) -> DataFrame:
        return rollup(self.events(ROLLUPS[family].source), family, grain)

    def stored_roll(self, family: str, grain: str) -> DataFrame:
        """The rollup from a store of day partitions."""
        path = scratch_dir(self.spark, "rollup")
        write_rollup(self.roll(family, grain), path)
        return read_rollup(self.spark, path)

    def sel(self, area: str = "global", start: str = START, end: str = END, **filters) -> Selection:
        return Selection(self.areas, start, end, NOW, area, filters)

    # facts and dimensions of the whole tables
    def facts(self, name: str) -> DataFrame:
        rows, keep = self.fact_rows(name), "last" if name == "raid_facts" else "first"
        empty = self.spark.createDataFrame([], M.FACT_SCHEMAS[name])
        return G.merge_facts(empty, rows, M.FACT_KEYS[name], keep)

    def fact_rows(self, name: str) -> DataFrame:
        if name == "sighting_facts":
            return G.sighting_fact_rows(self.events("sightings"))
        if name == "raid_facts":
            return G.raid_fact_rows(self.events("raids"))
        if name == "invasion_facts":
            return G.invasion_fact_rows(self.events("invasions"))
        quests = G.quest_fact_rows(self.events("quests"))
        return G.quest_item_rows(quests) if name == "quest_item_facts" else G.quest_creature_rows(quests)

    def points(self, name: str) -> DataFrame:
        schema = {"spawnpoints": M.SPAWNPOINTS, "gyms": M.GYMS, "pokestops": M.POKESTOPS}[name]
        key = {"spawnpoints": "spawnpoint", "gyms": "gym", "pokestops": "pokestop"}[name]
        return G.upsert_points(self.spark.createDataFrame([], schema), self.point_rows(name), key)

    def point_rows(self, name: str) -> DataFrame:
        if name == "spawnpoints":
            return self.events("sightings").withColumn("spawnpoint", hex_to_id(F.col("spawnpoint_hex")))
        if name == "gyms":
            return self.fact_rows("raid_facts")
        return G.stop_rows(G.quest_fact_rows(self.events("quests")), self.fact_rows("invasion_facts"))

    # lookups derived from the part table
    def part_names(self, key: str, text: str, lang: str, where: str) -> DataFrame:
        return self.sql(
            f"SELECT '{lang}' AS lang, CAST({key} AS INT) AS id, {text} AS name FROM {{part}} GROUP BY {key} HAVING {where}",
            part=self.table("part"),
        )

    def lookup(self, kind: str) -> DataFrame:
        en, de = LOOKUPS[kind]
        return self.part_names(en[0], en[1], "en", en[2]).unionByName(self.part_names(de[0], de[1], "de", de[2]))

    def forms(self) -> DataFrame:
        return self.sql(FORMS.replace("FROM part", "FROM {part}"), part=self.table("part"))


#: kind -> (key, name, which ids) for English and German
LOOKUPS = {
    "species": (
        ("1 + p_partkey % 151", "min(p_name)", "(1 + p_partkey % 151) % 10 <> 3"),
        ("1 + p_partkey % 151", "concat('DE ', min(p_name))", "(1 + p_partkey % 151) % 2 = 0"),
    ),
    "items": (
        ("1 + p_size % 40", "min(p_type)", "(1 + p_size % 40) % 7 <> 2"),
        ("1 + p_size % 40", "concat('DE ', min(p_type))", "(1 + p_size % 40) % 3 = 0"),
    ),
    "rewards": (
        ("p_size % 13", "min(p_brand)", "p_size % 13 <> 4"),
        ("p_size % 13", "concat('DE ', min(p_brand))", "p_size % 13 < 8"),
    ),
    "characters": (
        ("p_size % 48", "max(p_name)", "p_size % 48 % 5 <> 1"),
        ("p_size % 48", "concat('DE ', max(p_name))", "p_size % 48 % 2 = 1"),
    ),
    "displays": (
        ("1 + p_size % 3", "max(p_brand)", "1 + p_size % 3 <> 3"),
        ("1 + p_size % 3", "concat('DE ', max(p_brand))", "1 + p_size % 3 = 2"),
    ),
    "quest_types": (
        ("1 + p_size % 20", "max(p_type)", "(1 + p_size % 20) % 6 <> 5"),
        ("1 + p_size % 20", "concat('DE ', max(p_type))", "(1 + p_size % 20) % 2 = 0"),
    ),
}
FORMS = """
SELECT CAST(1 + p_partkey % 151 AS INT) AS species, CAST(1 AS INT) AS form, min(p_brand) AS form_name
FROM part GROUP BY 1 + p_partkey % 151 HAVING (1 + p_partkey % 151) % 2 = 1
"""


@dataclass(frozen=True)
class Query:
    run: Callable[[Frames], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None):
    """Register a query with its SQL. The SQL may use the building blocks below by name."""

    def add(run: Callable[[Frames], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(run, None if sql is None else with_blocks(sql))
        return run

    return add


_frames: Frames | None = None


def frames_for(spark: SparkSession, sf_dir: str) -> Frames:
    """One set of lazy frames per session and directory."""
    global _frames
    if _frames is None or _frames.spark is not spark or _frames.sf_dir != sf_dir:
        _frames = Frames(spark, sf_dir)
    return _frames


# ---------------------------------------------------------------------------------------------------------
# SQL building blocks

INSIDE = """
p.lon > a.lon0 AND p.lon < a.lon0 + 8 AND p.lat > a.lat0
AND (p.lat - a.lat0 - 5) * 4 < 3 * (p.lon - a.lon0)
AND (p.lat - a.lat0 - 5) * 4 < 3 * (a.lon0 + 8 - p.lon)
"""


def local(epoch: str, offset: str = "a.offset_hours") -> str:
    return f"make_timestamp(CAST(({epoch} + {offset} * 3600) * 1000000 AS BIGINT))"


BLOCKS: dict[str, str] = {
    "areas": B.AREAS,
    "sightings": B.SIGHTINGS,
    "raids": B.RAIDS,
    "quests": B.QUESTS,
    "invasions": B.INVASIONS,
    "ev_sightings": f"""
        SELECT p.*, a.area_id, a.area, a.offset_hours, {local('p.first_seen')} AS seen_at,
               round((atk + dfn + sta) / 45.0 * 100, 2) AS iv, disappear_time - first_seen AS despawn_s
        FROM sightings p JOIN areas a ON {INSIDE}""",
    "ev_raids": f"""
        SELECT p.*, a.area_id, a.area, a.offset_hours, {local('p.spawn')} AS seen_at,
               {local('p.start_ts')} AS start_at, {local('p.end_ts')} AS end_at, p.lvl AS level
        FROM raids p JOIN areas a ON {INSIDE}""",
    "ev_quests": f"""
        SELECT p.*, a.area_id, a.area, a.offset_hours, {local('p.updated')} AS seen_at,
               CASE WHEN with_ar THEN 'ar' ELSE 'normal' END AS mode
        FROM quests p JOIN areas a ON {INSIDE}""",
    "ev_invasions": f"""
        SELECT p.*, a.area_id, a.area, a.offset_hours, {local('p.start_ts')} AS start_at
        FROM invasions p JOIN areas a ON {INSIDE}""",
    "forms": FORMS,
}
for _kind, (_en, _de) in LOOKUPS.items():
    BLOCKS[f"l_{_kind}"] = " UNION ALL ".join(
        f"SELECT '{lang}' AS lang, CAST({key} AS INT) AS id, {text} AS name FROM part GROUP BY {key} HAVING {where}"
        for lang, (key, text, where) in (("en", _en), ("de", _de))
    )
    BLOCKS[f"n_{_kind}"] = f"""
        SELECT id, coalesce(max(CASE WHEN lang = 'de' THEN name END), max(CASE WHEN lang = 'en' THEN name END)) AS name
        FROM l_{_kind} GROUP BY id"""

SIGHTING_TESTS = {
    "total": "true", "iv100": "iv = 100", "iv0": "iv = 0", "shiny": "shiny",
    "pvp_little": "rank1_little", "pvp_great": "rank1_great", "pvp_ultra": "rank1_ultra",
}
RAID_TESTS = {
    "total": "true", "costume": "costume <> '0'", "exclusive": "exclusive = 1", "ex_raid_eligible": "ex_eligible = 1",
}
IV_BUCKET = """CAST(CASE WHEN iv < 0 OR iv > 100 THEN NULL WHEN iv = 0 THEN 0 WHEN iv = 100 THEN 100 WHEN iv <= 25 THEN 25
    WHEN iv <= 50 THEN 50 WHEN iv <= 75 THEN 75 WHEN iv <= 90 THEN 90 ELSE 95 END AS INT)"""
TTH_BUCKET = """concat(CAST(CAST(floor(despawn_s / 300) AS INT) * 5 AS VARCHAR), '_',
    CAST(CAST(floor(despawn_s / 300) AS INT) * 5 + 5 AS VARCHAR))"""


def _count(source: str, time: str, grain: str, dims: str, tests: dict[str, str], where: str = "true") -> str:
    parts = [
        f"""SELECT area, CAST(date_trunc('{grain}', {time}) AS TIMESTAMP) AS bucket, {dims},
            '{metric}' AS metric, CAST(count(*) AS BIGINT) AS cnt
            FROM {source} WHERE {where} AND {test} GROUP BY ALL"""
        for metric, test in tests.items()
    ]
    return " UNION ALL ".join(parts)


_ONE = {"total": "true"}
for _g in ("minute", "hour", "day", "week"):
    BLOCKS[f"r_sightings_{_g}"] = _count("ev_sightings", "seen_at", _g, "species, form", SIGHTING_TESTS)
    BLOCKS[f"r_tth_{_g}"] = _count(
        "ev_sightings", "seen_at", _g, f"{TTH_BUCKET} AS tth_bucket", _ONE, "verified AND despawn_s > 0 AND despawn_s < 3600"
    )
    _minute = _g == "minute"
    BLOCKS[f"r_raids_{_g}"] = _count(
        "ev_raids", "start_at", _g, "boss, level, form" + ("" if _minute else ", costume, exclusive, ex_eligible"),
        RAID_TESTS if _minute else _ONE,
    )
    BLOCKS[f"r_quests_{_g}"] = _count(
        "ev_quests", "seen_at", _g, "mode, task_type, reward_type, item_id, amount, creature_id, creature_form", _ONE
    )
    BLOCKS[f"r_invasions_{_g}"] = _count(
        "ev_invasions", "start_at", _g,
        "display_type, grunt, confirmed" if _minute else "display_type, character_id, grunt, confirmed", _ONE,
    )
BLOCKS["r_weather_iv_month"] = _count(
    "ev_sightings", "seen_at", "month",
    f"CAST(CASE WHEN weather <> 0 THEN 1 ELSE 0 END AS INT) AS weather_flag, {IV_BUCKET} AS iv_bucket", _ONE,
)


def first_by(source: str, key: str, columns: str, order: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
        FROM {source}) WHERE rn = 1"""


HEX_ID = "CAST(CAST(concat('0x', spawnpoint_hex) AS BIGINT) AS BIGINT)"
BLOCKS.update(
    {
        "sighting_rows": f"""
            SELECT CAST(seen_at AS DATE) AS day_date, {HEX_ID} AS spawnpoint, seen_at, lat, lon, species, form,
                   CAST(round(iv) AS INT) AS iv, lvl AS level, area_id, arrival FROM ev_sightings""",
        "sighting_facts": first_by(
            "sighting_rows", "day_date, spawnpoint, seen_at",
            "day_date, spawnpoint, seen_at, species, form, iv, level, area_id",
            "lat, lon, species, form, iv, level, area_id",
        ),
        "raid_rows": """
            SELECT CAST(seen_at AS DATE) AS day_date, gym, seen_at, gym_name, lat, lon, boss, level, form, team, costume,
                   exclusive, ex_eligible, area_id, arrival FROM ev_raids""",
        "raid_facts": first_by(
            "raid_rows", "day_date, gym, seen_at",
            "day_date, gym, seen_at, boss, level, form, team, costume, exclusive, ex_eligible, area_id",
            "arrival DESC",
        ),
        "quest_rows": """
            SELECT CAST(seen_at AS DATE) AS day_date, pokestop, pokestop_name, lat, lon, seen_at,
                   CAST(CASE WHEN with_ar THEN 1 ELSE 0 END AS INT) AS mode, area_id, task_type,
                   CASE WHEN creature_id > 0 THEN 'creature' ELSE 'item' END AS kind, item_id,
                   CAST(CASE WHEN amount > 0 THEN amount ELSE 1 END AS INT) AS item_amount,
                   creature_id AS poke_id, coalesce(CAST(creature_form AS VARCHAR), '0') AS poke_form, arrival
            FROM ev_quests WHERE creature_id > 0 OR item_id > 0""",
        "quest_item_rows": "SELECT * FROM quest_rows WHERE kind = 'item'",
        "quest_creature_rows": "SELECT * FROM quest_rows WHERE kind = 'creature'",
        "quest_item_facts": first_by(
            "quest_item_rows", "day_date, pokestop, seen_at, mode",
            "day_date, pokestop, seen_at, mode, area_id, task_type, item_id, item_amount", "arrival",
        ),
        "quest_creature_facts": first_by(
            "quest_creature_rows", "day_date, pokestop, seen_at, mode",
            "day_date, pokestop, seen_at, mode, area_id, task_type, poke_id, poke_form", "arrival",
        ),
        "invasion_rows": """
            SELECT CAST(start_at AS DATE) AS day_date, pokestop, pokestop_name, lat, lon, start_at AS seen_at, display_type,
                   character_id, grunt, confirmed, area_id, arrival FROM ev_invasions""",
        "invasion_facts": first_by(
            "invasion_rows", "day_date, pokestop, seen_at",
            "day_date, pokestop, seen_at, display_type, character_id, grunt, confirmed, area_id", "arrival",
        ),
        "spawnpoints": first_by("sighting_rows", "spawnpoint", "spawnpoint, lat, lon", "arrival DESC, lat, lon"),
        "gyms": first_by("raid_rows", "gym", "gym, gym_name, lat, lon", "arrival DESC, lat, lon"),
        "stop_rows": """
            SELECT pokestop, pokestop_name, lat, lon, arrival FROM quest_rows
            UNION ALL SELECT pokestop, pokestop_name, lat, lon, arrival FROM invasion_rows""",
        "pokestops": first_by("stop_rows", "pokestop", "pokestop, pokestop_name, lat, lon", "arrival DESC, lat, lon"),
        "shiny_months": """
            SELECT CAST(year(seen_at) % 100 * 100 + month(seen_at) AS INT) AS month_year, username, species, form,
                   CAST(CASE WHEN shiny THEN 1 ELSE 0 END AS INT) AS shiny, area_id, CAST(count(*) AS BIGINT) AS total_count
            FROM ev_sightings WHERE area_id > 0 GROUP BY ALL""",
        "stops_by_area": f"""
            SELECT a.area_id, a.area, CAST(count(p.pokestop) AS BIGINT) AS stops
            FROM areas a LEFT JOIN pokestops p ON {INSIDE} GROUP BY ALL""",
    }
)


def window(start: str = START, end: str = END, col: str = "bucket") -> str:
    return f"{col} >= TIMESTAMP '{start}' AND {col} < TIMESTAMP '{end}'"


def with_blocks(sql: str) -> str:
    """Prefix the building blocks a text needs, in order of dependency."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in BLOCKS and word not in ordered and re.search(rf"\b(?:FROM|JOIN|,)\s+{word}\b", text):
                need(BLOCKS[word])
                ordered.append(word)

    need(sql)
    if not ordered:
        return sql
    blocks = ",\n".join(f"{name} AS ({BLOCKS[name]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {blocks},\n{body[5:]}"
    return f"WITH {blocks}\n{body}"
