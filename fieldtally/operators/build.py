"""All tables of a load in one batch job: 21 rollups, five fact tables, three point dimensions and the monthly counts.

The payloads are read, parsed and given their area once, into a staged table by family. From there a tree: each family is
counted once for all its finest rollups (grouping sets, one shuffle), hours are folded from minutes, days and weeks from
hours. Facts and points are aggregated from the staged events and read only the columns they need. Stages are written
tables, so a lost executor costs its tasks, not the parse. Independent tables are written side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.functions import scalars as S
from fieldtally.operators import merge as G
from fieldtally.operators.ingest import LOCALISE, Areas, ingest
from fieldtally.operators.rollups import FINEST, FOLDED_FROM, ROLLUPS, coarsen, finest_counts, finest_rollup
from fieldtally.operators.spatial import AreaIndex, assign_area
from fieldtally.session import scratch_dir
from fieldtally.sources.payloads import raw_of, staged_by_family, wide_payloads
from fieldtally.sources.storage import remove
from fieldtally.sources.tables import read_rollup, write_facts, write_months, write_rollup

#: fact tables in which the last row of a key wins; in the others it is the first
LAST_WINS = ("raid_facts",)
#: dimension table -> (key, schema)
POINTS = {
    "spawnpoints": ("spawnpoint", M.SPAWNPOINTS),
    "gyms": ("gym", M.GYMS),
    "pokestops": ("pokestop", M.POKESTOPS),
}
MONTHS = "shiny_user_month"

Events = dict[str, DataFrame]


def with_areas(payloads: DataFrame, areas: Areas) -> DataFrame:
    """Every readable message with its area: one read, one parse and one look-up for all families."""
    return assign_area(wide_payloads(payloads), areas).drop("lat", "lon")


def staged_payloads(payloads: DataFrame, areas: Areas, sender_offset: int = 0, path: str | None = None) -> Events:
    """Localised events of each family, read from a table that one pass over the payloads writes, at ``path`` if it is given."""
    staged = staged_by_family(with_areas(payloads, areas), path)
    return {family: LOCALISE[family](raw_of(staged, family), sender_offset) for family in LOCALISE}


def staged_events(raw: Events, areas: Areas, sender_offset: int = 0) -> Events:
    """The same from raw frames that are already apart by family."""
    out = {}
    for family, rows in raw.items():
        path = scratch_dir(rows.sparkSession, f"events-{family}")
        events = ingest(rows, family, areas, sender_offset)
        events.write.parquet(path)
        out[family] = rows.sparkSession.read.schema(events.schema).parquet(path)
    return out


def fact_rows(events: Events) -> dict[str, DataFrame]:
    quests = G.quest_fact_rows(events["quests"])
    return {
        "sighting_facts": G.sighting_fact_rows(events["sightings"]),
        "raid_facts": G.raid_fact_rows(events["raids"]),
        "quest_item_facts": G.quest_item_rows(quests),
        "quest_creature_facts": G.quest_creature_rows(quests),
        "invasion_facts": G.invasion_fact_rows(events["invasions"]),
    }


def merged_facts(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    empty = spark.createDataFrame([], M.FACT_SCHEMAS[name])
    return G.merge_facts(empty, rows, M.FACT_KEYS[name], "last" if name in LAST_WINS else "first")


def point_rows(events: Events) -> dict[str, DataFrame]:
    facts = fact_rows(events)
    spawnpoints = events["sightings"].select(S.hex_to_id(F.col("spawnpoint_hex")).alias("spawnpoint"), "lat", "lon", "arrival")
    return {
        "spawnpoints": spawnpoints.where("spawnpoint IS NOT NULL"),
        "gyms": facts["raid_facts"],
        "pokestops": G.stop_rows(G.quest_fact_rows(events["quests"]), facts["invasion_facts"]),
    }


def merged_points(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    key, schema = POINTS[name]
    return G.upsert_points(spark.createDataFrame([], schema), rows, key)


def build_rollups(events: Events, path: str) -> list[Callable[[], None]]:
    """Jobs that write each family's rollups in day partitions below ``path/<family>/<grain>``, each job in its order."""

    def source(name: str) -> None:
        spark, counts = events[name].sparkSession, scratch_dir(events[name].sparkSession, f"counts-{name}")
        frame = finest_counts(events[name], name)
        frame.write.partitionBy("family", "grain").option("compression", "zstd").parquet(counts)
        counted = spark.read.schema(frame.schema).parquet(counts)
        shape = {}
        for family, grain in FINEST[name]:
            rolled = finest_rollup(counted, family, grain)
            write_rollup(rolled, f"{path}/{family}/{grain}")
            shape[family] = rolled.schema  # the last one has the dimensions of the coarser grains
        remove(spark, [counts])
        for family in dict.fromkeys(family for family, _ in FINEST[name]):
            for grain in ROLLUPS[family].grains:
                if (family, grain) not in FINEST[name]:
                    finer = read_rollup(spark, f"{path}/{family}/{FOLDED_FROM[grain]}", shape[family]).drop("day")
                    write_rollup(coarsen(finer, grain), f"{path}/{family}/{grain}")

    return [lambda name=name: source(name) for name in FINEST]


def build_facts(events: Events, path: str) -> list[Callable[[], None]]:
    """Jobs that write the facts by day, the points, and the monthly counts by month below ``path/<table>``."""
    spark = events["sightings"].sparkSession
    facts, points = fact_rows(events), point_rows(events)
    jobs: list[Callable[[], None]] = [lambda name=name: write_facts(merged_facts(spark, facts[name], name), f"{path}/{name}", "errorifexists") for name in facts]
    jobs += [lambda name=name: merged_points(spark, points[name], name).write.parquet(f"{path}/{name}") for name in points]
    return [*jobs, lambda: write_months(G.shiny_counts(events["sightings"]), f"{path}/{MONTHS}", "errorifexists")]


def build_tables(events: Events, path: str, at_once: int = 4) -> None:
    """All tables below the new folder ``path``. A job that fails ends the build with its error."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(job) for job in build_rollups(events, path) + build_facts(events, path)]:
            done.result()


def build_all(payloads: DataFrame, areas: DataFrame, path: str, sender_offset: int = 0, at_once: int = 4) -> None:
    """All tables below the new folder ``path``; what was staged for them is deleted when they are written."""
    staged = scratch_dir(payloads.sparkSession, "wide")
    try:
        build_tables(staged_payloads(payloads, AreaIndex.build(areas), sender_offset, staged), path, at_once)
    finally:
        remove(payloads.sparkSession, [staged])
