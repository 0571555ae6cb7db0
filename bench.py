"""Headline timings as one JSON line.

Three groups: ``raw_*`` run from the raw tables to the result; ``build_*`` write the rollup, fact and
dimension tables, one by one (six rollups, two fact tables, two dimensions, months) or, ``build_all``, all 30 tables in one
pass; the others are queries on those written tables, the way a service would run them.
Each figure is the best of ``BENCH_RUNS`` runs (default 2) after one warm-up; builds run once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import REGISTRY  # noqa: E402
from checks.base import Frames  # noqa: E402
from checks.fact_queries import AREA, FROM, TO  # noqa: E402
from fieldtally import schemas as M  # noqa: E402
from fieldtally.operators import build as BD  # noqa: E402
from fieldtally.operators import merge as G  # noqa: E402
from fieldtally.plans import derived as PD  # noqa: E402
from fieldtally.plans import maps as PM  # noqa: E402
from fieldtally.plans import series as PS  # noqa: E402
from fieldtally.plans import shiny as PH  # noqa: E402
from fieldtally.plans import totals as PT  # noqa: E402
from fieldtally.session import build_session, scratch_dir  # noqa: E402
from fieldtally.sources import tables as ST  # noqa: E402

RAW = [
    "D1_assign_area", "E1_sightings_minute", "E2_sightings_hour", "E10_raids_minute", "E14_quests_minute", "E18_invasions_minute",
    "F1_sighting_totals_sum_hour", "F9_raid_totals_grouped", "G1_sighting_facts", "G2_raid_facts", "H1_sighting_heatmap",
]
STORED = [("sightings", "minute"), ("sightings", "hour"), ("tth", "hour"), ("raids", "hour"), ("quests", "hour"), ("invasions", "hour")]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(run, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        begin = time.perf_counter()
        run()
        times.append(time.perf_counter() - begin)
    return round(min(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    frames, out = Frames(spark, sf_dir), {}
    for name in RAW:
        out[f"raw_{name}"] = best(lambda: consume(REGISTRY[name].run(frames)), runs)

    store = scratch_dir(spark, "bench")
    begin = time.perf_counter()
    for family, grain in STORED:
        ST.write_rollup(frames.roll(family, grain), f"{store}/{family}_{grain}")
    out["build_rollups"] = round(time.perf_counter() - begin, 3)
    begin = time.perf_counter()
    for name in ("sighting_facts", "raid_facts"):
        ST.write_facts(frames.facts(name), f"{store}/{name}")
    for name in ("spawnpoints", "gyms"):
        frames.points(name).write.parquet(f"{store}/{name}")
    ST.write_months(G.shiny_counts(frames.events("sightings")), f"{store}/months")
    out["build_facts"] = round(time.perf_counter() - begin, 3)

    begin = time.perf_counter()
    raw = {family: frames.raw(family) for family in ("sightings", "raids", "quests", "invasions")}
    BD.build_tables(BD.staged_events(raw, frames.index), f"{store}/all")
    out["build_all"] = round(time.perf_counter() - begin, 3)

    def read(name: str, schema: str | None = None):
        return ST.read_table(spark, f"{store}/{name}", schema) if schema else spark.read.parquet(f"{store}/{name}")

    facts, raids = read("sighting_facts", M.SIGHTING_FACTS), read("raid_facts", M.RAID_FACTS)
    points, gyms = read("spawnpoints"), read("gyms")
    hour = read("sightings_hour")
    queries = {
        "F1_sighting_totals_sum": lambda: PT.sighting_totals(hour, frames.sel(), "sum"),
        "F3_sighting_totals_surged": lambda: PT.sighting_totals(hour, frames.sel(), "surged"),
        "F4_tth_totals_grouped": lambda: PT.tth_totals(read("tth_hour"), frames.sel(), "grouped"),
        "F9_raid_totals_grouped": lambda: PT.raid_totals(read("raids_hour"), frames.sel(), "grouped"),
        "F12_invasion_totals_grouped": lambda: PT.invasion_totals(read("invasions_hour"), frames.sel(), "grouped"),
        "F16_quest_totals_surged": lambda: PT.quest_totals(read("quests_hour"), frames.sel(), "surged"),
        "F17_sighting_series_surged": lambda: PS.sighting_series(read("sightings_minute"), frames.sel(), "surged"),
        "H1_sighting_heatmap": lambda: PM.sighting_heatmap(facts, points, AREA, FROM, TO),
        "H1_sighting_heatmap_top": lambda: PM.sighting_heatmap(facts, points, AREA, FROM, TO, None, 100),
        "H2_raid_map": lambda: PM.raid_map(raids, gyms, AREA, FROM, TO),
        "H6_shiny_rates": lambda: PH.shiny_rates(read("months", M.SHINY_MONTHS), 2401, 2402),
        "I1_daily_series": lambda: PD.daily_series(hour, "sightings", "nation_24", FROM.date(), TO.date()),
        "I13_grid_bins": lambda: PD.grid_bins(PM.sighting_heatmap(facts, points, AREA, FROM, TO), ["species", "form"]),
    }
    for name, make in queries.items():
        out[name] = best(lambda: consume(make()), runs)
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
