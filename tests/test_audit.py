"""Reasons of refused payloads, and reports that plan their source once."""

import json

from pyspark.sql import functions as F

from fieldtally.operators import audit as A
from fieldtally.operators import merge as G
from fieldtally.operators.ingest import LOCALISE
from fieldtally.plans.derived import heat_intensity
from fieldtally.sources.payloads import routed_raw

SIGHTING = {
    "pokemon_id": 1, "form": "0", "latitude": 1.5, "longitude": 2.5, "individual_attack": 1, "individual_defense": 2,
    "individual_stamina": 3, "disappear_time": 1704067300, "first_seen": 1704067200, "spawnpoint_id": "ab12cd34",
    "disappear_time_verified": True,
}
RAID = {
    "gym_id": "g", "level": 5, "pokemon_id": 9, "form": 0, "costume": 0, "latitude": 1, "longitude": 2, "spawn": 1, "start": 2, "end": 3,
    "is_exclusive": False, "ex_raid_eligible": 0,
}
QUEST = {
    "type": 4, "with_ar": True, "latitude": 1.5, "longitude": 2.5, "pokestop_id": "s", "updated": 1704067200,
    "rewards": [{"type": 2, "info": {"item_id": 5, "amount": 3}}],
}
INVASION = {"display_type": 1, "character": 2, "grunt_type": 3, "confirmed": True, "pokestop_id": "s", "start": 5, "latitude": 1, "longitude": 2}

#: type, changes of a good message, level, reason
CASES = [
    ("pokemon", {}, None, None),
    ("pokemon", {"spawnpoint_id": "f" * 16}, None, None),
    ("pokemon", {"spawnpoint_id": "0" * 8 + "f" * 16}, None, None),
    ("pokemon", {"spawnpoint_id": "1" + "0" * 16}, "fact", "spawnpoint_over_64_bits"),
    ("pokemon", {"spawnpoint_id": "xyz"}, "message", "spawnpoint"),
    ("pokemon", {"spawnpoint_id": None}, "message", "missing:spawnpoint_hex"),
    ("pokemon", {"latitude": 91.0}, "message", "coordinates"),
    ("pokemon", {"latitude": None, "individual_attack": None}, "message", "missing:lat"),
    ("raid", {}, None, None),
    ("raid", {"pokemon_id": 0}, "message", "no_boss"),
    ("raid", {"gym_id": " "}, "message", "blank:gym"),
    ("raid", {"rsvps": "[1]"}, "message", "rsvps"),
    ("raid", {"end": "soon"}, "message", "missing:end_ts"),
    ("raid", {"longitude": 0}, "fact", "strict_coordinates"),
    ("quest", {}, None, None),
    ("quest", {"rewards": []}, "message", "no_reward"),
    ("quest", {"rewards": None}, "message", "no_reward"),
    ("quest", {"rewards": [{"type": 2, "info": {"item_id": 1}}]}, "message", "reward"),
    ("quest", {"latitude": None}, "message", "missing:lat"),
    ("quest", {"type": 0}, "fact", "no_task"),
    ("quest", {"rewards": [{"type": 2, "info": {"amount": 3}}]}, "fact", "no_target"),
    ("quest", {"pokestop_id": "é"}, "fact", "blank:pokestop"),
    ("invasion", {}, None, None),
    ("invasion", {"start": " "}, "message", "missing:start_ts"),
    ("invasion", {"confirmed": None}, "message", "missing:confirmed"),
    ("invasion", {"latitude": 0}, "fact", "strict_coordinates"),
]
GOOD = {"pokemon": SIGHTING, "raid": RAID, "quest": QUEST, "invasion": INVASION}


def payloads(spark):
    rows = [(kind, json.dumps({**GOOD[kind], **change}), i) for i, (kind, change, _, _) in enumerate(CASES)]
    rows += [("weather", "{}", 100), (None, None, 101), ("raid", None, 102), ("raid", "", 103), ("quest", '{"type": 4, "with_ar"', 104), ("raid", "[1]", 105)]
    return spark.createDataFrame(rows, "type string, message string, arrival bigint")


def test_reasons(spark):
    got = {r["arrival"]: (r["level"], r["reason"]) for r in A.audited(payloads(spark)).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2:] for c in CASES]
    assert [got[i][1] for i in range(100, 106)] == ["unknown_type", "unknown_type", "no_message", "unreadable", "unreadable", "unreadable"]
    assert len(got) == len(CASES) + 6


def test_taken_rows_are_those_that_routing_takes(spark):
    rows = payloads(spark)
    counts = {(r["family"], r["level"]): r["n"] for r in A.audited(rows).groupBy("family", "level").agg(F.count("*").alias("n")).collect()}
    place = {"area_id": F.lit(1), "area": F.lit("a"), "offset_hours": F.lit(0)}
    events = {family: LOCALISE[family](frame.withColumns(place)) for family, frame in routed_raw(rows).items()}
    quests = G.quest_fact_rows(events["quests"])
    facts = {"sightings": G.sighting_fact_rows(events["sightings"]), "raids": G.raid_fact_rows(events["raids"]), "quests": quests, "invasions": G.invasion_fact_rows(events["invasions"])}
    for family in A.FAMILIES:
        assert facts[family].count() == counts[family, None]
        assert events[family].count() == counts[family, None] + counts.get((family, "fact"), 0)


def test_rejects_are_stored_and_counted_in_one_pass(spark, tmp_path):
    rows, path = payloads(spark), str(tmp_path / "rejects")
    seen = A.write_rejects(rows, path)
    stored = spark.read.parquet(path)
    assert seen["payloads"] == rows.count() == sum(seen[f"{x}_{y}"] for x in A.FAMILIES for y in ("taken", "without_fact", "refused")) + seen["unknown"]
    assert stored.count() == seen["payloads"] - sum(seen[f"{x}_taken"] for x in A.FAMILIES)
    assert stored.where("family = 'raids' AND level = 'message'").count() == seen["raids_refused"]
    empty = A.write_rejects(rows.limit(0), str(tmp_path / "none"))
    assert empty["payloads"] == 0
    rows.select("type", "message").write.json(str(tmp_path / "lines"))
    plan = A.audited(spark.read.schema("type string, message string").json(str(tmp_path / "lines")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_intensity_runs_its_source_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, 2.0, 3), (1, 2.0, 5), (2, 1.0, 4)], "spawnpoint int, lat double, cnt bigint").write.parquet(path)
    rows = spark.read.parquet(path).groupBy("spawnpoint", "lat").agg(F.sum("cnt").alias("cnt"))
    out = heat_intensity(rows)
    assert sorted((r["spawnpoint"], r["intensity"]) for r in out.collect()) == [(1, 1.0), (2, 0.5)]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text
    assert heat_intensity(rows.where("lat > 9")).collect() == []
