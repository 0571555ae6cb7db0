"""Payload reading, routing and file formats."""

import json

from pyspark.sql import functions as F

from fieldtally.functions.predicates import valid_quests
from fieldtally.sources import areas as SA
from fieldtally.sources import lookups as SL
from fieldtally.sources.payloads import flat_quests, read_payloads, route, routed_raw

QUEST = {"type": 4, "with_ar": True, "latitude": 1.5, "longitude": 2.5, "pokestop_id": "s", "pokestop_name": "S", "updated": 1704067200}


def write(path, items, array=False):
    text = json.dumps(items) if array else "\n".join(json.dumps(i) for i in items)
    path.write_text(text)
    return str(path)


def test_lines_and_arrays(spark, tmp_path):
    items = [{"type": "quest", "message": QUEST}, {"type": "raid", "message": {}}, {"type": "other", "message": {}}]
    lines = read_payloads(spark, write(tmp_path / "lines.json", items))
    assert lines.count() == 3 and lines.select("arrival").distinct().count() == 3
    assert read_payloads(spark, write(tmp_path / "array.json", items, array=True)).count() == 3
    assert read_payloads(spark, write(tmp_path / "array.json", items, array=True), multi_line=True).count() == 3
    assert set(route(lines)) == {"sightings", "raids", "quests", "invasions"}


def quests(spark, tmp_path, *messages):
    path = write(tmp_path / "q.json", [{"type": "quest", "message": m} for m in messages])
    return route(read_payloads(spark, path))["quests"]


def test_reward_rules(spark, tmp_path):
    good = {"type": 2, "info": {"amount": 3}}
    cases = [[], [good], [good, {"type": 2}], [{"type": 7, "info": {"pokemon_id": None}}], [{"type": 2, "info": {"item_id": 1}}], [{"info": {"amount": 1}}]]
    frame = quests(spark, tmp_path, *[{**QUEST, "rewards": r} for r in cases])
    assert valid_quests(frame).count() == 2
    no_key = {k: v for k, v in QUEST.items() if k != "with_ar"}
    frame = quests(spark, tmp_path, {**no_key, "rewards": [good]}, {**QUEST, "with_ar": None, "rewards": [good]})
    assert valid_quests(frame).count() == 1  # a null value is a present key, an absent key is not


def test_first_reward_and_mode(spark, tmp_path, rows):
    two = [{"type": 7, "info": {"pokemon_id": 25, "form_id": 2, "amount": 9}}, {"type": 2, "info": {"item_id": 1, "amount": 3}}]
    item = [{"type": 2, "info": {"item_id": 5, "amount": 3}}]
    frame = quests(spark, tmp_path, {**QUEST, "rewards": two}, {**QUEST, "with_ar": False, "rewards": item}, {**QUEST, "type": None, "rewards": item})
    got = rows(flat_quests(frame), "mode", "task_type", "reward_type", "item_id", "amount", "creature_id", "creature_form")
    assert got == [("ar", 4, 7, None, None, 25, 2), ("normal", 4, 2, 5, 3, None, None), ("normal", None, None, None, None, None, None)]


def test_flags_may_be_boolean_or_number(spark, tmp_path, rows):
    base = {"gym_id": "g", "level": 5, "pokemon_id": 9, "form": 0, "costume": 0, "latitude": 1, "longitude": 2, "spawn": 1, "start": 2, "end": 3}
    items = [{"type": "raid", "message": {**base, "is_exclusive": x, "ex_raid_eligible": y}} for x, y in ((True, 0), (0, "1"), (None, 1))]
    raids = routed_raw(read_payloads(spark, write(tmp_path / "r.json", items)))["raids"]
    assert rows(raids, "exclusive", "ex_eligible", "boss", "lvl") == [(0, 1, 9, 5), (1, 0, 9, 5)]


def test_league_ranks(spark, tmp_path):
    base = {
        "pokemon_id": 1, "form": 163, "latitude": 1.0, "longitude": 2.0, "individual_attack": 15, "individual_defense": 15, "individual_stamina": 15,
        "disappear_time": 10, "first_seen": 5, "spawnpoint_id": "12345678", "disappear_time_verified": True, "shiny": False,
    }
    pvp = {"great": [{"rank": 4}, {"rank": 1}], "little": [{"rank": None}]}
    items = [{"type": "pokemon", "message": {**base, "pvp": pvp}}, {"type": "pokemon", "message": base}]
    got = routed_raw(read_payloads(spark, write(tmp_path / "p.json", items)))["sightings"].orderBy("rank1_great").collect()
    assert [(r.rank1_great, r.rank1_little, r.rank1_ultra, r.form, r.shiny) for r in got] == [(False, False, False, "163", False), (True, False, False, "163", False)]


def test_geojson(spark, tmp_path, rows):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    features = [
        {"properties": {"name": " North  Side "}, "geometry": {"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1], [2, 2]]]}},
        {"properties": {"name": "Multi"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}},
        {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
    ]
    path = write(tmp_path / "a.json", {"data": {"features": features}}, array=True)
    known = spark.createDataFrame([(4, "north side")], "area_id int, area string")
    got = SA.load_areas(spark, path, known)
    assert rows(got, "area_id", "area", F.size("ring")) == [(4, "North  Side", 4), (None, "Unknown", 4)]


def test_lookups_and_forms(spark, tmp_path, rows):
    folder = tmp_path / "quests"
    folder.mkdir()
    write(folder / "en.json", {"types": {"1": "First"}, "items": {"2": "Ball", "x": "skip"}}, array=True)
    write(folder / "de.json", {"types": {}, "items": {"2": "Kugel"}}, array=True)
    assert rows(SL.load_lookup(spark, str(folder), "items")) == [("de", 2, "Kugel"), ("en", 2, "Ball")]
    species = write(tmp_path / "species.json", {"MR": 9, "MR_MIME": 122, "PIKACHU": 25}, array=True)
    forms = write(tmp_path / "forms.json", {"MR_MIME_GALARIAN": 2618, "PIKACHU_5TH_ANNIVERSARY": 7, "PIKACHU": 0, "UNOWN_A": 1}, array=True)
    got = rows(SL.load_forms(spark, species, forms))
    assert got == [(122, 2618, "Galarian"), (25, 7, "5Th Anniversary"), (9, 2618, "Mime Galarian")]
