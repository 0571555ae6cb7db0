"""Explicit schemas. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

#: Arrival envelope. The message stays text until its family is known.
ENVELOPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())])

_RANKS = "array<struct<rank:int>>"

SIGHTING_MESSAGE = f"""
    pokemon_id int, form string, latitude double, longitude double,
    individual_attack int, individual_defense int, individual_stamina int,
    disappear_time bigint, first_seen bigint, spawnpoint_id string, disappear_time_verified boolean,
    cp int, pokemon_level int, gender int, shiny string, size int, username string, weather int,
    pvp struct<great:{_RANKS}, little:{_RANKS}, ultra:{_RANKS}>
"""

RAID_MESSAGE = """
    gym_id string, gym_name string, level string, pokemon_id string, form string, costume string,
    is_exclusive string, ex_raid_eligible string, latitude string, longitude string,
    spawn string, start string, `end` string, team_id int, rsvps string
"""

QUEST_MESSAGE = """
    type int, with_ar boolean, latitude double, longitude double,
    pokestop_id string, pokestop_name string, updated bigint,
    rewards array<struct<type:int, info:map<string,string>>>
"""

INVASION_MESSAGE = """
    display_type int, `character` int, grunt_type int, confirmed string,
    pokestop_id string, pokestop_name string, start string, latitude string, longitude string
"""

#: payload type -> (family, message schema)
MESSAGES = {
    "pokemon": ("sightings", SIGHTING_MESSAGE),
    "raid": ("raids", RAID_MESSAGE),
    "quest": ("quests", QUEST_MESSAGE),
    "invasion": ("invasions", INVASION_MESSAGE),
}

FEATURE_COLLECTION = """
    features array<struct<
        properties: struct<name: string, id: int, offset_hours: int>,
        geometry: struct<type: string, coordinates: string>>>
"""

AREAS = "area_id int, area string, offset_hours int, ring array<struct<lon:double,lat:double>>"

SIGHTING_FACTS = """
    day_date date, spawnpoint bigint, seen_at timestamp_ntz,
    species int, form string, iv int, level int, area_id int
"""
RAID_FACTS = """
    day_date date, gym string, seen_at timestamp_ntz,
    boss int, level int, form string, team int, costume string, exclusive int, ex_eligible int, area_id int
"""
QUEST_ITEM_FACTS = """
    day_date date, pokestop string, seen_at timestamp_ntz, mode int,
    area_id int, task_type int, item_id int, item_amount int
"""
QUEST_CREATURE_FACTS = """
    day_date date, pokestop string, seen_at timestamp_ntz, mode int,
    area_id int, task_type int, poke_id int, poke_form string
"""
INVASION_FACTS = """
    day_date date, pokestop string, seen_at timestamp_ntz,
    display_type int, character_id int, grunt int, confirmed int, area_id int
"""
SHINY_MONTHS = "month_year int, username string, species int, form string, shiny int, area_id int, total_count bigint"

SPAWNPOINTS = "spawnpoint bigint, lat double, lon double"
GYMS = "gym string, gym_name string, lat double, lon double"
POKESTOPS = "pokestop string, pokestop_name string, lat double, lon double"

#: fact table -> key columns (the day comes first: it is also the storage partition)
FACT_KEYS = {
    "sighting_facts": ["day_date", "spawnpoint", "seen_at"],
    "raid_facts": ["day_date", "gym", "seen_at"],
    "quest_item_facts": ["day_date", "pokestop", "seen_at", "mode"],
    "quest_creature_facts": ["day_date", "pokestop", "seen_at", "mode"],
    "invasion_facts": ["day_date", "pokestop", "seen_at"],
}
FACT_SCHEMAS = {
    "sighting_facts": SIGHTING_FACTS,
    "raid_facts": RAID_FACTS,
    "quest_item_facts": QUEST_ITEM_FACTS,
    "quest_creature_facts": QUEST_CREATURE_FACTS,
    "invasion_facts": INVASION_FACTS,
}
SHINY_KEY = ["month_year", "username", "species", "form", "shiny", "area_id"]
