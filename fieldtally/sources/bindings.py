"""Event frames derived from the star-schema test tables.

Plain SQL that other engines accept too; the checks run the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AREAS = """
SELECT CAST(n_nationkey AS INT) AS area_id, n_name AS area,
       CAST(n_nationkey % 5 - 2 AS INT) AS offset_hours,
       CAST(10 * (n_nationkey % 5) AS DOUBLE) AS lon0,
       CAST(10 * floor(n_nationkey / 5) AS DOUBLE) AS lat0
FROM nation
"""

SIGHTINGS = """
SELECT CAST(1 + l_partkey % 151 AS INT) AS species,
       CAST(l_linenumber % 3 AS STRING) AS form,
       CAST(CASE (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 40 WHEN 0 THEN 15 WHEN 1 THEN 0
            ELSE (l_orderkey + l_linenumber) % 16 END AS INT) AS atk,
       CAST(CASE (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 40 WHEN 0 THEN 15 WHEN 1 THEN 0
            ELSE (l_partkey + l_linenumber) % 16 END AS INT) AS dfn,
       CAST(CASE (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 40 WHEN 0 THEN 15 WHEN 1 THEN 0
            ELSE (l_orderkey + l_partkey) % 16 END AS INT) AS sta,
       CAST(1 + l_quantity AS INT) AS lvl,
       concat('1', lpad(CAST(l_partkey % 1000 AS STRING), 8, '0')) AS spawnpoint_hex,
       CAST((l_partkey * 37) % 1000 AS DOUBLE) / 20.0 + 0.013 AS lat,
       CAST((l_partkey % 1000 * 91) % 1000 AS DOUBLE) / 20.0 + 0.007 AS lon,
       1704067200 + ((l_orderkey * 13 + l_partkey) % 60) * 86400
         + (l_orderkey * 7919 + l_linenumber * 104729) % 288 * 300 + l_partkey % 1000 % 59 AS first_seen,
       1704067200 + ((l_orderkey * 13 + l_partkey) % 60) * 86400
         + (l_orderkey * 7919 + l_linenumber * 104729) % 288 * 300 + l_partkey % 1000 % 59
         + (l_partkey * 37 + l_orderkey) % 4200 - 120 AS disappear_time,
       l_orderkey % 4 <> 0 AS verified,
       (l_orderkey * 3 + l_partkey) % 64 = 0 AS shiny,
       concat('user_', CAST(l_suppkey % 40 AS STRING)) AS username,
       CAST(l_suppkey % 8 AS INT) AS weather,
       (l_orderkey + l_suppkey) % 11 = 0 AS rank1_little,
       (l_orderkey + l_suppkey) % 13 = 0 AS rank1_great,
       (l_orderkey + l_suppkey) % 17 = 0 AS rank1_ultra,
       l_orderkey * 8 + l_linenumber AS arrival
FROM lineitem
"""

RAIDS = """
SELECT concat('gym_', CAST(o_custkey % 200 AS STRING)) AS gym,
       concat('Gym ', CAST(o_custkey % 150 AS STRING)) AS gym_name,
       CAST((o_custkey % 200 * 41) % 1000 AS DOUBLE) / 20.0 + 0.013 AS lat,
       CAST((o_custkey % 200 * 83) % 1000 AS DOUBLE) / 20.0 + 0.007 AS lon,
       CAST(1 + o_orderkey % 50 AS INT) AS boss,
       CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END AS INT) AS lvl,
       CAST(o_orderkey % 3 AS STRING) AS form,
       CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS STRING) AS costume,
       CAST(o_orderkey % 4 AS INT) AS team,
       CAST(CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END AS INT) AS exclusive,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS ex_eligible,
       1704067200 + (o_orderkey * 613) % 1440 * 3600 + 1020 AS spawn,
       1704067200 + (o_orderkey * 613) % 1440 * 3600 + 1020 + 3600 AS start_ts,
       1704067200 + (o_orderkey * 613) % 1440 * 3600 + 1020 + 6300 AS end_ts,
       o_orderkey AS arrival
FROM orders
"""

QUESTS = """
SELECT concat('stop_', CAST(user_id AS STRING)) AS pokestop,
       concat('Stop ', CAST(user_id % 100 AS STRING)) AS pokestop_name,
       CAST((user_id * 59) % 1000 AS DOUBLE) / 20.0 + 0.013 AS lat,
       CAST((user_id * 67) % 1000 AS DOUBLE) / 20.0 + 0.007 AS lon,
       event_id % 2 = 1 AS with_ar,
       CAST(1 + event_id % 20 AS INT) AS task_type,
       CAST(CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 12 WHEN 4 THEN 4 ELSE 1 END AS INT)
         AS reward_type,
       CAST(CASE event_id % 6 WHEN 0 THEN 1 + event_id % 9 WHEN 3 THEN 1 + event_id % 30
            WHEN 4 THEN 1 + event_id % 40 END AS INT) AS item_id,
       CAST(CASE event_id % 6 WHEN 1 THEN NULL ELSE 1 + event_id % 5 END AS INT) AS amount,
       CAST(CASE event_id % 6 WHEN 1 THEN 1 + event_id % 151 END AS INT) AS creature_id,
       CAST(CASE event_id % 6 WHEN 1 THEN event_id % 3 END AS INT) AS creature_form,
       1704067200 + (CAST(floor(event_id / 8) AS BIGINT) * 2073) % 2592000 AS updated,
       event_id AS arrival
FROM events
"""

INVASIONS = """
SELECT concat('stop_', CAST(user_id AS STRING)) AS pokestop,
       concat('Stop ', CAST(user_id % 100 AS STRING)) AS pokestop_name,
       CAST((user_id * 59) % 1000 AS DOUBLE) / 20.0 + 0.013 AS lat,
       CAST((user_id * 67) % 1000 AS DOUBLE) / 20.0 + 0.007 AS lon,
       CAST(1 + event_id % 3 AS INT) AS display_type,
       CAST(CASE WHEN event_id % 50 = 0 THEN 524 + event_id % 4 ELSE event_id % 48 END AS INT) AS character_id,
       CAST(event_id % 48 AS INT) AS grunt,
       CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS confirmed,
       1704067200 + (CAST(floor(event_id / 8) AS BIGINT) * 2073 + 431) % 2592000 AS start_ts,
       event_id AS arrival
FROM events
"""

FAMILY_SQL = {"sightings": SIGHTINGS, "raids": RAIDS, "quests": QUESTS, "invasions": INVASIONS}
FAMILY_TABLE = {"sightings": "lineitem", "raids": "orders", "quests": "events", "invasions": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Raw (not yet localised) events of one family."""
    name = FAMILY_TABLE[family]
    return spark.sql(FAMILY_SQL[family].replace(f"FROM {name}", "FROM {src}"), src=table(spark, sf_dir, name))


def source_rows(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Rows of a family's table in a struct named after the family, with only the columns that its events are made of."""
    rows = table(spark, sf_dir, FAMILY_TABLE[family])
    return rows.select(F.struct(*[c for c in rows.columns if re.search(rf"\b{c}\b", FAMILY_SQL[family])]).alias(family))


def event_of(rows: DataFrame, family: str) -> Column:
    """The columns of :func:`bind` as a struct, made from those of :func:`source_rows`. It is never null, so that a field of it needs no others."""
    names = "|".join(rows.schema[family].dataType.names)
    fields = FAMILY_SQL[family].partition("SELECT")[2].rpartition("FROM")[0]
    return F.expr(f"struct({re.sub(rf'\b({names})\b', rf'{family}.\1', fields)})")


def bind_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area registry with five-cornered rings."""
    corners = [(0, 0), (8, 0), (8, 5), (4, 8), (0, 5)]
    ring = F.array(
        *[F.struct((F.col("lon0") + x).alias("lon"), (F.col("lat0") + y).alias("lat")) for x, y in corners]
    )
    rows = spark.sql(AREAS.replace("FROM nation", "FROM {src}"), src=table(spark, sf_dir, "nation"))
    return rows.select("area_id", "area", "offset_hours", ring.alias("ring"))
