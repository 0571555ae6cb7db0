"""Queries for sources, sinks and filters."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks.base import END, NOW, START, Frames, query, window
from checks.payload_files import audit_payloads, half_of, write_payloads
from fieldtally import schemas as M
from fieldtally.functions import predicates as P
from fieldtally.operators import audit as A
from fieldtally.operators import merge as G
from fieldtally.plans.selection import area_windows, where_areas
from fieldtally.session import scratch_dir
from fieldtally.sources import areas as SA
from fieldtally.sources import lookups as SL
from fieldtally.sources import tables as ST
from fieldtally.sources.payloads import buffer_rows, read_payloads, routed_raw, stream_buffered, stream_payloads
from fieldtally.sources.storage import remove

# --- A: sources and sinks --------------------------------------------------------------------------------

_TYPE_COUNTS = """
SELECT type, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT 'pokemon' AS type, count(*) AS n FROM lineitem
UNION ALL SELECT 'raid', count(*) FROM orders
UNION ALL SELECT 'quest', count(*) FROM events
UNION ALL SELECT 'invasion', count(*) FROM events
UNION ALL SELECT kind, count(*) FROM nation, (VALUES ('pokemon'), ('raid'), ('quest'), ('invasion'), ('weather')) k(kind) GROUP BY kind) GROUP BY type
"""


@query("A1_read_payloads", _TYPE_COUNTS)
def a1(f: Frames) -> DataFrame:
    return read_payloads(f.spark, write_payloads(f)).groupBy("type").agg(F.count("*").alias("n"))


@query("A2_stream_payloads", _TYPE_COUNTS)
def a2(f: Frames) -> DataFrame:
    out, mark = scratch_dir(f.spark, "arrived"), scratch_dir(f.spark, "mark")
    payloads = write_payloads(f)
    stream = stream_payloads(f.spark, payloads, max_files=half_of(f, payloads)).select("type", "message")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
        availableNow=True
    ).start().awaitTermination()
    return f.spark.read.parquet(out).groupBy("type").agg(F.count("*").alias("n"))


#: streams that flush a buffer side by side
LANES = 8


@query("K2_flush_by_rows", _TYPE_COUNTS)
def k2_flush_by_rows(f: Frames) -> DataFrame:
    """Streams whose micro-batches hold at most so many payloads; ``stream_facts`` takes one as it takes the other. There are many
    micro-batches, each of one task, so that lanes of the buffer are flushed side by side."""
    buffer, out, mark = (scratch_dir(f.spark, label) for label in ("buffer", "by-rows", "by-rows-mark"))
    payloads = write_payloads(f)
    arriving = stream_payloads(f.spark, payloads, max_files=half_of(f, payloads))
    buffer_rows(arriving, buffer, scratch_dir(f.spark, "buffer-mark"), 25_000).awaitTermination()
    remove(f.spark, [payloads])

    def flush(lane: int) -> StreamingQuery:
        rows = stream_buffered(f.spark, buffer, lane=lane, lanes=LANES).select("type", "message")
        flushed = rows.writeStream.format("parquet").option("path", f"{out}/{lane}").option("compression", "zstd")
        return flushed.option("checkpointLocation", f"{mark}/{lane}").trigger(availableNow=True).start()

    flushes = [flush(lane) for lane in range(LANES)]
    try:
        for running in flushes:
            running.awaitTermination()
    finally:
        for running in flushes:
            running.stop()
    remove(f.spark, [buffer])
    rows = [ST.read_table(f.spark, f"{out}/{lane}", "type string, message string") for lane in range(LANES)]
    return reduce(DataFrame.unionByName, rows).groupBy("type").agg(F.count("*").alias("n"))


_ROUTED = {
    "sightings": ("spawnpoint_hex", "species", "lvl", "first_seen"),
    "raids": ("gym", "boss", "lvl", "spawn"),
    "quests": ("pokestop", "task_type", "reward_type", "updated"),
    "invasions": ("pokestop", "display_type", "character_id", "start_ts"),
}


@query(
    "A3_route",
    " UNION ALL ".join(
        f"""SELECT '{fam}' AS family, {p} AS point, {a} AS a, {b} AS b, CAST({t} AS BIGINT) AS t,
            CAST(count(*) AS BIGINT) AS n FROM {fam} GROUP BY ALL"""
        for fam, (p, a, b, t) in _ROUTED.items()
    ),
)
def a3(f: Frames) -> DataFrame:
    frames = routed_raw(read_payloads(f.spark, write_payloads(f)), staged=True)
    out = None
    for family, (point, a, b, t) in _ROUTED.items():
        rows = frames[family].select(
            F.lit(family).alias("family"), F.col(point).alias("point"), F.col(a).alias("a"), F.col(b).alias("b"),
            F.col(t).alias("t"),
        )
        counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


_STRICT = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND lat <> 0 AND lon <> 0"
_FACT_REASON = {
    "sightings": "CAST(NULL AS VARCHAR)",
    "raids": f"CASE WHEN NOT ({_STRICT}) THEN 'strict_coordinates' END",
    "quests": f"""CASE WHEN NOT coalesce(task_type > 0, false) THEN 'no_task'
        WHEN NOT (coalesce(creature_id > 0, false) OR coalesce(item_id > 0, false)) THEN 'no_target'
        WHEN NOT ({_STRICT}) THEN 'strict_coordinates' END""",
    "invasions": f"CASE WHEN NOT ({_STRICT}) THEN 'strict_coordinates' END",
}
_AUDIT = " UNION ALL ".join(
    [f"SELECT '{fam}' AS family, CASE WHEN {r} IS NOT NULL THEN 'fact' END AS level, {r} AS reason FROM {fam}" for fam, r in _FACT_REASON.items()]
    + ["SELECT 'sightings', 'fact', 'spawnpoint_over_64_bits' FROM sightings", "SELECT 'raids', 'fact', 'strict_coordinates' FROM raids",
       "SELECT 'sightings', 'message', 'unreadable' FROM sightings", "SELECT NULL, 'message', 'unknown_type' FROM nation",
       "SELECT 'raids', 'message', 'no_message' FROM nation"]
    + [f"SELECT '{fam}', 'message', '{r}' FROM nation" for fam, r in
       (("sightings", "missing:atk"), ("raids", "missing:ex_eligible"), ("quests", "missing:type"), ("invasions", "missing:display_type"))]
)


@query("A3_rejects", f"SELECT family, level, reason, CAST(count(*) AS BIGINT) AS n FROM ({_AUDIT}) GROUP BY ALL")
def a3_rejects(f: Frames) -> DataFrame:
    """What becomes of every payload; beside the valid ones ids above 64 bits, places at zero, cut and missing messages."""
    return A.reject_counts(A.audited(audit_payloads(f)))


@query(
    "A3_write_rejects",
    f"""SELECT family, level, reason, CAST(count(*) AS BIGINT) AS n FROM ({_AUDIT}) WHERE reason IS NOT NULL GROUP BY ALL
        UNION ALL SELECT family, 'taken', NULL, CAST(count(*) AS BIGINT) FROM ({_AUDIT}) WHERE reason IS NULL GROUP BY ALL""",
)
def a3_write_rejects(f: Frames) -> DataFrame:
    """The stored rejects, and the counts of taken payloads that were observed while they were written."""
    path = f"{scratch_dir(f.spark, 'rejects')}/rows"
    seen = A.write_rejects(audit_payloads(f), path)
    taken = [(family, "taken", None, seen[f"{family}_taken"]) for family in A.FAMILIES]
    stored = A.reject_counts(f.spark.read.schema("type string, message string, reason string, family string, level string").parquet(path))
    return stored.unionByName(f.spark.createDataFrame(taken, "family string, level string, reason string, n bigint"))


@query(
    "A4_load_areas",
    """SELECT area_id, area, offset_hours, CAST(5 AS INT) AS corners, lon0 + 4 AS top_lon, lat0 + 8 AS top_lat FROM areas""",
)
def a4(f: Frames) -> DataFrame:
    """GeoJSON with padded names and MultiPolygon features that must be skipped."""
    point = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    feature = """{"type":"Feature","properties":{"name":"%s","id":%s,"offset_hours":%s},"geometry":{"type":"%s","coordinates":%s}}"""
    rows = f.areas.select(
        F.format_string(
            feature, F.concat(F.lit("  "), "area", F.lit(" ")), F.col("area_id").cast("string"),
            F.col("offset_hours").cast("string"), F.lit("Polygon"), F.to_json(F.array(point)),
        ).alias("good"),
        F.format_string(
            feature, F.col("area"), F.lit("999"), F.lit("0"), F.lit("MultiPolygon"), F.to_json(F.array(F.array(point)))
        ).alias("bad"),
    )
    text = rows.agg(F.concat_ws(",", F.collect_list("good"), F.collect_list("bad")).alias("t")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "t", F.lit("]}")).alias("value")
    )
    path = scratch_dir(f.spark, "areas")
    text.write.text(path)
    top = F.get("ring", F.lit(3))
    return SA.load_areas(f.spark, path).select(
        "area_id", "area", "offset_hours", F.size("ring").alias("corners"), top["lon"].alias("top_lon"),
        top["lat"].alias("top_lat"),
    )


def _written_lookup(f: Frames, kind: str) -> str:
    """One file per language, written from the part table, with the kind in its own section (species: the whole file)."""
    path, section = scratch_dir(f.spark, "lookup"), SL.SECTIONS[kind]
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "name")))
    files = f.lookup(kind).groupBy("lang").agg(entries.alias("names"))
    value = F.col("names") if section is None else F.struct(F.col("names").alias(section))
    files.select("lang", F.to_json(value).alias("value")).write.partitionBy("lang").text(path)
    return path


for _name, _kind in (("A5_load_lookup", "items"), *((f"A5_load_lookup_{k}", k) for k in ("species", "characters", "displays", "quest_types", "rewards"))):

    @query(_name, f"SELECT lang, id, name FROM l_{_kind}")
    def a5(f: Frames, kind: str = _kind) -> DataFrame:
        return SL.load_lookup(f.spark, _written_lookup(f, kind), kind)


@query("A5_load_forms", "SELECT species, CAST(species * 10 + 1 AS INT) AS form, form_name FROM forms")
def a5_forms(f: Frames) -> DataFrame:
    """Upper-case keys; each species also has a form 0, which is dropped, and one key has no species."""
    paths = [scratch_dir(f.spark, name) for name in ("species", "forms")]
    key = F.concat(F.lit("SP"), F.col("species").cast("string"))
    named = F.struct(F.concat(key, F.lit("_"), F.upper("form_name")).alias("k"), (F.col("species") * 10 + 1).alias("v"))
    unset = F.struct(F.concat(key, F.lit("_UNSET")).alias("k"), F.lit(0).alias("v"))
    stray = F.array(F.struct(F.lit("NOBODY_NORMAL").alias("k"), F.lit(7).alias("v")))
    rows = f.forms().agg(
        F.collect_list(F.struct(key.alias("k"), F.col("species").alias("v"))).alias("species"),
        F.concat(F.flatten(F.collect_list(F.array(named, unset))), stray).alias("forms"),
    )
    for path, name in zip(paths, ("species", "forms"), strict=True):
        rows.select(F.to_json(F.map_from_entries(name)).alias("value")).write.text(path)
    return SL.load_forms(f.spark, *paths)


@query("A6_write_facts", "SELECT * FROM sighting_facts")
def a6(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "facts")
    ST.write_facts(f.facts("sighting_facts"), path)
    return ST.read_facts(f.spark, path, "sighting_facts")


@query("A7_write_months", "SELECT * FROM shiny_months")
def a7(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "months")
    ST.write_months(G.shiny_counts(f.events("sightings")), path)
    return ST.read_table(f.spark, path, M.SHINY_MONTHS)


def _older(rows: DataFrame) -> DataFrame:
    """A previous snapshot: every count one too low, taken a day earlier."""
    return rows.withColumns({"cnt": F.col("cnt") - 1, "backed_up_at": P.ntz(datetime(2024, 2, 19, 12))})


@query(
    "A8_snapshot_rollups",
    """SELECT r.area, r.bucket, species, form, metric,
              CASE WHEN r.bucket >= TIMESTAMP '2024-02-13 12:00:00' THEN cnt ELSE cnt - 1 END AS cnt,
              CASE WHEN r.bucket >= TIMESTAMP '2024-02-13 12:00:00' THEN TIMESTAMP '2024-02-20 12:00:00'
                   ELSE TIMESTAMP '2024-02-19 12:00:00' END AS backed_up_at
       FROM r_sightings_hour r""",
)
def a8(f: Frames) -> DataFrame:
    """Hour rollup with a week's retention: recent rows are replaced, older ones stay as they were."""
    current = f.roll("sightings", "hour")
    return ST.snapshot_rollups(current, _older(current), 168, NOW)


@query("A9_restore_rollups", "SELECT * FROM r_sightings_week")
def a9(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "snapshot")
    current = f.roll("sightings", "week")
    ST.write_snapshot(ST.snapshot_rollups(current, None, 0, NOW), path)
    return ST.restore_rollups(f.spark, path)


@query("A10_write_report", "SELECT metric, CAST(sum(cnt) AS BIGINT) AS cnt FROM r_sightings_day GROUP BY metric")
def a10(f: Frames) -> DataFrame:
    path = scratch_dir(f.spark, "report")
    ST.write_report(f.roll("sightings", "day").groupBy("metric").agg(F.sum("cnt").alias("cnt")), path)
    return f.spark.read.schema("metric string, cnt bigint").json(path)


# --- B: filters ------------------------------------------------------------------------------------------
# The test rows are all valid, so every filter gets a copy in which some fields are spoiled by a CASE.

_SPOILED_SIGHTINGS = """
SELECT CASE WHEN arrival % 11 = 0 THEN NULL ELSE species END AS species, form,
       CASE WHEN arrival % 13 = 0 THEN NULL ELSE atk END AS atk, dfn, sta, lvl,
       CASE arrival % 7 WHEN 0 THEN substr(spawnpoint_hex, 1, 7) WHEN 1 THEN concat(' ', spawnpoint_hex, ' ')
            WHEN 2 THEN concat('g', spawnpoint_hex) WHEN 3 THEN repeat(spawnpoint_hex, 4) WHEN 4 THEN ''
            WHEN 5 THEN repeat(substr(spawnpoint_hex, 1, 8), 4) ELSE spawnpoint_hex END AS spawnpoint_hex,
       CASE WHEN arrival % 17 = 0 THEN lat + 100 WHEN arrival % 17 = 1 THEN CAST('NaN' AS DOUBLE) WHEN arrival % 17 = 2 THEN 0.0
            WHEN arrival % 17 = 3 THEN CAST('Infinity' AS DOUBLE) ELSE lat END AS lat,
       CASE WHEN arrival % 19 = 0 THEN lon - 300 WHEN arrival % 19 = 1 THEN NULL WHEN arrival % 19 = 2 THEN 0.0 ELSE lon END AS lon,
       first_seen, CASE WHEN arrival % 23 = 0 THEN NULL ELSE disappear_time END AS disappear_time,
       CASE WHEN arrival % 29 = 0 THEN NULL ELSE verified END AS verified, arrival
FROM sightings
"""
_GOOD_HEX = "regexp_full_match(trim(spawnpoint_hex), '[0-9a-fA-F]{8,32}')"
_GOOD_COORDS = "(NOT isnan(lat) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"


def _spoiled(f: Frames, text: str, family: str) -> DataFrame:
    return f.sql(text.replace(f"FROM {family}", "FROM {src}"), src=f.raw(family))


def _per_key(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("arrival").alias("checksum"))


def _per_key_sql(spoiled: str, test: str, key: str) -> str:
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS n, CAST(sum(arrival) AS BIGINT) AS checksum
               FROM ({spoiled}) WHERE {test} GROUP BY ALL"""


@query(
    "B1_valid_sightings",
    _per_key_sql(
        _SPOILED_SIGHTINGS,
        f"""species IS NOT NULL AND atk IS NOT NULL AND disappear_time IS NOT NULL AND verified IS NOT NULL
            AND {_GOOD_HEX} AND {_GOOD_COORDS}""",
        "species",
    ),
)
def b1(f: Frames) -> DataFrame:
    return _per_key(P.valid_sightings(_spoiled(f, _SPOILED_SIGHTINGS, "sightings")), "species")


@query("B2_valid_spawnpoint", _per_key_sql(_SPOILED_SIGHTINGS, _GOOD_HEX, "spawnpoint_hex"))
def b2(f: Frames) -> DataFrame:
    rows = _spoiled(f, _SPOILED_SIGHTINGS, "sightings")
    return _per_key(rows.where(P.valid_spawnpoint(F.col("spawnpoint_hex"))), "spawnpoint_hex")


@query("B3_valid_coords", _per_key_sql(_SPOILED_SIGHTINGS, _GOOD_COORDS, "lat"))
def b3(f: Frames) -> DataFrame:
    rows = _spoiled(f, _SPOILED_SIGHTINGS, "sightings")
    return _per_key(rows.where(P.valid_coords(F.col("lat"), F.col("lon"))), "lat")


@query("B4_strict_coords", _per_key_sql(_SPOILED_SIGHTINGS, f"{_GOOD_COORDS} AND lat <> 0 AND lon <> 0", "lat"))
def b4(f: Frames) -> DataFrame:
    rows = _spoiled(f, _SPOILED_SIGHTINGS, "sightings")
    return _per_key(rows.where(P.valid_coords(F.col("lat"), F.col("lon"), strict=True)), "lat")


@query(
    "B5_valid_quests",
    """SELECT task_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(arrival) AS BIGINT) AS checksum FROM quests
       WHERE arrival % 7 <> 0 AND arrival % 9 NOT IN (0, 1, 2, 3) GROUP BY ALL""",
)
def b5(f: Frames) -> DataFrame:
    """Spoiled by mode: no rewards, reward without type, without info, or with an item id alone."""
    good = "map('amount', CAST(amount AS STRING), 'pokemon_id', CAST(creature_id AS STRING))"
    rows = f.sql(
        f"""SELECT task_type AS type, task_type, lat, lon, arrival,
                   CASE WHEN arrival % 7 = 0 THEN NULL ELSE with_ar END AS with_ar,
                   CASE arrival % 9
                     WHEN 0 THEN slice(array(struct(reward_type AS type, {good} AS info)), 1, 0)
                     WHEN 1 THEN array(struct(CAST(NULL AS INT) AS type, {good} AS info))
                     WHEN 2 THEN array(struct(reward_type AS type, {good} AS info),
                                       struct(reward_type AS type, CAST(NULL AS MAP<STRING, STRING>) AS info))
                     WHEN 3 THEN array(struct(reward_type AS type, map('item_id', '5') AS info))
                     WHEN 4 THEN array(struct(reward_type AS type, map('amount', '2') AS info))
                     ELSE array(struct(reward_type AS type, {good} AS info)) END AS rewards
            FROM {{q}}""",
        q=f.raw("quests"),
    )
    return _per_key(P.valid_quests(rows), "task_type")


_SPOILED_RAIDS = """
SELECT CASE WHEN arrival % 11 = 0 THEN '  ' ELSE gym END AS gym, CASE WHEN arrival % 13 = 0 THEN 0 ELSE boss END AS boss,
       CASE WHEN arrival % 17 = 0 THEN NULL ELSE lvl END AS lvl, form, costume,
       CASE WHEN arrival % 19 = 0 THEN NULL ELSE exclusive END AS exclusive, ex_eligible, lat, lon, spawn, start_ts,
       CASE WHEN arrival % 23 = 0 THEN NULL ELSE end_ts END AS end_ts,
       CASE arrival % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN 'NULL' ELSE '[1]' END AS rsvps, arrival
FROM raids
"""


@query(
    "B6_valid_raids",
    _per_key_sql(
        _SPOILED_RAIDS,
        """trim(gym) <> '' AND boss <> 0 AND lvl IS NOT NULL AND exclusive IS NOT NULL AND end_ts IS NOT NULL
           AND (rsvps IS NULL OR rsvps <> '[1]')""",
        "gym",
    ),
)
def b6(f: Frames) -> DataFrame:
    return _per_key(P.valid_raids(_spoiled(f, _SPOILED_RAIDS, "raids")), "gym")


_SPOILED_INVASIONS = """
SELECT CASE WHEN arrival % 11 = 0 THEN ' ' ELSE pokestop END AS pokestop,
       CASE WHEN arrival % 13 = 0 THEN NULL ELSE display_type END AS display_type,
       CASE WHEN arrival % 17 = 0 THEN NULL ELSE character_id END AS character_id, confirmed, lat, lon, start_ts, arrival
FROM invasions
"""


@query(
    "B7_valid_invasions",
    _per_key_sql(
        _SPOILED_INVASIONS, "trim(pokestop) <> '' AND display_type IS NOT NULL AND character_id IS NOT NULL", "display_type"
    ),
)
def b7(f: Frames) -> DataFrame:
    return _per_key(P.valid_invasions(_spoiled(f, _SPOILED_INVASIONS, "invasions")), "display_type")


@query("B8_where_in", "SELECT * FROM r_sightings_day WHERE species IN (1, 25, 150)")
def b8(f: Frames) -> DataFrame:
    return P.where_in(f.roll("sightings", "day"), "species", " 1, 25 ,150,x")


@query("B9_where_expr", "SELECT * FROM sighting_facts WHERE iv >= 90 OR iv = 0")
def b9(f: Frames) -> DataFrame:
    return P.where_expr(f.facts("sighting_facts"), "iv", ">=90,==0")


@query("B10_where_buckets", f"SELECT * FROM r_quests_hour WHERE {window()}")
def b10(f: Frames) -> DataFrame:
    return P.where_buckets(f.roll("quests", "hour"), datetime.fromisoformat(START), datetime.fromisoformat(END))


@query(
    "B11_where_seen",
    """SELECT * FROM raid_facts WHERE day_date BETWEEN DATE '2024-01-12' AND DATE '2024-01-15'
       AND seen_at BETWEEN TIMESTAMP '2024-01-12 05:17:00' AND TIMESTAMP '2024-01-15 18:17:00'""",
)
def b11(f: Frames) -> DataFrame:
    return P.where_seen(f.facts("raid_facts"), datetime(2024, 1, 12, 5, 17), datetime(2024, 1, 15, 18, 17))


_WINDOWS = {
    ("2 days", "now"): ("l - INTERVAL 2 DAY", "l"),
    ("1 month", "1 week"): ("l - INTERVAL 1 MONTH", "l - INTERVAL 7 DAY"),
    ("2024-01-05T06:00:00", "90 minutes"): ("TIMESTAMP '2024-01-05 06:00:00'", "l - INTERVAL 90 MINUTE"),
    ("1 year", "30 seconds"): ("l - INTERVAL 1 YEAR", "l - INTERVAL 30 SECOND"),
}


@query(
    "B12_window",
    " UNION ALL ".join(
        f"""SELECT area, '{s}..{e}' AS spec, CAST({a} AS TIMESTAMP) AS from_ts, CAST({b} AS TIMESTAMP) AS to_ts
            FROM (SELECT area, TIMESTAMP '2024-02-20 12:00:00' + to_hours(offset_hours) AS l FROM areas)"""
        for (s, e), (a, b) in _WINDOWS.items()
    ),
)
def b12(f: Frames) -> DataFrame:
    out = None
    for start, end in _WINDOWS:
        rows = area_windows(f.sel(start=start, end=end)).select(
            "area", F.lit(f"{start}..{end}").alias("spec"), F.col("_from").alias("from_ts"), F.col("_to").alias("to_ts")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "B13_where_areas_relative",
    """SELECT r.* FROM r_sightings_hour r JOIN areas a USING (area)
       WHERE bucket >= TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours) - INTERVAL 5 DAY
         AND bucket < TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours)""",
)
def b13(f: Frames) -> DataFrame:
    return where_areas(f.roll("sightings", "hour"), f.sel(start="5 days", end="now"))


@query(
    "B13_where_areas_wide_offset",
    """SELECT r.* FROM r_sightings_hour r WHERE bucket >= TIMESTAMP '2024-02-21 08:00:00' - INTERVAL 5 DAY AND bucket < TIMESTAMP '2024-02-21 08:00:00'""",
)
def b13_wide(f: Frames) -> DataFrame:
    """No bound on offsets: 20 hours for every area."""
    sel = f.sel(start="5 days", end="now")
    return where_areas(f.roll("sightings", "hour"), replace(sel, areas=sel.areas.withColumn("offset_hours", F.lit(20))))


@query(
    "B13_where_areas_stored",
    """SELECT r.* FROM r_raids_hour r JOIN areas a USING (area)
       WHERE bucket >= TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours) - INTERVAL 5 DAY
         AND bucket < TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours)""",
)
def b13_stored(f: Frames) -> DataFrame:
    return where_areas(f.stored_roll("raids", "hour"), f.sel(start="5 days", end="now")).drop("day")


@query(
    "B13_where_areas_list",
    f"SELECT * FROM r_sightings_hour WHERE area IN ('NATION_3', 'NATION_12', 'NATION_20') AND {window()}",
)
def b13_list(f: Frames) -> DataFrame:
    return where_areas(f.roll("sightings", "hour"), f.sel(area="nation_3, Nation_12 ,NATION_20,nowhere"))


@query(
    "B14_where_quest_items",
    """SELECT * FROM quest_item_facts WHERE (mode = 1 AND task_type IN (2, 4, 8) AND item_id IN (1, 4, 7, 16))
       OR (mode = 0 AND item_id IN (1, 4, 7, 10))""",
)
def b14(f: Frames) -> DataFrame:
    return P.where_quest_items(
        f.facts("quest_item_facts"), ar_task_types="2,4,8", ar_item_ids="1,4,7,16", normal_item_ids="1,4,7,10"
    )


@query("B15_where_quest_creatures", "SELECT * FROM quest_creature_facts WHERE mode = 1 AND poke_id IN (2, 8, 14, 20, 50)")
def b15(f: Frames) -> DataFrame:
    return P.where_quest_creatures(f.facts("quest_creature_facts"), ar_poke_ids="2,8,14,20,50")


@query(
    "B16_where_quest_rollup",
    """SELECT * FROM r_quests_day WHERE (mode = 'ar' AND reward_type IN (7, 12)) OR
       (mode = 'normal' AND task_type IN (1, 3, 5) AND (item_id IN (1, 3) OR item_id IS NULL))""",
)
def b16(f: Frames) -> DataFrame:
    return P.where_quest_rollup(
        f.roll("quests", "day"), ar_reward_type="7,12", normal_type="1,3,5", normal_item_id="1,3,None"
    )


@query("B16_where_quest_rollup_ar", "SELECT * FROM r_quests_day WHERE mode = 'ar' AND task_type IN (2, 4)")
def b16_ar(f: Frames) -> DataFrame:
    return P.where_quest_rollup(f.roll("quests", "day"), with_ar="true", ar_type="2,4", normal_type="1")


@query(
    "B17_exclude_keys",
    "SELECT * FROM r_sightings_week WHERE concat(species, ':', form) NOT IN ('25:0', '25:1', '7:2')",
)
def b17(f: Frames) -> DataFrame:
    return P.exclude_keys(f.roll("sightings", "week"), ["25:0", "25:1", "7:2"])


@query(
    "B17_exclude_keys_frame",
    """SELECT * FROM r_sightings_week WHERE concat(species, ':', form) NOT IN
       (SELECT concat(CAST(1 + p_partkey % 151 AS INT), ':0') FROM part WHERE p_size = 7)""",
)
def b17_frame(f: Frames) -> DataFrame:
    hidden = f.table("part").where("p_size = 7").selectExpr("concat(CAST(1 + p_partkey % 151 AS INT), ':0') AS key").distinct()
    return P.exclude_keys(f.roll("sightings", "week"), hidden)


@query(
    "B18_search",
    "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')",
)
def b18(f: Frames) -> DataFrame:
    return P.search(f.table("part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "AL")
