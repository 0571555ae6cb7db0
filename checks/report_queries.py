"""Queries for derived report tables, retention and streaming."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import NOW, Frames, first_by, query
from checks.fact_queries import _INVASION, _RAID, AREA, FROM, TO, heatmap_sql, named_map_sql, shiny_sql
from checks.payload_files import half_of, write_payloads
from checks.rollup_queries import CNT, HOUR, W
from checks.scalars_joins import _CLASS, _named_species
from fieldtally import schemas as M
from fieldtally.operators import derive as D
from fieldtally.operators import merge as G
from fieldtally.operators import retention as RT
from fieldtally.operators.rollups import ROLLUPS, merge_deltas, rollup
from fieldtally.operators.spatial import count_points_by_area
from fieldtally.plans import derived as PD
from fieldtally.plans import maps as PM
from fieldtally.plans import series as PS
from fieldtally.plans import shiny as PH
from fieldtally.plans import totals as PT
from fieldtally.plans.selection import select_rows
from fieldtally.session import scratch_dir
from fieldtally.sources import tables as ST
from fieldtally.sources.payloads import stream_payloads
from fieldtally.streaming import jobs as K

# --- I: derived tables -----------------------------------------------------------------------------------

_DAILY = {
    "sightings": ("metric", []),
    "tth": ("tth_bucket", []),
    "raids": ("unnest(['total', concat('level_', level)])", ["total"]),
    "invasions": ("unnest(['total', CASE WHEN confirmed = 1 THEN 'confirmed' ELSE 'unconfirmed' END])", ["total", "confirmed", "unconfirmed"]),
    "quests": ("unnest(['total', mode])", ["total"]),
}


def daily_sql(family: str, area: str, first: str, last: str) -> str:
    names, fixed = _DAILY[family]
    extra = "".join(f" UNION SELECT '{m}'" for m in fixed)
    return f"""WITH c AS (SELECT day, metric, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
                 SELECT CAST(bucket AS DATE) AS day, {names} AS metric, cnt FROM r_{family}_hour
                 WHERE area = '{area}' AND bucket >= TIMESTAMP '{first}' AND bucket < TIMESTAMP '{last}' + INTERVAL 1 DAY) GROUP BY ALL),
               m AS (SELECT DISTINCT metric FROM c{extra}),
               d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS DATE) AS day)
            SELECT d.day, m.metric, coalesce(c.cnt, 0) AS cnt FROM d CROSS JOIN m LEFT JOIN c ON c.day = d.day AND c.metric = m.metric"""


for _id, _family, _first, _last, _shown in (
    ("I1_daily_sightings", "sightings", date(2023, 11, 1), date(2024, 2, 10), "2023-11-12"),
    ("I1_daily_tth", "tth", date(2024, 1, 5), date(2024, 2, 10), "2024-01-05"),
    ("I2_daily_raids", "raids", date(2024, 1, 5), date(2024, 2, 10), "2024-01-05"),
    ("I3_daily_invasions", "invasions", date(2023, 12, 20), date(2024, 1, 20), "2023-12-20"),
    ("I4_daily_quests", "quests", date(2023, 12, 20), date(2024, 1, 20), "2023-12-20"),
):

    @query(_id, daily_sql(_family, "NATION_24", f"{_shown} 00:00:00", f"{_last} 00:00:00"))
    def daily(f: Frames, family: str = _family, first: date = _first, last: date = _last) -> DataFrame:
        """The first range is longer than 90 days and is cut, as asked for."""
        return PD.daily_series(f.roll(family, "hour"), family, "nation_24", first, last, max_days=90)


for _id, _family in (("I1_daily_sightings_whole", "sightings"), ("I1_daily_tth_whole", "tth"), ("I2_daily_raids_whole", "raids"), ("I4_daily_quests_whole", "quests")):

    @query(_id, daily_sql(_family, "NATION_24", "2023-10-01 00:00:00", "2024-02-10 00:00:00"))
    def daily_whole(f: Frames, family: str = _family) -> DataFrame:
        return PD.daily_series(f.roll(family, "hour"), family, "nation_24", date(2023, 10, 1), date(2024, 2, 10))


_LAST_DAY = """r JOIN areas a USING (area) WHERE bucket >= TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours) - INTERVAL 24 HOUR
    AND bucket < TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours)"""


@query("I5_global_sightings_24h", f"SELECT 'metric' AS section, metric AS key, {CNT} FROM r_sightings_hour {_LAST_DAY} GROUP BY metric")
def i5(f: Frames) -> DataFrame:
    return PD.global_snapshot(f.roll("sightings", "hour"), "sightings", f.sel(start="24 hours", end="now"))


_ALLTIME = "r JOIN areas a USING (area) WHERE bucket >= TIMESTAMP '2024-01-01' AND bucket < TIMESTAMP '2024-02-20 12:00:00' + to_hours(a.offset_hours)"


@query("I5_global_sightings_alltime", f"SELECT 'metric' AS section, metric AS key, {CNT} FROM r_sightings_day {_ALLTIME} GROUP BY metric")
def i5_alltime(f: Frames) -> DataFrame:
    return PD.global_snapshot(f.roll("sightings", "day"), "sightings", f.sel(end="now"))


@query(
    "I6_global_raids",
    f"""SELECT 'total' AS section, 'total' AS key, {CNT} FROM r_raids_hour WHERE {W}
        UNION ALL SELECT 'raid_level', CAST(level AS VARCHAR), {CNT} FROM r_raids_hour WHERE {W} GROUP BY level""",
)
def i6(f: Frames) -> DataFrame:
    return PD.global_snapshot(f.roll("raids", "hour"), "raids", f.sel())


@query(
    "I7_global_invasions",
    f"""WITH c AS (SELECT {_CLASS} AS cls, cnt FROM r_invasions_hour WHERE {W})
        SELECT 'total' AS section, 'total' AS key, {CNT} FROM c
        UNION ALL SELECT 'class', k, CAST(coalesce((SELECT sum(cnt) FROM c WHERE cls = k), 0) AS BIGINT)
        FROM (VALUES ('male'), ('female'), ('cliff'), ('arlo'), ('sierra'), ('giovanni'), ('unset')) v(k)""",
)
def i7(f: Frames) -> DataFrame:
    return PD.global_snapshot(f.roll("invasions", "hour"), "invasions", f.sel())


@query(
    "I8_global_quests",
    f"""WITH c AS (SELECT * FROM r_quests_hour WHERE {W})
        SELECT mode AS section, CASE reward_type WHEN 1 THEN 'xp' WHEN 2 THEN 'item' WHEN 3 THEN 'stardust' WHEN 4 THEN 'candy'
               WHEN 7 THEN 'pokemon' WHEN 12 THEN 'mega' END AS key, {CNT} FROM c WHERE reward_type IN (1, 2, 3, 4, 7, 12) GROUP BY ALL
        UNION ALL SELECT mode, 'total', {CNT} FROM c GROUP BY mode
        UNION ALL SELECT 'total', 'stops', CAST(sum(stops) AS BIGINT) FROM stops_by_area""",
)
def i8(f: Frames) -> DataFrame:
    stops = count_points_by_area(f.points("pokestops"), f.areas, f.index)
    return PD.global_snapshot(f.roll("quests", "hour"), "quests", f.sel(), stops)


def _heat(f: Frames) -> DataFrame:
    return PM.sighting_heatmap(f.facts("sighting_facts"), f.points("spawnpoints"), AREA, FROM, TO)


def _raids(f: Frames) -> DataFrame:
    return PM.raid_map(f.facts("raid_facts"), f.points("gyms"), AREA, FROM, TO)


def _invasions(f: Frames) -> DataFrame:
    return PM.invasion_map(f.facts("invasion_facts"), f.points("pokestops"), AREA, FROM, TO)


HEAT, RAID_MAP, INVASION_MAP = f"({heatmap_sql()})", f"({named_map_sql(*_RAID)})", f"({named_map_sql(*_INVASION)})"


@query(
    "I9_collapse_points",
    f"""SELECT lat, lon, species, form, cn AS name, {CNT}
        FROM {_named_species(HEAT, 'species', 'CAST(form AS INT)')} GROUP BY ALL""",
)
def i9(f: Frames) -> DataFrame:
    return D.with_species_name(PD.collapse_points(_heat(f)), f.lookup("species"), f.forms(), "de").select(
        "lat", "lon", "species", "form", "name", "cnt"
    )


@query(
    "I10_map_summary_sightings",
    f"""WITH h AS {HEAT}
        SELECT 'summary' AS section, 'total' AS key, CAST(sum(cnt) AS BIGINT) AS cnt FROM h
        UNION ALL SELECT 'summary', 'species_forms', count(*) FROM (SELECT DISTINCT species, form FROM h)
        UNION ALL SELECT 'summary', 'spawn_points', count(DISTINCT lat) FROM h
        UNION ALL SELECT 'top', concat(species, ':', form), c FROM (SELECT species, form, CAST(sum(cnt) AS BIGINT) AS c FROM h
                  GROUP BY ALL ORDER BY c DESC, species, form LIMIT 10)""",
)
def i10(f: Frames) -> DataFrame:
    return PD.map_summary(_heat(f), "sightings")


@query(
    "I11_map_summary_raids",
    f"""WITH h AS {RAID_MAP}
        SELECT 'summary' AS section, 'total' AS key, CAST(sum(cnt) AS BIGINT) AS cnt FROM h
        UNION ALL SELECT 'summary', 'gyms', count(DISTINCT gym_name) FROM h
        UNION ALL SELECT 'level', CAST(level AS VARCHAR), CAST(sum(cnt) AS BIGINT) FROM h GROUP BY level
        UNION ALL SELECT 'top', concat(boss, ':', form), c FROM (SELECT boss, form, CAST(sum(cnt) AS BIGINT) AS c FROM h
                  GROUP BY ALL ORDER BY c DESC, boss, form LIMIT 10)""",
)
def i11(f: Frames) -> DataFrame:
    return PD.map_summary(_raids(f), "raids")


@query(
    "I12_map_summary_invasions",
    f"""WITH h AS {INVASION_MAP}
        SELECT 'summary' AS section, 'total' AS key, CAST(sum(cnt) AS BIGINT) AS cnt FROM h
        UNION ALL SELECT 'summary', 'stops', count(DISTINCT pokestop_name) FROM h""",
)
def i12(f: Frames) -> DataFrame:
    return PD.map_summary(_invasions(f), "invasions")


def _flat_items(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("items").alias("rank", "item")).select(*keys, "rank", "item.*")


for _id, _rows, _sql, _dims in (
    ("I13_grid_bins_sightings", _heat, HEAT, ["species", "form"]),
    ("I13_grid_bins_raids", _raids, RAID_MAP, ["boss", "form"]),
    ("I13_grid_bins_invasions", _invasions, INVASION_MAP, ["character_id"]),
):

    @query(
        _id,
        f"""WITH c AS (SELECT CAST(floor(lat / 0.0005) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.0005) AS BIGINT) AS lon_cell,
                              {', '.join(_dims)}, sum(cnt) AS cnt FROM {_sql} GROUP BY ALL),
                 t AS (SELECT lat_cell, lon_cell, sum(cnt) AS total FROM c GROUP BY ALL)
            SELECT lat_cell, lon_cell, CAST(total AS BIGINT) AS total, round(total / (SELECT max(total) FROM t), 6) AS share,
                   CAST(lat_cell * 0.0005 AS DOUBLE) AS lat_min, CAST((lon_cell + 1) * 0.0005 AS DOUBLE) AS lon_max,
                   CAST(row_number() OVER (PARTITION BY lat_cell, lon_cell ORDER BY cnt DESC, {', '.join(_dims)}) - 1 AS INT) AS rank,
                   {', '.join(_dims)}, CAST(cnt AS BIGINT) AS cnt
            FROM c JOIN t USING (lat_cell, lon_cell)""",
    )
    def binned(f: Frames, rows=_rows, dims: list = _dims) -> DataFrame:
        cells = PD.grid_bins(rows(f), dims).withColumns(
            {c: F.round(c, 6) for c in ("share", "lat_min", "lon_max")}
        )
        return _flat_items(cells, "lat_cell", "lon_cell", "total", "share", "lat_min", "lon_max")


@query(
    "I14_heat_intensity",
    f"WITH h AS {HEAT} SELECT h.*, round(cnt / (SELECT max(cnt) FROM h), 6) AS intensity FROM h",
)
def i14(f: Frames) -> DataFrame:
    return PD.heat_intensity(_heat(f)).withColumn("intensity", F.round("intensity", 6))


@query(
    "I15_by_location",
    f"""WITH h AS {HEAT}
        SELECT spawnpoint, lat, lon, CAST(sum(cnt) OVER (PARTITION BY spawnpoint) AS BIGINT) AS total,
               CAST(row_number() OVER (PARTITION BY spawnpoint ORDER BY cnt DESC, species, form) - 1 AS INT) AS rank, species, form, cnt FROM h""",
)
def i15(f: Frames) -> DataFrame:
    return _flat_items(PD.by_location(_heat(f), ["species", "form"]), "spawnpoint", "lat", "lon", "total")


_METRICS = ["total", "iv100", "iv0", "shiny", "pvp_little", "pvp_great", "pvp_ultra"]
_PIVOT = ", ".join(f"CAST(coalesce(sum(CASE WHEN metric = '{m}' THEN cnt END), 0) AS BIGINT) AS {m}" for m in _METRICS)


@query("I16_metric_pivot", f"SELECT species, form, {_PIVOT} FROM r_sightings_hour WHERE {W} GROUP BY ALL")
def i16(f: Frames) -> DataFrame:
    return PD.metric_pivot(PT.sighting_totals(f.roll("sightings", "hour"), f.sel(), "grouped"))


@query(
    "I16_metric_pivot_page",
    f"SELECT species, form, {_PIVOT} FROM r_sightings_hour WHERE {W} GROUP BY ALL ORDER BY total DESC, species, form LIMIT 20 OFFSET 20",
)
def i16_page(f: Frames) -> DataFrame:
    return PD.metric_pivot(PT.sighting_totals(f.roll("sightings", "hour"), f.sel(), "grouped"), "total", number=2, size=20)


@query("I17_metric_totals", f"SELECT metric, {CNT} FROM r_sightings_hour WHERE {W} GROUP BY metric")
def i17(f: Frames) -> DataFrame:
    return PD.metric_totals(PT.sighting_totals(f.roll("sightings", "hour"), f.sel(), "grouped"))


@query("I17_tth_totals_top", f"SELECT tth_bucket AS metric, {CNT} FROM r_tth_hour WHERE {W} GROUP BY ALL ORDER BY cnt DESC, metric LIMIT 5")
def i17_top(f: Frames) -> DataFrame:
    return PD.metric_totals(PT.tth_totals(f.roll("tth", "hour"), f.sel(), "sum"), 5, "tth_bucket")


@query("I18_hourly_chart", f"SELECT {HOUR}, metric, {CNT} FROM r_sightings_hour WHERE {W} GROUP BY ALL")
def i18(f: Frames) -> DataFrame:
    return PD.hourly_chart(PT.sighting_totals(f.roll("sightings", "hour"), f.sel(), "surged"))


def _quest_records(f: Frames) -> DataFrame:
    """Quest series by hour with display names: (hour, name, category, type, cnt)."""
    rows = PS.quest_series(f.roll("quests", "minute"), f.sel(), "surged").groupBy(
        "hour", "task_type", "reward_type", "item_id", "amount", "creature_id", "creature_form"
    ).agg(F.sum("cnt").alias("cnt"))
    named = D.with_reward_name(rows, f.lookup("rewards"), f.lookup("items"), f.lookup("species"), f.forms(), "de")
    return D.with_name(named, "task_type", f.lookup("quest_types"), "de", "Quest Type #", "type").withColumnRenamed(
        "reward_name", "name"
    )


_SERIES_SOURCE = f"""(SELECT {HOUR}, task_type, reward_type, coalesce(item_id, 0) AS item_id, coalesce(amount, 0) AS amount,
    coalesce(creature_id, 0) AS creature_id, coalesce(creature_form, 0) AS creature_form, cnt FROM r_quests_minute WHERE {W})"""
_RECORDS = f"""(SELECT hour, CASE WHEN reward_type = 2 THEN concat(coalesce(i.name, concat('Item #', item_id)), t)
        WHEN reward_type = 7 THEN cn WHEN reward_type IN (4, 9, 12) THEN concat(cn, ' ', cat, t) ELSE concat(cat, t) END AS name,
        cat AS category, coalesce(q.name, concat('Quest Type #', task_type)) AS type, cnt
    FROM (SELECT y.*, coalesce(r.name, concat('Reward Type #', y.reward_type)) AS cat, CASE WHEN amount > 1 THEN concat(' x', amount) ELSE '' END AS t
          FROM {_named_species(_SERIES_SOURCE,
              "CASE WHEN reward_type = 7 OR (reward_type = 12 AND creature_id > 0) THEN creature_id ELSE item_id END",
              "CASE WHEN reward_type = 7 THEN creature_form ELSE 0 END")} y LEFT JOIN n_rewards r ON r.id = y.reward_type) z
    LEFT JOIN n_items i ON i.id = z.item_id LEFT JOIN n_quest_types q ON q.id = z.task_type)"""


@query(
    "I19_top_names_series",
    f"""WITH r AS {_RECORDS}
        SELECT hour, name, category, {CNT} FROM r WHERE name IN (SELECT name FROM r GROUP BY name ORDER BY sum(cnt) DESC, name LIMIT 10)
        GROUP BY ALL""",
)
def i19(f: Frames) -> DataFrame:
    return PD.top_names_series(_quest_records(f))


@query("I20_quest_categories", f"WITH r AS {_RECORDS} SELECT category, {CNT} FROM r GROUP BY ALL")
def i20(f: Frames) -> DataFrame:
    return PD.quest_categories(_quest_records(f))


@query("I20_quest_table_page", f"WITH r AS {_RECORDS} SELECT name, type, category, {CNT} FROM r GROUP BY ALL ORDER BY cnt DESC, name, type, category LIMIT 25 OFFSET 25")
def i20_page(f: Frames) -> DataFrame:
    return PD.quest_table(_quest_records(f), 2, 25)


@query(
    "I21_top_characters",
    f"""WITH r AS (SELECT * FROM r_invasions_hour WHERE {W})
        SELECT 'character' AS section, k AS key, c AS cnt FROM (SELECT CAST(character_id AS VARCHAR) AS k, CAST(sum(cnt) AS BIGINT) AS c, character_id
               FROM r GROUP BY character_id ORDER BY c DESC, character_id LIMIT 15)
        UNION ALL SELECT 'confirmed', CASE WHEN confirmed = 1 THEN 'Confirmed' ELSE 'Unconfirmed' END, {CNT} FROM r GROUP BY confirmed""",
)
def i21(f: Frames) -> DataFrame:
    return PD.top_characters(select_rows(f.roll("invasions", "hour"), f.sel()))


for _id, _rows, _sql, _dims in (
    ("I22_filter_keys_sightings", _heat, HEAT, ["species", "form"]),
    ("I22_filter_keys_raids", _raids, RAID_MAP, ["boss", "form"]),
    ("I22_filter_keys_invasions", _invasions, INVASION_MAP, ["character_id"]),
):

    @query(_id, f"SELECT {', '.join(_dims)}, {CNT} FROM {_sql} GROUP BY ALL")
    def keyed(f: Frames, rows=_rows, dims: list = _dims) -> DataFrame:
        return PD.filter_keys(rows(f), dims)


@query(
    "I23_shiny_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS species_rows, CAST(count(*) FILTER (shiny_pct_pooled > 0) AS BIGINT) AS shiny_eligible,
        CAST(sum(total_encounters) AS BIGINT) AS total_encounters FROM ({shiny_sql('month_year BETWEEN 2401 AND 2402')})""",
)
def i23(f: Frames) -> DataFrame:
    return PH.shiny_summary(PH.shiny_rates(G.shiny_counts(f.events("sightings")), 2401, 2402))


# --- J: retention ----------------------------------------------------------------------------------------

for _id, _family, _grain, _hours in (
    ("J1_expire_minutes", "sightings", "minute", RT.SERIES_HOURS), ("J2_expire_hours", "raids", "hour", RT.HOURLY_HOURS),
    ("J2_keep_all_hours", "raids", "hour", 0), ("J3_expire_days", "sightings", "day", RT.DAILY_HOURS),
):

    @query(_id, f"SELECT * FROM r_{_family}_{_grain}" + (f" WHERE bucket >= TIMESTAMP '{NOW}' - to_hours({_hours})" if _hours else ""))
    def expired(f: Frames, family: str = _family, grain: str = _grain, hours: int = _hours) -> DataFrame:
        return RT.expire_rollup(f.roll(family, grain), NOW, hours)


@query("J1_expire_stored_hours", f"SELECT * FROM r_sightings_hour WHERE bucket >= TIMESTAMP '{NOW}' - to_hours({RT.DAILY_HOURS})")
def j1_stored(f: Frames) -> DataFrame:
    return RT.expire_rollup(f.stored_roll("sightings", "hour"), NOW, RT.DAILY_HOURS).drop("day")


@query("I1_daily_sightings_stored", daily_sql("sightings", "NATION_24", "2024-01-05 00:00:00", "2024-02-10 00:00:00"))
def daily_stored(f: Frames) -> DataFrame:
    return PD.daily_series(f.stored_roll("sightings", "hour"), "sightings", "nation_24", date(2024, 1, 5), date(2024, 2, 10))


@query("J4_keep_days", "SELECT * FROM sighting_facts WHERE day_date >= DATE '2024-02-06'")
def j4(f: Frames) -> DataFrame:
    """On the stored table, so that whole day partitions are skipped."""
    path = scratch_dir(f.spark, "facts")
    ST.write_facts(f.facts("sighting_facts"), path)
    return RT.keep_days(ST.read_facts(f.spark, path, "sighting_facts"), NOW.date(), 15)


@query("J5_keep_months", "SELECT * FROM shiny_months WHERE month_year >= 2402")
def j5(f: Frames) -> DataFrame:
    return RT.keep_months(G.shiny_counts(f.events("sightings")), date(2024, 4, 10), 1, at_least=3)


@query("J5_keep_months_one", "SELECT * FROM shiny_months WHERE month_year >= 2402")
def j5_one(f: Frames) -> DataFrame:
    return RT.keep_months(G.shiny_counts(f.events("sightings")), date(2024, 2, 10), 1)


@query(
    "J6_retention_plan",
    """SELECT DISTINCT CAST(day_date AS VARCHAR) AS partition, CASE WHEN day_date >= DATE '2024-02-06' THEN 'keep' ELSE 'drop' END AS action
       FROM sighting_facts
       UNION ALL SELECT DISTINCT CAST(month_year AS VARCHAR), CASE WHEN month_year >= 2402 THEN 'keep' ELSE 'drop' END FROM shiny_months""",
)
def j6(f: Frames) -> DataFrame:
    days = RT.retention_plan(f.facts("sighting_facts"), NOW.date(), 15, "day")
    months = G.shiny_counts(f.events("sightings"))
    return days.unionByName(RT.retention_plan(months, date(2024, 4, 10), 3, "month"))


@query("J7_expire_snapshot", f"SELECT *, TIMESTAMP '{NOW}' AS backed_up_at FROM r_raids_hour WHERE bucket >= TIMESTAMP '{NOW}' - to_hours(168)")
def j7(f: Frames) -> DataFrame:
    return RT.expire_snapshot(ST.snapshot_rollups(f.roll("raids", "hour"), None, 0, NOW), NOW, 168)


@query(
    "J7_expire_series_snapshot",
    """SELECT *, CASE WHEN hour(bucket) < 12 THEN TIMESTAMP '2024-02-17 06:00:00' ELSE TIMESTAMP '2024-02-17 09:00:00' END AS backed_up_at
       FROM r_raids_minute WHERE hour(bucket) >= 12""",
)
def j7_series(f: Frames) -> DataFrame:
    """72 hours plus 3 hours of grace (half-hour interval: one hour, plus two for a one-hour interval)."""
    stamp = F.when(F.hour("bucket") < 12, F.lit("2024-02-17 06:00:00")).otherwise(F.lit("2024-02-17 09:00:00"))
    snapshot = f.roll("raids", "minute").withColumn("backed_up_at", stamp.cast("timestamp_ntz"))
    return RT.expire_snapshot(snapshot, NOW, 72, 3600)


# --- K: streaming ----------------------------------------------------------------------------------------


def _streamed(f: Frames, job) -> str:
    path, mark = scratch_dir(f.spark, "live"), scratch_dir(f.spark, "mark")
    payloads = write_payloads(f)
    stream = stream_payloads(f.spark, payloads, max_files=half_of(f, payloads))
    job(stream, f.areas, path, mark).awaitTermination()
    return path


_STREAMED = [(family, grain) for family, spec in ROLLUPS.items() for grain in spec.grains]
# the payload writer makes four deliveries by arrival, of which a micro-batch takes two
_BATCHED = """(SELECT *, floor(floor(arrival / (SELECT max(arrival) + 1 FROM sightings) * 4) / 2) AS batch FROM sighting_rows)"""


def values_sql(columns) -> str:
    """All given columns of a row as one text."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


def values_of(columns) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


ALL_ROLLUPS_SQL = " UNION ALL ".join(
    f"SELECT '{fam}' AS family, '{g}' AS grain, area, bucket, {values_sql(ROLLUPS[fam].dims_at(g))} AS dims, metric, cnt FROM r_{fam}_{g}" for fam, g in _STREAMED
)


def all_rollups(read) -> DataFrame:
    """Every rollup with all its dimensions; ``read`` takes family and grain."""
    parts = [
        read(family, grain).select(F.lit(family).alias("family"), F.lit(grain).alias("grain"), "area", "bucket", values_of(ROLLUPS[family].dims_at(grain)).alias("dims"), "metric", "cnt")
        for family, grain in _STREAMED
    ]
    return reduce(DataFrame.unionByName, parts)


@query("K1_stream_rollups", ALL_ROLLUPS_SQL)
def k1(f: Frames) -> DataFrame:
    """Every rollup, from a folded first batch, to which the marker points, and the delta of the second."""
    path, folded = _streamed(f, K.stream_rollups), scratch_dir(f.spark, "folded")
    for family, grain in _STREAMED:
        K.advance(f.spark, path, folded, f"{family}/{grain}", last=0)
        K.drop_folded(f.spark, path, f"{family}/{grain}")
    return all_rollups(lambda family, grain: K.read_rollup(f.spark, path, family, grain))


_FACT_VALUES = {name: [c for c in (field.split()[0] for field in schema.split(",")) if c not in M.FACT_KEYS[name]] for name, schema in M.FACT_SCHEMAS.items()}
_FIRST_SIGHTINGS = f"({first_by(_BATCHED, 'day_date, spawnpoint, seen_at', '*', 'batch, lat, lon, species, form, iv, level, area_id')})"


def all_facts_sql(sightings: str = "sighting_facts") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, {values_sql(M.FACT_KEYS[name])} AS fact, {values_sql(values)} AS held FROM {sightings if name == 'sighting_facts' else name}" for name, values in _FACT_VALUES.items()
    )


def all_facts(read) -> DataFrame:
    """Every fact table with all its columns; ``read`` takes the name."""
    return reduce(DataFrame.unionByName, [read(name).select(F.lit(name).alias("name"), values_of(M.FACT_KEYS[name]).alias("fact"), values_of(values).alias("held")) for name, values in _FACT_VALUES.items()])


@query("K2_stream_facts", all_facts_sql(_FIRST_SIGHTINGS))
def k2(f: Frames) -> DataFrame:
    path = _streamed(f, K.stream_facts)
    return all_facts(lambda name: K.read_facts(f.spark, path, name))


@query("K2_fold_marker", all_facts_sql(_FIRST_SIGHTINGS))
def k2_marker(f: Frames) -> DataFrame:
    """Folded in two steps with the deltas deleted; readers find the folded root by its marker."""
    path, folded = _streamed(f, K.stream_facts), scratch_dir(f.spark, "folded")
    for name in M.FACT_KEYS:
        K.advance(f.spark, path, folded, name, last=0)
        K.advance(f.spark, path, folded, name)
        K.drop_folded(f.spark, path, name)
    return all_facts(lambda name: K.read_facts(f.spark, path, name))


@query("K2_stream_shiny_months", "SELECT * FROM shiny_months")
def k2_shiny(f: Frames) -> DataFrame:
    """From a folded first batch and the delta of the second."""
    path, folded = _streamed(f, K.stream_facts), scratch_dir(f.spark, "folded")
    K.fold_shiny_months(f.spark, path, folded, last=0)
    return K.read_shiny_months(f.spark, path, folded, upto=0)


@query("J4_fold_days", "SELECT * FROM raid_facts WHERE day_date >= DATE '2024-02-06'")
def j4_folded(f: Frames) -> DataFrame:
    """Expired days are left out of the folded facts, after which the deltas are not needed."""
    path, folded = _streamed(f, K.stream_facts), scratch_dir(f.spark, "folded")
    K.fold_facts(f.spark, path, folded, "raid_facts", last=1, keep=lambda rows: RT.keep_days(rows, NOW.date(), 15))
    return K.read_facts(f.spark, path, "raid_facts", folded, upto=1)


@query("K2_stream_points", f"SELECT 'spawnpoint' AS kind, CAST(spawnpoint AS VARCHAR) AS point, '' AS name, lat, lon FROM ({first_by(_BATCHED, 'spawnpoint', '*', 'batch DESC, arrival, lat, lon')}) UNION ALL SELECT 'gym' AS kind, gym AS point, gym_name AS name, lat, lon FROM gyms UNION ALL SELECT 'stop', pokestop, pokestop_name, lat, lon FROM pokestops")
def k2_points(f: Frames) -> DataFrame:
    path, folded = _streamed(f, K.stream_facts), scratch_dir(f.spark, "folded")
    for name in K.POINTS:
        K.fold_points(f.spark, path, folded, name, last=0)
    gyms, stops, spawns = (K.read_points(f.spark, path, name, folded, upto=0) for name in ("gyms", "pokestops", "spawnpoints"))
    spawns = spawns.withColumn("spawnpoint", F.col("spawnpoint").cast("string")).withColumn("name", F.lit(""))
    shape = lambda df, kind, key, name: df.select(F.lit(kind).alias("kind"), F.col(key).alias("point"), F.col(name).alias("name"), "lat", "lon")
    points = shape(gyms, "gym", "gym", "gym_name").unionByName(shape(stops, "stop", "pokestop", "pokestop_name"))
    return points.unionByName(shape(spawns, "spawnpoint", "spawnpoint", "name"))


@query("K3_merge_late_deltas", "SELECT * FROM r_sightings_hour")
def k3(f: Frames) -> DataFrame:
    """Events split into an early and a late delivery of the same hours; the deltas add up."""
    events = f.events("sightings")
    early = rollup(events.where("arrival % 3 <> 0"), "sightings", "hour").withColumn("batch_id", F.lit(0))
    late = rollup(events.where("arrival % 3 = 0"), "sightings", "hour").withColumn("batch_id", F.lit(1))
    return merge_deltas(early.unionByName(late))
