"""Write the test events as payload files, the way they would arrive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.base import Frames
from fieldtally.session import scratch_dir
from fieldtally.sources import bindings as B
from fieldtally.sources.payloads import parsed_once
from fieldtally.sources.storage import children, remove, set_times


Field = Callable[[str], Column]


def _envelope(kind: str, message: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), message.alias("message")))


def _ranks(flag: Column) -> Column:
    return F.when(flag, F.array(F.struct(F.lit(3).alias("rank")), F.struct(F.lit(1).alias("rank")))).otherwise(
        F.array(F.struct(F.lit(2).alias("rank")))
    )


def _named(col: Field, *same: str, **renamed: str) -> list[Column]:
    return [col(c).alias(c) for c in same] + [col(c).alias(name) for name, c in renamed.items()]


def sighting_message(col: Field = F.col) -> Column:
    return F.struct(
        *_named(col, pokemon_id="species", form="form", latitude="lat", longitude="lon", individual_attack="atk"),
        *_named(col, individual_defense="dfn", individual_stamina="sta", pokemon_level="lvl", disappear_time="disappear_time"),
        *_named(col, first_seen="first_seen", spawnpoint_id="spawnpoint_hex", disappear_time_verified="verified"),
        *_named(col, "shiny", "username", "weather"),
        F.struct(*[_ranks(col(f"rank1_{x}")).alias(x) for x in ("great", "little", "ultra")]).alias("pvp"),
    )


def raid_message(col: Field = F.col) -> Column:
    return F.struct(
        *_named(col, gym_id="gym", gym_name="gym_name", latitude="lat", longitude="lon", pokemon_id="boss", level="lvl"),
        *_named(col, form="form", costume="costume", team_id="team"),
        (col("exclusive") == 1).alias("is_exclusive"),
        *_named(col, ex_raid_eligible="ex_eligible", spawn="spawn", start="start_ts", end="end_ts"),
    )


def quest_message(col: Field = F.col) -> Column:
    info = F.struct(*_named(col, pokemon_id="creature_id", form_id="creature_form", item_id="item_id", amount="amount"))
    return F.struct(
        *_named(col, pokestop_name="pokestop_name", pokestop_id="pokestop", latitude="lat", longitude="lon", type="task_type"),
        *_named(col, "with_ar", "updated"),
        F.array(F.struct(*_named(col, type="reward_type"), info.alias("info"))).alias("rewards"),
    )


def invasion_message(col: Field = F.col) -> Column:
    return F.struct(
        *_named(col, pokestop_id="pokestop", pokestop_name="pokestop_name", latitude="lat", longitude="lon"),
        *_named(col, display_type="display_type", character="character_id", grunt_type="grunt"),
        (col("confirmed") == 1).alias("confirmed"), *_named(col, start="start_ts"),
    )


#: family -> (type of its payloads, its message from the columns of a raw row)
MESSAGE = {
    "sightings": ("pokemon", sighting_message), "raids": ("raid", raid_message),
    "quests": ("quest", quest_message), "invasions": ("invasion", invasion_message),
}


def spoiled_messages(f: Frames) -> dict[str, DataFrame]:
    """For each type of payload messages that fail one of its family's checks."""
    nation = f.table("nation").withColumn("arrival", F.col("n_nationkey").cast("bigint"))
    key = F.col("n_nationkey")
    bad = {
        "pokemon": F.struct((key + 1).alias("pokemon_id"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit("xyz").alias("spawnpoint_id")),
        "raid": F.struct(F.lit("gym_1").alias("gym_id"), F.lit(0).alias("pokemon_id"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude")),
        "quest": F.struct(F.lit("stop_1").alias("pokestop_id"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.array().cast("array<struct<type:int>>").alias("rewards")),
        "invasion": F.struct(F.lit("stop_1").alias("pokestop_id"), F.lit(" ").alias("start"), F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude")),
    }
    return {kind: nation.select(message.alias("message"), "arrival") for kind, message in bad.items()}


def payload_rows(f: Frames) -> DataFrame:
    """What :func:`lines_of` makes lines of: all four families, plus messages of a type nobody handles and some that fail their
    checks. Events stay rows of their tables until their file is written, so that no text and nothing derived is sorted and
    shuffled. ``at`` is the arrival of the others."""
    rows = {family: B.source_rows(f.spark, f.sf_dir, family) for family in MESSAGE}
    stop = B.event_of(rows["quests"], "quests")["arrival"], B.event_of(rows["invasions"], "invasions")["arrival"]
    both = rows["quests"].withColumn("_at", stop[0]).join(rows["invasions"].withColumn("_at", stop[1]), "_at").drop("_at")
    nation = f.table("nation")
    unknown = nation.select(_envelope("weather", F.struct("n_name")).alias("other"), F.col("n_nationkey").cast("bigint").alias("at"))
    spoiled = [rows.select(_envelope(kind, F.col("message")).alias("other"), F.col("arrival").alias("at")) for kind, rows in spoiled_messages(f).items()]
    parts = [rows["sightings"], rows["raids"], both, unknown, *spoiled]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def place(f: Frames, rows: DataFrame) -> Column:
    """Position of a row's arrival within its family, from 0 to 1, from the columns of :func:`payload_rows`."""

    def within(found: DataFrame, arrival: Column) -> Column:
        return arrival / F.lit(found.agg(F.max(arrival) + 1).first()[0]).cast("bigint")

    def of(family: str) -> Column:
        return within(B.source_rows(f.spark, f.sf_dir, family), B.event_of(rows, family)["arrival"].cast("bigint"))

    others = within(f.table("nation").select(F.col("n_nationkey").cast("bigint").alias("at")), F.col("at"))
    return F.coalesce(*[of(family) for family in ("sightings", "raids", "quests")], others)


def lines_of(rows: DataFrame) -> DataFrame:
    """The lines of rows: one payload each, or an array of a quest and an invasion."""

    def envelope(family: str) -> Column:
        kind, message = MESSAGE[family]
        event = B.event_of(rows, family)
        return _envelope(kind, message(lambda name: event[name]))

    told = rows
    for family in MESSAGE:
        told = parsed_once(told, **{f"line_{family}": F.when(F.col(family).isNotNull(), envelope(family))})
    pair = F.concat(F.lit("["), F.col("line_quests"), F.lit(","), F.col("line_invasions"), F.lit("]"))
    return told.select(F.coalesce("line_sightings", "line_raids", pair, "other").alias("value"))


def audit_payloads(f: Frames) -> DataFrame:
    """Payloads of all families, and for each kind of reject as many rows as a table has."""

    def payloads(kind: str, rows: DataFrame, message: Column, text: Callable[[Column], Column] = lambda x: x) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), text(F.to_json(message)).alias("message"))

    sightings, raids = f.raw("sightings"), f.raw("raids")
    lines = [payloads(kind, f.raw(family), message()) for family, (kind, message) in MESSAGE.items()]
    lines += [payloads(kind, rows, F.col("message")) for kind, rows in spoiled_messages(f).items()]
    long_ids = sightings.withColumn("spawnpoint_hex", F.concat(F.lit("1"), F.lpad("spawnpoint_hex", 16, "0")))
    lines.append(payloads("pokemon", long_ids, sighting_message()))
    lines.append(payloads("raid", raids.withColumn("lat", F.lit(0.0)), raid_message()))
    lines.append(payloads("pokemon", sightings, sighting_message(), lambda x: F.substring(x, 1, 20)))
    nation = f.table("nation")
    lines.append(nation.select(F.lit("weather").alias("type"), F.lit("{}").alias("message")))
    lines.append(nation.select(F.lit("raid").alias("type"), F.lit(None).cast("string").alias("message")))
    return reduce(DataFrame.unionByName, lines)


#: files of a delivery, written side by side, and the lines of a file from which on there are more of them
FILES = 3
LINES = 250_000


def write_payloads(f: Frames, files: int = 4) -> str:
    """Deliveries of JSON lines in order of arrival, each equally many compressed files, the more the longer the largest is. File
    times decide what is "last", so they are set in the order of the files' names; within a file lines are in order."""
    staged, path = scratch_dir(f.spark, "lines"), scratch_dir(f.spark, "payloads")
    rows = payload_rows(f)
    order = place(f, rows)
    rows = rows.withColumn("part", F.floor(order * files).cast("int"))
    rows.write.partitionBy("part").option("compression", "zstd").parquet(staged)
    rows = f.spark.read.schema(rows.schema).parquet(staged)
    longest = rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    written: list[str] = []
    for part in range(files):
        dealt = rows.where(F.col("part") == part).drop("part").repartitionByRange(max(FILES, -(-longest // LINES)), order)
        sorted_rows = dealt.withColumn("place", order).sortWithinPartitions("place")
        lines_of(sorted_rows).write.mode("append").option("compression", "gzip").text(path)
        known = set(written)
        written += [name for name in children(f.spark, path) if name.startswith("part-") and name not in known]
    remove(f.spark, [staged])
    set_times(f.spark, [f"{path}/{name}" for name in written])
    return path


def half_of(f: Frames, path: str) -> int:
    """Files of half the deliveries of :func:`write_payloads`."""
    return -(-sum(name.startswith("part-") for name in children(f.spark, path)) // 2)
