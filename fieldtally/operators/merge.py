"""Fact and dimension maintenance as pure ``(existing, batch) -> merged`` functions.

Duplicates are resolved by an aggregation on the key, not by a window: copies of one key collapse
before the shuffle, so no task ever holds all rows of a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.functions import scalars as S
from fieldtally.functions.predicates import valid_coords
from fieldtally.operators.derive import quest_kind
from fieldtally.session import scratch_dir


def sighting_fact_rows(events: DataFrame) -> DataFrame:
    """Columns beyond the facts' own (lat, lon) take part in the order within a batch."""
    return events.select(
        F.col("seen_at").cast("date").alias("day_date"),
        S.hex_to_id(F.col("spawnpoint_hex")).alias("spawnpoint"),
        "seen_at", "lat", "lon", "species", "form",
        S.iv_int(F.col("iv")).alias("iv"), F.col("lvl").alias("level"), "area_id",
    ).where(F.col("spawnpoint").isNotNull())


def raid_fact_rows(events: DataFrame) -> DataFrame:
    return events.where(valid_coords(F.col("lat"), F.col("lon"), strict=True) & (F.col("gym") != "")).select(
        F.col("seen_at").cast("date").alias("day_date"), "gym", "seen_at",
        S.clean_text(F.col("gym_name"), pipe=True).alias("gym_name"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        S.to_int(F.col("boss")).alias("boss"), S.to_int(F.col("lvl")).alias("level"),
        "form", S.to_int(F.col("team")).alias("team"),
        "costume", "exclusive", "ex_eligible", "area_id", "arrival",
    )


def quest_fact_rows(events: DataFrame) -> DataFrame:
    """All quest facts with their kind; split with :func:`quest_item_rows` and :func:`quest_creature_rows`."""
    return quest_kind(events).withColumn("day_date", F.col("seen_at").cast("date"))


def quest_item_rows(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'item'").select(
        "day_date", "pokestop", "seen_at", "mode", "area_id", "task_type", "item_id", "item_amount", "arrival"
    )


def quest_creature_rows(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'creature'").select(
        "day_date", "pokestop", "seen_at", "mode", "area_id", "task_type", "poke_id",
        "poke_form", "arrival",
    )


def invasion_fact_rows(events: DataFrame) -> DataFrame:
    stop = S.clean_text(F.col("pokestop"))
    return events.where(valid_coords(F.col("lat"), F.col("lon"), strict=True) & (stop != "")).select(
        F.col("start_at").cast("date").alias("day_date"), stop.alias("pokestop"), F.col("start_at").alias("seen_at"),
        S.clean_text(F.col("pokestop_name"), pipe=True).alias("pokestop_name"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        "display_type", "character_id", S.to_int(F.col("grunt")).alias("grunt"),
        F.col("confirmed").cast("int").alias("confirmed"), "area_id", "arrival",
    )


def dedup_facts(batch: DataFrame, key: list[str], keep: str, columns: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest (``first``) or largest (``last``) by ``order``, then by all values."""
    payload = [c for c in columns if c not in key]
    ranked = F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in payload])
    best = (F.min if keep == "first" else F.max)(ranked).alias("b")
    return batch.groupBy(*key).agg(best).select(
        *[F.col(c) if c in key else F.col(f"b.v_{c}").alias(c) for c in columns]
    )


def merge_facts(existing: DataFrame, batch: DataFrame, key: list[str], keep: str = "first") -> DataFrame:
    """Merge a batch into the facts.

    ``first``: a stored row wins, then the earliest arrival. ``last``: the batch wins, then the latest
    arrival. Batches without ``arrival`` are ordered by their own values.
    """
    columns = existing.columns
    extra = [c for c in batch.columns if c not in columns and c not in ("gym_name", "pokestop_name")]
    order = ["arrival"] if "arrival" in extra else extra
    if "arrival" in extra:
        extra = ["arrival"]
    stored = existing.withColumn("_src", F.lit(0))
    for c in extra:
        stored = stored.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
    rows = stored.unionByName(batch.select(*columns, *extra, F.lit(1).alias("_src")))
    return dedup_facts(rows, key, keep, columns, ["_src", *order])


def new_facts(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """First-wins increment: the batch's rows whose key is not stored yet. Only these need writing."""
    columns = existing.columns
    order = ["arrival"] if "arrival" in batch.columns else [
        c for c in batch.columns if c not in columns and c not in ("gym_name", "pokestop_name")
    ]
    fresh = dedup_facts(batch, key, "first", columns, order)
    return fresh.join(existing.select(*key), key, "left_anti")


def upsert_points(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Insert new points and overwrite changed ones: newest arrival wins, then the smallest coordinates."""
    values = [c for c in existing.columns if c != key]
    names = [c for c in values if c not in ("lat", "lon")]
    rank = [F.col(c) for c in ("_src", "arrival")] + [(-F.col("lat")).alias("nlat"), (-F.col("lon")).alias("nlon")]
    stored = existing.withColumn("_src", F.lit(0)).withColumn(
        "arrival", F.lit(None).cast(batch.schema["arrival"].dataType)
    )
    rows = stored.unionByName(batch.select(key, *values, "arrival", F.lit(1).alias("_src")))
    best = F.max(F.struct(*rank, *names)).alias("b")
    return (
        rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy(key)
        .agg(best)
        .select(
            key,
            *[F.col(f"b.{c}") if c in names else (-F.col(f"b.n{c}")).alias(c) for c in values],
        )
    )


def stop_rows(quest_facts: DataFrame, invasion_rows: DataFrame | None = None) -> DataFrame:
    """Point rows for the stop dimension from both quest kinds and, if given, invasions."""
    columns = ["pokestop", "pokestop_name", "lat", "lon", "arrival"]
    items, creatures = (quest_facts.where(F.col("kind") == k).select(*columns) for k in ("item", "creature"))
    rows = items.unionByName(creatures)
    return rows if invasion_rows is None else rows.unionByName(invasion_rows.select(*columns))


def shiny_counts(events: DataFrame) -> DataFrame:
    """Sightings per user, species, form, shiny flag, area and month."""
    user = S.strip(F.col("username"))
    ok = (
        (user != "") & ~F.col("username").contains("|")
        & (F.col("species") > 0) & (F.col("area_id") > 0) & F.col("seen_at").isNotNull()
    )
    rows = events.where(ok).select(
        S.yymm(F.col("seen_at")).alias("month_year"), user.alias("username"), "species",
        S.clean_form(F.col("form")).alias("form"), S.flag(F.col("shiny")).alias("shiny"), "area_id",
    )
    return rows.groupBy(*M.SHINY_KEY).agg(F.count("*").alias("total_count"))


def sum_shiny(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*M.SHINY_KEY).agg(F.sum("total_count").alias("total_count"))


def accumulate_shiny(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Add the batch's counts to the stored ones."""
    return sum_shiny(existing.select(*M.SHINY_KEY, "total_count").unionByName(shiny_counts(events)))


def numbered(rows: DataFrame, order: str, into: str) -> DataFrame:
    """Adds the place of each row, from 1, by a column of different values. Rows are dealt by ranges and counted per range; only
    these counts meet in one place, and each range is numbered for itself."""
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)  # ranges are drawn once
    kept = spark.read.schema(dealt.schema).parquet(path)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a range
    before = [(r["_part"], sum(x["n"] for x in sizes[:i])) for i, r in enumerate(sizes)]
    starts = spark.createDataFrame(before, "_part int, _before bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before")
    return kept.join(F.broadcast(starts), "_part").withColumn(into, place).drop("_part", "_before")


def register_areas(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Keep known areas, give unseen names the next ids in name order. Inner white space is collapsed.

    Names are compared without regard to case.
    """
    tidy = names.select(S.strip(F.regexp_replace("area", r"\s+", " ")).alias("area")).where("area <> ''")
    unique = tidy.groupBy(F.lower("area").alias("_low")).agg(F.min("area").alias("area"))
    unseen = unique.join(existing.select(F.lower("area").alias("_low")), "_low", "left_anti")
    top = F.coalesce(existing.agg(F.max("area_id")).scalar(), F.lit(0))
    added = numbered(unseen.select("area"), "area", "_place").select((F.col("_place") + top).cast("int").alias("area_id"), "area")
    return existing.select("area_id", "area").unionByName(added)
