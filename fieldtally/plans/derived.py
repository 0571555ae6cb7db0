"""Report tables derived from rollup queries and map reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import fixed_values as V
from fieldtally.functions.predicates import where_days
from fieldtally.operators.derive import with_character_class, with_reward_class
from fieldtally.plans.selection import Selection, where_areas

def daily_series(hour_rollup: DataFrame, family: str, area: str, start: date, end: date, max_days: int | None = None) -> DataFrame:
    """One value per day and metric, zero-filled. ``max_days`` moves the start of a longer range to so many days before
    its end.

    Metrics: the rollup's own for ``sightings`` and ``tth``; ``total`` and ``level_<n>`` for raids;
    ``total, confirmed, unconfirmed`` for invasions; ``total`` and the modes for quests.
    """
    if start > end:
        raise ValueError("the first day is after the last")
    if max_days is not None:
        start = max(start, end - timedelta(days=max_days))
    day = F.col("bucket").cast("date")
    rows = where_days(hour_rollup, F.lit(start), F.lit(end)).where((F.lower("area") == area.lower()) & day.between(F.lit(start), F.lit(end)))
    names = {
        "sightings": F.array("metric"),
        "tth": F.array("tth_bucket"),
        "raids": F.array(F.lit("total"), F.concat(F.lit("level_"), F.col("level").cast("string"))),
        "invasions": F.array(F.lit("total"), F.when(F.col("confirmed") == 1, "confirmed").otherwise("unconfirmed")),
        "quests": F.array(F.lit("total"), F.col("mode")),
    }[family]
    counts = (
        rows.select(day.alias("day"), F.explode(names).alias("metric"), "cnt")
        .groupBy("day", "metric")
        .agg(F.sum("cnt").alias("cnt"))
    )
    metrics = counts.select("metric").distinct()
    always = {"raids": ["total"], "invasions": ["total", "confirmed", "unconfirmed"], "quests": ["total"]}.get(family)
    if always:
        fixed = hour_rollup.sparkSession.createDataFrame([(m,) for m in always], "metric string")
        metrics = metrics.union(fixed).distinct()
    calendar = metrics.withColumn("day", F.explode(F.sequence(F.lit(start), F.lit(end))))
    return calendar.join(counts, ["day", "metric"], "left").select(
        "day", "metric", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def global_snapshot(rollup: DataFrame, family: str, sel: Selection, stops: DataFrame | None = None) -> DataFrame:
    """Sums over all areas as rows ``(section, key, cnt)``."""
    rows = where_areas(rollup, sel)
    if family == "sightings":
        return _sections(rows.select(F.array(_entry("metric", F.col("metric"))).alias("e"), "cnt"))
    if family == "raids":
        level = _entry("raid_level", F.col("level").cast("string"))
        return _sections(rows.select(F.array(_entry("total", F.lit("total")), level).alias("e"), "cnt"))
    if family == "invasions":
        named = with_character_class(rows)
        sums = [
            F.coalesce(F.sum(F.when(F.col("character_class") == c, F.col("cnt"))), F.lit(0)).alias(c)
            for c in V.CHARACTER_CLASS_ORDER
        ]
        wide = named.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), *sums)
        return wide.unpivot([], ["total", *V.CHARACTER_CLASS_ORDER], "key", "cnt").select(
            F.when(F.col("key") == "total", "total").otherwise("class").alias("section"), "key", "cnt"
        )
    if family == "quests":
        return _quest_snapshot(rows, stops)
    raise ValueError(f"no snapshot for {family!r}")


def _entry(section: str, key):
    return F.struct(F.lit(section).alias("section"), key.alias("key"))


def _sections(entries: DataFrame) -> DataFrame:
    return entries.select(F.inline("e"), "cnt").groupBy("section", "key").agg(F.sum("cnt").alias("cnt"))


def _quest_snapshot(rows: DataFrame, stops: DataFrame | None) -> DataFrame:
    by_type = rows.groupBy("mode", "reward_type").agg(F.sum("cnt").alias("cnt"))
    classes = (
        with_reward_class(by_type)
        .groupBy(F.col("mode").alias("section"), F.col("reward_class").alias("key"))
        .agg(F.sum("cnt").alias("cnt"))
    )
    sums = [F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("cnt"))), F.lit(0)).alias(m) for m in ("ar", "normal")]
    totals = by_type.agg(*sums).unpivot([], ["ar", "normal"], "section", "cnt")
    out = classes.unionByName(totals.select("section", F.lit("total").alias("key"), "cnt"))
    if stops is not None:
        all_stops = stops.agg(F.coalesce(F.sum("stops"), F.lit(0)).alias("cnt"))
        out = out.unionByName(all_stops.select(F.lit("total").alias("section"), F.lit("stops").alias("key"), "cnt"))
    return out


def collapse_points(rows: DataFrame) -> DataFrame:
    """Sum map rows by coordinates, species and form."""
    return rows.groupBy("lat", "lon", "species", "form").agg(F.sum("cnt").alias("cnt"))


_SUMMARY = {
    # family: (top dimensions, {counter name: columns}, per-value section or None)
    "sightings": (["species", "form"], {"species_forms": ["species", "form"], "spawn_points": ["lat"]}, None),
    "raids": (["boss", "form"], {"gyms": ["gym_name"]}, "level"),
    "invasions": (None, {"stops": ["pokestop_name"]}, None),
}


def map_summary(rows: DataFrame, family: str, top: int = 10) -> DataFrame:
    """Headline numbers of a map report as rows ``(section, key, cnt)``."""
    dims, distinct, per_value = _SUMMARY[family]
    counters = {name: F.count_distinct(*[F.col(c) for c in cols]) for name, cols in distinct.items()}
    head = rows.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), *[c.alias(n) for n, c in counters.items()]
    )
    out = head.unpivot([], ["total", *counters], "key", "cnt").select(F.lit("summary").alias("section"), "key", "cnt")
    if per_value:
        values = rows.groupBy(F.col(per_value).cast("string").alias("key")).agg(F.sum("cnt").alias("cnt"))
        out = out.unionByName(values.select(F.lit(per_value).alias("section"), "key", "cnt"))
    if dims:
        leaders = rows.groupBy(*dims).agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), *dims).limit(top)
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in dims])
        out = out.unionByName(leaders.select(F.lit("top").alias("section"), key.alias("key"), "cnt"))
    return out


def _items(dims: list[str]):
    """Breakdown list, largest first. Collected only over already summed rows, one per dimension tuple."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), *dims)))
    return F.transform(ranked, lambda s: F.struct(*[s[d].alias(d) for d in dims], (-s["neg"]).alias("cnt")))


def grid_bins(rows: DataFrame, dims: list[str], step: float = V.GRID_STEP) -> DataFrame:
    """Totals per grid cell with bounds, the cell's breakdown and its share of the densest cell."""
    cell = [F.floor(F.col(c) / F.lit(step)).cast("bigint").alias(f"{c}_cell") for c in ("lat", "lon")]
    keys = ["lat_cell", "lon_cell"]
    summed = rows.select(*cell, *dims, "cnt").groupBy(*keys, *dims).agg(F.sum("cnt").alias("cnt"))
    cells = summed.groupBy(*keys).agg(F.sum("cnt").alias("total"), _items(dims).alias("items"))
    peak = summed.groupBy(*keys).agg(F.sum("cnt").alias("t")).agg(F.max("t")).scalar()  # from the same exchange
    bounds = {
        f"{axis}_{end}": (F.col(f"{axis}_cell") + i) * step for axis in ("lat", "lon") for i, end in enumerate(("min", "max"))
    }
    return cells.withColumns({**bounds, "share": F.col("total") / peak})


def heat_intensity(rows: DataFrame) -> DataFrame:
    """Each point's count as a share of the largest; the maximum is a scalar subquery.

    It asks for whole rows, so that the report's plan below it is the same one, and its last exchange serves both.
    """
    rest = [c for c in rows.columns if c != "cnt"]
    peak = rows.agg(F.max(F.struct("cnt", *rest))["cnt"].alias("cnt")).select(F.greatest("cnt", F.lit(1))).scalar()
    return rows.withColumn("intensity", F.col("cnt") / peak)


def by_location(rows: DataFrame, dims: list[str], key: list[str] | None = None) -> DataFrame:
    """Per spawnpoint (or coordinates): total and list of what appears there, largest first."""
    key = key or (["spawnpoint"] if "spawnpoint" in rows.columns else ["lat", "lon"])
    place = [F.min(c).alias(c) for c in ("lat", "lon") if c not in key]
    summed = rows.groupBy(*key, *dims).agg(F.sum("cnt").alias("cnt"), *place)
    return summed.groupBy(*key).agg(*place, F.sum("cnt").alias("total"), _items(dims).alias("items"))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an ordered frame."""
    return df.offset((number - 1) * size).limit(size)


def metric_pivot(
    rows: DataFrame, sort: str | None = None, ascending: bool = False, number: int = 1, size: int | None = None
) -> DataFrame:
    """Species and form against the sighting metrics, absent combinations as 0."""
    keys = [c for c in ("species", "form", "name") if c in rows.columns]
    table = rows.groupBy(*keys).pivot("metric", V.SIGHTING_METRICS).agg(F.sum("cnt")).na.fill(0)
    if sort is None and size is None:
        return table
    by = keys if sort in (None, "key") else [sort]
    ordered = table.orderBy(*[F.col(c).asc() if ascending else F.col(c).desc() for c in by], *keys)
    return ordered if size is None else page(ordered, number, size)


def metric_totals(rows: DataFrame, limit: int | None = None, col: str = "metric") -> DataFrame:
    """Sum per metric, largest first."""
    sums = rows.groupBy(F.col(col).alias("metric")).agg(F.sum("cnt").alias("cnt"))
    ordered = sums.orderBy(F.desc("cnt"), "metric")
    return ordered.limit(limit) if limit else ordered


def hourly_chart(rows: DataFrame, col: str = "metric", time: str = "hour") -> DataFrame:
    return rows.groupBy(time, col).agg(F.sum("cnt").alias("cnt")).orderBy(time, col)


def top_names_series(rows: DataFrame, n: int = 10, time: str = "hour") -> DataFrame:
    """Series of the ``n`` names with the largest overall sums."""
    series = rows.groupBy(time, "name", "category").agg(F.sum("cnt").alias("cnt"))
    leaders = rows.groupBy("name").agg(F.sum("cnt").alias("s")).orderBy(F.desc("s"), "name").limit(n)
    return series.join(leaders.select("name"), "name", "left_semi").select(time, "name", "category", "cnt")


#: categories that are not rewards and stay out of the category totals
OTHER_CATEGORIES = ("General", "Quest Mode")


def quest_categories(rows: DataFrame) -> DataFrame:
    """Totals per reward category, largest first."""
    kept = rows.where(~F.col("category").isin(*OTHER_CATEGORIES))
    return kept.groupBy("category").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "category")


def quest_table(rows: DataFrame, number: int = 1, size: int | None = None) -> DataFrame:
    """Totals per (name, type, category), largest first, optionally one page."""
    keys = ["name", "type", "category"]
    table = rows.groupBy(*keys).agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), *keys)
    return table if size is None else page(table, number, size)


def top_characters(rows: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent characters plus the confirmed split, as rows ``(section, key, cnt)``."""
    leaders = rows.groupBy("character_id").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "character_id").limit(n)
    split = rows.groupBy(F.when(F.col("confirmed") == 1, "Confirmed").otherwise("Unconfirmed").alias("key")).agg(
        F.sum("cnt").alias("cnt")
    )
    return leaders.select(
        F.lit("character").alias("section"), F.col("character_id").cast("string").alias("key"), "cnt"
    ).unionByName(split.select(F.lit("confirmed").alias("section"), "key", "cnt"))


def filter_keys(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Keys with counts for a filter list: count descending, then id."""
    return rows.groupBy(*dims).agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), *dims)
