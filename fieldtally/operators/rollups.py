"""Rollup builders: counts per area, time bucket and dimensions.

A rollup is one long table ``(area, bucket, dimensions..., metric, cnt)``. Counting happens once per
event with partial aggregation before the shuffle, so a hot key costs one row per task. Metrics are
counted side by side and turned into rows after the aggregation, not before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import scalars as S
from fieldtally.functions.fixed_values import RAID_METRICS, SIGHTING_METRICS


def sighting_flags() -> dict[str, Column]:
    """Condition of each sighting metric; ``total`` always holds."""
    return {
        "total": F.lit(True),
        "iv100": F.col("iv") == 100,
        "iv0": F.col("iv") == 0,
        "shiny": F.col("shiny").cast("boolean"),
        "pvp_little": F.col("rank1_little"),
        "pvp_great": F.col("rank1_great"),
        "pvp_ultra": F.col("rank1_ultra"),
    }


def raid_flags() -> dict[str, Column]:
    return {
        "total": F.lit(True),
        "costume": F.coalesce(~F.col("costume").isin("", "0"), F.lit(False)),
        "exclusive": F.col("exclusive") == 1,
        "ex_raid_eligible": F.col("ex_eligible") == 1,
    }


@dataclass(frozen=True)
class RollupSpec:
    source: str
    time: str
    dims: tuple[str, ...]
    grains: tuple[str, ...]
    metrics: tuple[str, ...] = ("total",)
    #: dimensions of the minute grain, where they differ
    minute_dims: tuple[str, ...] | None = None
    minute_metrics: tuple[str, ...] | None = None

    def dims_at(self, grain: str) -> tuple[str, ...]:
        return self.minute_dims if grain == "minute" and self.minute_dims is not None else self.dims

    def metrics_at(self, grain: str) -> tuple[str, ...]:
        return self.minute_metrics if grain == "minute" and self.minute_metrics is not None else self.metrics


_ALL = ("minute", "hour", "day", "week")

ROLLUPS = {
    "sightings": RollupSpec("sightings", "seen_epoch", ("species", "form"), _ALL, tuple(SIGHTING_METRICS)),
    "tth": RollupSpec("sightings", "seen_epoch", ("tth_bucket",), _ALL),
    "weather_iv": RollupSpec("sightings", "seen_epoch", ("weather_flag", "iv_bucket"), ("month",)),
    "raids": RollupSpec(
        "raids", "start_epoch", ("boss", "level", "form", "costume", "exclusive", "ex_eligible"), _ALL,
        minute_dims=("boss", "level", "form"), minute_metrics=tuple(RAID_METRICS),
    ),
    "quests": RollupSpec(
        "quests", "seen_epoch",
        ("mode", "task_type", "reward_type", "item_id", "amount", "creature_id", "creature_form"), _ALL,
    ),
    "invasions": RollupSpec(
        "invasions", "start_epoch", ("display_type", "character_id", "grunt", "confirmed"), _ALL,
        minute_dims=("display_type", "grunt", "confirmed"),
    ),
}


def _shaped(events: DataFrame, family: str) -> DataFrame:
    """Rows and derived dimensions that the family counts."""
    if family == "tth":
        rows = events.where("verified").withColumn("tth_bucket", S.tth_bucket(F.col("despawn_s")))
        return rows.where(F.col("tth_bucket").isNotNull())
    if family == "weather_iv":
        rows = events.withColumns(
            {"weather_flag": S.flag(F.col("weather")), "iv_bucket": S.iv_bucket(F.col("iv"))}
        )
        return rows.where(F.col("iv_bucket").isNotNull())
    if family == "raids":
        return events.withColumn("level", F.col("lvl").cast("int"))
    if family == "invasions":
        return events.withColumn("confirmed", S.flag(F.col("confirmed")))
    return events


def rollup(events: DataFrame, family: str, grain: str) -> DataFrame:
    """Count localised events of ``family`` per area and ``grain``."""
    spec = ROLLUPS[family]
    if grain not in spec.grains:
        raise ValueError(f"{family} has no {grain} rollup")
    dims, metrics = spec.dims_at(grain), spec.metrics_at(grain)
    flags = {"sightings": sighting_flags, "raids": raid_flags}.get(family, lambda: {"total": F.lit(True)})()
    keyed = _shaped(events, family).withColumn("_start", S.bucket_epoch(F.col(spec.time), grain))
    counted = keyed.groupBy("area", "_start", *dims).agg(
        *[F.count("*").alias(m) if m == "total" else F.count_if(flags[m]).alias(m) for m in metrics]
    )
    return _to_rows(counted.withColumn("bucket", S.epoch_to_ntz(F.col("_start"))), dims, metrics)


#: source family -> (rollup, grain) counted from events; all other grains are folded from the finest of these with their dimensions
FINEST = {
    "sightings": (("sightings", "minute"), ("tth", "minute"), ("weather_iv", "month")),
    "raids": (("raids", "minute"), ("raids", "hour")),
    "quests": (("quests", "minute"),),
    "invasions": (("invasions", "minute"), ("invasions", "hour")),
}
#: rollup and grain -> the grain it is folded from
FOLDED_FROM = {"hour": "minute", "day": "hour", "week": "hour"}


def finest_counts(events: DataFrame, source: str) -> DataFrame:
    """All counts of ``FINEST`` for one source family in one pass: one read, one partial aggregation, one shuffle.

    Grouping sets count every event once per rollup; ``family`` and ``grain`` tell the rows apart, and dimensions that a
    rollup doesn't have are null in its rows.
    """
    targets = FINEST[source]
    shaped = events
    if source == "sightings":
        shaped = shaped.withColumns({
            "tth_bucket": F.when(F.col("verified"), S.tth_bucket(F.col("despawn_s"))),
            "weather_flag": S.flag(F.col("weather")), "iv_bucket": S.iv_bucket(F.col("iv")),
        })
    else:
        shaped = _shaped(shaped, source)
    time = ROLLUPS[targets[0][0]].time
    starts = {grain: f"_{grain}" for _, grain in targets}
    shaped = shaped.withColumns({name: S.bucket_epoch(F.col(time), grain) for grain, name in starts.items()})
    sets = [["area", starts[grain], *ROLLUPS[family].dims_at(grain)] for family, grain in targets]
    keys = list(dict.fromkeys(c for columns in sets for c in columns))
    flags = {"sightings": sighting_flags, "raids": raid_flags}.get(source, lambda: {"total": F.lit(True)})()
    counted = shaped.groupingSets(sets, *keys).agg(
        F.grouping_id(*keys).alias("_set"), *[(F.count("*") if m == "total" else F.count_if(test)).alias(f"n_{m}") for m, test in flags.items()]
    )
    number = [sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in columns) for columns in sets]

    def told(part: int) -> Column:
        return F.coalesce(*[F.when(F.col("_set") == n, target[part]) for n, target in zip(number, targets, strict=True)])

    dims = [key for key in keys if key not in starts.values()]
    named = counted.select(told(0).alias("family"), told(1).alias("grain"), F.coalesce(*starts.values()).alias("_start"), *dims, *[f"n_{m}" for m in flags])
    for family, needed in (("tth", "tth_bucket"), ("weather_iv", "iv_bucket")):
        if needed in dims:
            named = named.where((F.col("family") != family) | F.col(needed).isNotNull())
    return named


def finest_rollup(counts: DataFrame, family: str, grain: str) -> DataFrame:
    """One rollup out of :func:`finest_counts`."""
    spec = ROLLUPS[family]
    dims, metrics = spec.dims_at(grain), spec.metrics_at(grain)
    rows = counts.where((F.col("family") == family) & (F.col("grain") == grain)).select(
        "area", S.epoch_to_ntz(F.col("_start")).alias("bucket"), *dims, *[F.col(f"n_{m}").alias(m) for m in metrics]
    )
    return _to_rows(rows, dims, metrics)


def _to_rows(counted: DataFrame, dims: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    keys = ["area", "bucket", *dims]
    if metrics == ("total",):
        return counted.select(*keys, F.lit("total").alias("metric"), F.col("total").alias("cnt"))
    return counted.unpivot(keys, list(metrics), "metric", "cnt").where("cnt > 0")


def rollup_keys(rolled: DataFrame) -> list[str]:
    return [c for c in rolled.columns if c != "cnt"]


def coarsen(rolled: DataFrame, grain: str) -> DataFrame:
    """Finer rollup to a coarser one. Additive, so nothing has to be read again from the events."""
    keys = rollup_keys(rolled)
    return (
        rolled.withColumn("bucket", S.bucket(F.col("bucket"), grain)).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    )


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Sum additive rollup deltas, whatever batches they came from."""
    plain = deltas.drop("batch_id")
    return plain.groupBy(*rollup_keys(plain)).agg(F.sum("cnt").alias("cnt"))


def sighting_metrics(events: DataFrame) -> DataFrame:
    """One row per event and applicable metric."""
    return _fan_out(events, sighting_flags())


def raid_metrics(events: DataFrame) -> DataFrame:
    return _fan_out(events, raid_flags())


def _fan_out(events: DataFrame, flags: dict[str, Column]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))
    return events.withColumn("metric", F.explode(names))
