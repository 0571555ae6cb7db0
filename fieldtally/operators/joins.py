"""Equi-joins with dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_point(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join facts to a point dimension.

    No broadcast hint: a dimension may grow. Catalyst broadcasts it when its size on disk is below
    the threshold, adaptive execution when its measured shuffle size is, and otherwise both sides
    are shuffled with runtime splitting of skewed partitions. Callers aggregate before they join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    return facts.join(dim, key, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join in which every key of the left side is spread over ``salts`` tasks.

    The right side must be unique per key; it is repeated once per salt. For use where the left
    side's rows may share one key and the right side is too large to broadcast. The salt comes from
    the row's values (its ``arrival`` if it has one), not from a random number: a task that runs again
    after a lost executor must send its rows to the same places.
    """
    parts = ["arrival"] if "arrival" in left.columns else left.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in parts]), F.lit(salts)).cast("int")
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(repeated, [*keys, "_salt"], how).drop("_salt")


def first_coords(df: DataFrame, key: str = "spawnpoint_hex", order: str = "arrival") -> DataFrame:
    """Give every event the coordinates its point had at the first arrival in the batch that has both."""
    return salted_join(df.drop("lat", "lon"), first_points(df, key, order), [key], "left").select(*df.columns)


def first_points(df: DataFrame, key: str = "spawnpoint_hex", order: str = "arrival") -> DataFrame:
    """One row per point: coordinates at its first arrival."""
    seen = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    first = F.min(F.struct(F.col(order).alias("o"), "lat", "lon")).alias("f")
    return seen.groupBy(key).agg(first).select(key, F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))


def area_id(areas: DataFrame, name: str) -> int:
    """Id of exactly one area, matched without regard to case. Unknown names raise."""
    text = (name or "").strip()
    if not text or text.lower() in ("all", "global") or "," in text:
        raise ValueError("give exactly one area name")
    rows = areas.where(F.lower("area") == text.lower()).select("area_id").limit(1).collect()
    if not rows:
        raise ValueError(f"unknown area {text!r}")
    return int(rows[0][0])
