"""Area polygons from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.functions.scalars import strip

_RINGS = "array<array<array<double>>>"


def load_areas(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """Polygons of a FeatureCollection (bare or under ``data``), ordered by (name, id).

    Only ``Polygon`` features and only their outer ring. Ids come from the registry if one is given
    (matched by name without regard to case), else from the feature's properties.
    """
    schema = f"data struct<{M.FEATURE_COLLECTION.strip().replace('features ', 'features: ', 1)}>, {M.FEATURE_COLLECTION}"
    files = spark.read.schema(schema).json(path, multiLine=True)
    feature = files.select(F.explode(F.coalesce("features", "data.features")).alias("f"))
    polygons = feature.where(F.col("f.geometry.type") == "Polygon").select(
        F.coalesce("f.properties.id", F.lit(None).cast("int")).alias("area_id"),
        strip(F.coalesce("f.properties.name", F.lit("Unknown"))).alias("area"),
        F.coalesce("f.properties.offset_hours", F.lit(0)).alias("offset_hours"),
        F.get(F.from_json("f.geometry.coordinates", _RINGS), F.lit(0)).alias("points"),
    )
    rings = polygons.where(F.size("points") >= 3).withColumn(
        "ring",
        F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))),
    )
    if registry is not None:
        known = registry.select(F.lower("area").alias("_low"), F.col("area_id").alias("_id"))
        tidy = F.lower(F.regexp_replace("area", r"\s+", " "))
        rings = rings.withColumn("_low", tidy).join(known, "_low", "left").withColumn("area_id", F.col("_id"))
    return rings.select("area_id", "area", "offset_hours", "ring").orderBy("area", "area_id")
