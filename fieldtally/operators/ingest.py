"""Valid raw family frames to localised events: area, area-local time, derived columns.

Validity is checked where payloads are routed. Keeping it out of this step keeps the map stage's
generated code small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import scalars as S
from fieldtally.operators.spatial import AreaIndex, assign_area

Areas = DataFrame | AreaIndex


def _local(name: str, epoch: str, sender_offset: int) -> dict[str, Column]:
    """Area-local time twice: as a timestamp ``<name>_at`` and as epoch seconds ``<name>_epoch`` for counting."""
    offset = F.col("offset_hours")
    return {
        f"{name}_at": S.to_area_local(F.col(epoch), offset, sender_offset),
        f"{name}_epoch": S.local_epoch(F.col(epoch), offset, sender_offset),
    }


def localise_sightings(rows: DataFrame, sender_offset: int = 0) -> DataFrame:
    return rows.withColumns(
        {
            "iv": S.iv_pct(F.col("atk"), F.col("dfn"), F.col("sta")),
            **_local("seen", "first_seen", sender_offset),
            "despawn_s": S.despawn_seconds(F.col("disappear_time"), F.col("first_seen")),
        }
    )


def localise_raids(rows: DataFrame, sender_offset: int = 0) -> DataFrame:
    return rows.withColumns(
        {
            **_local("seen", "spawn", sender_offset),
            **_local("start", "start_ts", sender_offset),
            **_local("end", "end_ts", sender_offset),
        }
    )


def localise_quests(rows: DataFrame, sender_offset: int = 0) -> DataFrame:
    """Takes flat quests (first reward already picked, see :mod:`fieldtally.operators.derive`)."""
    rows = rows.withColumns(_local("seen", "updated", sender_offset))
    if "mode" not in rows.columns:
        rows = rows.withColumn("mode", F.when(F.col("with_ar"), "ar").otherwise("normal"))
    return rows


def localise_invasions(rows: DataFrame, sender_offset: int = 0) -> DataFrame:
    return rows.withColumns(_local("start", "start_ts", sender_offset))


#: what is derived from rows that have their area
LOCALISE = {
    "sightings": localise_sightings,
    "raids": localise_raids,
    "quests": localise_quests,
    "invasions": localise_invasions,
}


def ingest(raw: DataFrame, family: str, areas: Areas, sender_offset: int = 0) -> DataFrame:
    return LOCALISE[family](assign_area(raw, areas), sender_offset)
