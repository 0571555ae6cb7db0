"""Points in polygon areas.

The polygons are turned into a grid index once: one row per grid cell with the list of areas that
reach into the cell. A cell that lies wholly inside an area is marked so, and a point in it needs no
geometry at all; for a cell on a border only the edges a ray from the cell can meet are kept. Where these
are many, as on a detailed coast, the cell is cut into horizontal bands with the edges of each, and a point
only walks through those of its band. A point then needs one hash lookup on its cell. With the index below the broadcast bound this is a map-side
step: the events are not shuffled, not repeated, and a hot point costs no more than any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.geometry import meets_box, right_of_box, ring_edges, strictly_inside
from fieldtally.operators.joins import salted_join

CELLS_PER_AREA = 128
BROADCAST_BYTES = 128 << 20
_SPREAD_ABOVE = 50_000
_EDGE_BYTES = 48
_CELL_BYTES = 160
#: edges that a band of a cell aims at, how often a cell is halved at most, and how often bands may repeat its edges in the mean
BAND_EDGES, MAX_HALVINGS, BAND_REPEATS = 32, 12, 4


@dataclass(frozen=True)
class AreaIndex:
    """Grid index over the areas. ``cells`` is ``None`` when there are no areas."""

    cells: DataFrame | None
    step: float
    broadcast: bool

    @staticmethod
    def build(
        areas: DataFrame, cells_per_area: int = CELLS_PER_AREA, broadcast_bytes: int = BROADCAST_BYTES
    ) -> AreaIndex:
        """Choose the cell size from the areas' extent and build the index.

        The driver reads a handful of totals, never the areas. They also give an upper bound of
        the index size; only an index proven to stay below ``broadcast_bytes`` is broadcast.
        """
        shaped = areas.where(F.size("ring") >= 3).select(
            "area_id", "area", "offset_hours", ring_edges(F.col("ring")).alias("edges"),
            *[
                pick(f"ring.{axis}").alias(f"{axis}_{end}")
                for axis in ("lon", "lat")
                for end, pick in (("min", F.array_min), ("max", F.array_max))
            ],
        )
        width, height = F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")
        totals = shaped.agg(
            F.count("*").alias("n"),
            F.sum(width * height).alias("extent"),
            F.sum(width + height).alias("reach"),
            F.max(F.greatest(width, height)).alias("longest"),
            F.max(F.size("edges")).alias("edges"),
        ).first()
        if not totals["n"]:
            return AreaIndex(None, 1.0, True)
        step = max(math.sqrt(totals["extent"] / (cells_per_area * totals["n"])), totals["longest"] / 4096, 1e-6)
        tasks = min(16 * totals["n"], 512) if totals["n"] * totals["edges"] > _SPREAD_ABOVE else None
        halvings = math.ceil(math.log2(totals["longest"] / step + 2))
        cells = _cells(shaped, step, tasks, halvings)
        bound = totals["extent"] / step**2 + 2 * totals["reach"] / step + 4 * totals["n"]
        fits = bound * (_CELL_BYTES + totals["edges"] * BAND_REPEATS * _EDGE_BYTES) <= broadcast_bytes
        if not fits:
            measured = cells.agg(
                F.count("*").alias("cells"),
                F.sum(F.aggregate("_areas", F.lit(0), lambda s, a: s + F.size(F.flatten(a["bands"])) + F.size(a["bands"]) + 2)).alias("edges"),
            ).first()
            fits = measured["cells"] * _CELL_BYTES + (measured["edges"] or 0) * _EDGE_BYTES <= broadcast_bytes
        return AreaIndex(cells, step, fits)

    def contained_in(self, df: DataFrame, lat: str, lon: str, first_only: bool) -> DataFrame:
        """One row per point and area (struct ``hit``) that strictly contains it, or only the first by (name, id).

        The test sits inside ``explode``: it is evaluated once per point, and points outside vanish.
        """
        x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
        keyed = df.withColumns({"_cx": _cell(x, self.step), "_cy": _cell(y, self.step)})
        keys = ["_cx", "_cy"]
        if self.broadcast:
            joined = keyed.join(F.broadcast(self.cells), keys)
        else:
            joined = salted_join(keyed, self.cells, keys)
        hits = F.filter("_areas", lambda a: a["whole"] | strictly_inside(_band_of(a["bands"], y, self.step), x, y))
        if first_only:
            # most points lie in a cell whose first area covers it entirely; edges are not copied into the row
            first = F.get("_areas", F.lit(0))
            hits = F.when(first["whole"], F.array(_named(first))).otherwise(F.transform(F.slice(hits, 1, 1), _named))
        else:
            hits = F.transform(hits, _named)
        return joined.select(*df.columns, F.explode(hits).alias("hit"))


def _named(area: Column) -> Column:
    return F.struct(area["area_id"].alias("area_id"), area["area"].alias("area"), area["offset_hours"].alias("offset_hours"))


def _cell(value: Column, step: float) -> Column:
    return F.floor(value / F.lit(step)).cast("int")


def _band_of(bands: Column, y: Column, step: float) -> Column:
    """The edges of the band that y lies in."""
    n = F.size(bands)
    place = F.floor((y - F.col("_cy") * F.lit(step)) / F.lit(step) * n).cast("int")
    return F.get(bands, F.least(F.greatest(place, F.lit(0)), n - 1))


def _bands(edges: Column, y0: Column, step: float, slack: float) -> Column:
    """A cell's edges by horizontal bands of equal height, found by halving: a half is only filled from its parent's edges. Edges
    longer than a band stand in several; where that would repeat them too often, the cell is one band."""
    halvings = F.least(F.ceil(F.log2(F.greatest(F.size(edges) / F.lit(float(BAND_EDGES)), F.lit(1.0)))).cast("int"), F.lit(MAX_HALVINGS))

    def between(band: Column, low: Column, height: float) -> Column:
        return F.filter(band, lambda e: (F.greatest(e["y1"], e["y2"]) >= low - slack) & (F.least(e["y1"], e["y2"]) <= low + height + slack))

    def halved(done: int):
        height = step / 2 ** (done + 1)
        return lambda band, i: F.when(
            halvings > done, F.array(between(band, y0 + 2 * i * height, height), between(band, y0 + (2 * i + 1) * height, height))
        ).otherwise(F.array(band))

    cut = F.array(edges)
    for done in range(MAX_HALVINGS):
        cut = F.flatten(F.transform(cut, halved(done)))
    return F.element_at(F.transform(F.array(F.struct(cut.alias("cut"))), lambda x: F.when(_held(x["cut"]) <= F.size(edges) * BAND_REPEATS, x["cut"]).otherwise(F.array(edges))), 1)


def _held(bands: Column) -> Column:
    return F.aggregate(bands, F.lit(0), lambda s, b: s + F.size(b))


def _grid_rows(shaped: DataFrame, step: float, slack: float, tasks: int | None, halvings: int) -> DataFrame:
    """One row per area and row of the grid (``_cy``) with the edges that reach into it, found by halving the area's range of rows:
    each half is only given edges of the range it came from, so that an edge is tested as often as the range can be halved."""

    def reach(low: Column, high: Column) -> Column:
        y0, y1 = low * F.lit(step) - slack, (high + 1) * F.lit(step) + slack
        return F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y1))

    rows = shaped.withColumns({"_low": _cell(F.col("lat_min"), step), "_high": _cell(F.col("lat_max"), step)})
    for done in range(halvings):
        low, high, middle = F.col("_low"), F.col("_high"), F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")

        def part(low: Column, high: Column, edges: Column) -> Column:
            return F.struct(low.alias("low"), high.alias("high"), edges.alias("edges"))

        both = F.array(part(low, middle, reach(low, middle)), part(middle + 1, high, reach(middle + 1, high)))
        rows = rows.withColumn("_part", F.explode(F.when(low < high, both).otherwise(F.array(part(low, high, F.col("edges"))))))
        rows = rows.withColumns({"_low": F.col("_part.low"), "_high": F.col("_part.high"), "edges": F.col("_part.edges")}).drop("_part")
        if tasks and done == min(3, halvings - 1):  # enough parts to spread, few copies of edges yet
            rows = rows.repartition(tasks, "area_id", "_low")
    return rows.withColumnRenamed("_low", "_cy").drop("_high")


def _cells(shaped: DataFrame, step: float, tasks: int | None, halvings: int) -> DataFrame:
    """The cells of each row of the grid are made from the edges that reach into the row; rows are spread over ``tasks``."""
    slack = step * 1e-6  # rounding of floor(x / step) cannot move a point out of the widened box
    x0, y0 = F.col("_cx") * step - slack, F.col("_cy") * step - slack
    x1, y1 = (F.col("_cx") + 1) * step + slack, (F.col("_cy") + 1) * step + slack
    tested = F.struct(
        F.exists("edges", lambda e: meets_box(e, x0, y0, x1, y1)).alias("on_border"),
        strictly_inside(F.col("edges"), (x0 + x1) / 2, (y0 + y1) / 2).alias("centre_in"),
    )
    per_area = (
        _grid_rows(shaped, step, slack, tasks, halvings)
        .withColumn("_cx", F.explode(F.sequence(_cell(F.col("lon_min"), step), _cell(F.col("lon_max"), step))))
        .withColumn("cell", F.explode(F.filter(F.array(tested), lambda c: c["on_border"] | c["centre_in"])))
    )
    near = F.filter("edges", lambda e: F.col("cell.on_border") & right_of_box(e, x0, y0, y1))
    near_cells = per_area.select("_cx", "_cy", "area", "area_id", "offset_hours", "cell", near.alias("near"))
    bands = _bands(F.col("near"), F.col("_cy") * F.lit(step), step, slack)
    entry = F.struct("area", "area_id", "offset_hours", (~F.col("cell.on_border")).alias("whole"), bands.alias("bands"))
    return near_cells.groupBy("_cx", "_cy").agg(F.array_sort(F.collect_list(entry)).alias("_areas"))


def assign_area(df: DataFrame, areas: DataFrame | AreaIndex, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``area_id``, ``area`` and ``offset_hours`` of the first area around the point; drop points outside.

    Without any areas every row is kept, with no area and offset 0.
    """
    index = areas if isinstance(areas, AreaIndex) else AreaIndex.build(areas)
    if index.cells is None:
        return df.withColumns(
            {
                "area_id": F.lit(None).cast("int"),
                "area": F.lit(None).cast("string"),
                "offset_hours": F.lit(0),
            }
        )
    return index.contained_in(df, lat, lon, first_only=True).select(
        *df.columns, "hit.area_id", "hit.area", "hit.offset_hours"
    )


def count_points_by_area(
    points: DataFrame, areas: DataFrame, index: AreaIndex | None = None, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Points per area; a point in two areas counts in both, an area without points gets 0."""
    index = index or AreaIndex.build(areas)
    names = areas.select("area_id", "area")
    if index.cells is None:
        return names.withColumn("stops", F.lit(0).cast("bigint"))
    counted = (
        index.contained_in(points.select(lat, lon), lat, lon, first_only=False)
        .groupBy("hit.area_id")
        .agg(F.count("*").alias("stops"))
    )
    return names.join(counted, "area_id", "left").select(
        "area_id", "area", F.coalesce("stops", F.lit(0)).alias("stops")
    )


def stops_with_total(counts: DataFrame) -> DataFrame:
    """The counts plus one row ``grand_total``, the sum over the areas."""
    total = counts.agg(F.coalesce(F.sum("stops"), F.lit(0)).alias("stops"))
    return counts.select("area", "stops").unionByName(total.select(F.lit("grand_total").alias("area"), "stops"))
