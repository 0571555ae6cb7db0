"""Polygon tests as column expressions over arrays of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs, the last joined to the first (a no-op on closed rings). One pass over the ring."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring, following, lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2"))
    )


def _side(e: Column, x: Column, y: Column) -> Column:
    """Positive when the point lies to the left of an upward edge."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """The ray from the point towards larger x crosses the edge (lower end included, upper end not)."""
    side = _side(e, x, y)
    up = (e["y1"] <= y) & (y < e["y2"]) & (side > 0)
    down = (e["y2"] <= y) & (y < e["y1"]) & (side < 0)
    return up | down


def _touches(e: Column, x: Column, y: Column) -> Column:
    return (
        (_side(e, x, y) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Odd number of crossings and not on the boundary."""
    odd = F.size(F.filter(edges, lambda e: _crosses(e, x, y))) % 2 == 1
    return odd & ~F.exists(edges, lambda e: _touches(e, x, y))


def meets_box(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Separating-axis test of an edge against a closed box."""
    corners = [_side(e, x, y) for x in (x0, x1) for y in (y0, y1)]
    overlap = (
        (F.greatest(e["x1"], e["x2"]) >= x0)
        & (F.least(e["x1"], e["x2"]) <= x1)
        & (F.greatest(e["y1"], e["y2"]) >= y0)
        & (F.least(e["y1"], e["y2"]) <= y1)
    )
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def right_of_box(e: Column, x0: Column, y0: Column, y1: Column) -> Column:
    """The edge can matter to a rightward ray that starts in the box."""
    return (
        (F.greatest(e["x1"], e["x2"]) >= x0)
        & (F.greatest(e["y1"], e["y2"]) >= y0)
        & (F.least(e["y1"], e["y2"]) <= y1)
    )
