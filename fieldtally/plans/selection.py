"""What a rollup query is asked for: areas, window and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.predicates import parse_csv, where_buckets, where_days, where_in
from fieldtally.functions.timewindow import fact_time, month_start, months_between, rollup_point
from fieldtally.operators.joins import area_id


@dataclass(frozen=True)
class Selection:
    """``areas`` is the registry (``area``, ``offset_hours``), ``area`` the choice: ``global`` or a name list.

    ``start`` and ``end`` are window texts. ``now`` is given by the caller, which makes a query repeatable.
    """

    areas: DataFrame
    start: str
    end: str
    now: datetime
    area: str = "global"
    filters: dict[str, str | Iterable | None] = field(default_factory=dict)


def chosen_areas(areas: DataFrame, area: str) -> DataFrame:
    """Registry rows of the choice; every area for ``global`` or ``all``."""
    text = area.strip().lower()
    if text in ("global", "all"):
        return areas
    names = [n.lower() for n in parse_csv(area) or []]
    return areas.where(F.lower("area").isin(names))


def area_windows(sel: Selection) -> DataFrame:
    """Window of each chosen area on its own clock."""
    start, end = rollup_point(sel.start), rollup_point(sel.end)
    offset = F.col("offset_hours")
    return chosen_areas(sel.areas, sel.area).select(
        "area", start.column(sel.now, offset).alias("_from"), end.column(sel.now, offset).alias("_to")
    )


def where_areas(df: DataFrame, sel: Selection, col: str = "bucket") -> DataFrame:
    """Rows of the chosen areas inside each area's window ``[from, to)``.

    The outer limits of all chosen windows (literals if the window is fixed, else scalar subqueries over the areas, whatever
    their offsets) restrict the scan before the (small) area join.
    """
    start, end = rollup_point(sel.start), rollup_point(sel.end)
    if start.fixed is not None and end.fixed is not None:
        pruned = where_buckets(df, start.at(sel.now, 0), end.at(sel.now, 0), col)
        return pruned.join(chosen_areas(sel.areas, sel.area).select("area"), "area", "left_semi")
    windows = area_windows(sel)
    low, high = windows.agg(F.min("_from")).scalar(), windows.agg(F.max("_to")).scalar()
    windowed = where_days(df, low, high, col).where((F.col(col) >= low) & (F.col(col) < high)).join(windows, "area")
    return windowed.where((F.col(col) >= F.col("_from")) & (F.col(col) < F.col("_to"))).drop("_from", "_to")


def select_rows(rollup: DataFrame, sel: Selection) -> DataFrame:
    """Window, areas and plain membership filters."""
    rows = where_areas(rollup, sel)
    for col, csv in sel.filters.items():
        rows = where_in(rows, col, csv)
    return rows


@dataclass(frozen=True)
class FactSelection:
    """What a report on facts is asked for: one area by name, window texts in UTC, and filters.

    Beside what rollup windows take, a text may be ``today``, ``yesterday``, a day (YYYYMMDD) or a month (YYYYMM, YYYY-MM), which
    stand for their first instant. ``now`` is given by the caller.
    """

    areas: DataFrame
    area: str
    start: str
    end: str
    now: datetime
    filters: dict = field(default_factory=dict)

    def window(self) -> tuple[datetime, datetime]:
        start, end = fact_time(self.start, self.now), fact_time(self.end, self.now)
        if end < start:
            raise ValueError(f"the window ends before it starts: {self.start!r} to {self.end!r}")
        return start, end

    def months(self) -> list[int]:
        """YYMM of the months that the window touches."""

        def first(text: str) -> date:
            try:
                return month_start(text)
            except ValueError:
                value = fact_time(text, self.now)
                return date(value.year, value.month, 1)

        return months_between(first(self.start), first(self.end))


def map_report(report: Callable[..., DataFrame], facts: DataFrame, points: DataFrame, sel: FactSelection, limit_per_day: int = 0) -> DataFrame:
    """A map report (see :mod:`fieldtally.plans.maps`) for a selection. Its window becomes literal days, which prune partitions."""
    return report(facts, points, area_id(sel.areas, sel.area), *sel.window(), sel.filters, limit_per_day)


def rate_report(report: Callable[..., DataFrame], months: DataFrame, sel: FactSelection, **options) -> DataFrame:
    """The rate report for a selection; ``global`` and ``all`` stand for every area."""
    asked = sel.months()
    if not asked:
        raise ValueError(f"the window ends before it starts: {sel.start!r} to {sel.end!r}")
    area = None if sel.area.strip().lower() in ("global", "all") else area_id(sel.areas, sel.area)
    return report(months, asked[0], asked[-1], area, **{**sel.filters, **options})
