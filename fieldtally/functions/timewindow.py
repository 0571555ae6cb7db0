"""Window texts. Parsing happens on the driver; the result is a literal or a small column expression."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.predicates import ntz

_RELATIVE = re.compile(r"(\d+)\s*(second|minute|hour|day|week|month|year)s?")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def shift_months(value: datetime, months: int) -> datetime:
    """Calendar shift; the day is cut to the length of the target month."""
    total = value.year * 12 + value.month - 1 + months
    year, month = divmod(total, 12)
    return value.replace(year=year, month=month + 1, day=min(value.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class TimePoint:
    """Either a fixed local time or a distance back from "now" in the area's own clock."""

    fixed: datetime | None = None
    seconds: int = 0
    months: int = 0

    def at(self, now: datetime, offset_hours: int = 0) -> datetime:
        if self.fixed is not None:
            return self.fixed
        local = now + timedelta(hours=offset_hours)
        return shift_months(local, -self.months) - timedelta(seconds=self.seconds)

    def column(self, now: datetime, offset_hours: Column) -> Column:
        """The same instant per row, for areas with different offsets."""
        if self.fixed is not None:
            return ntz(self.fixed)
        local = ntz(now) + F.make_dt_interval(F.lit(0), offset_hours.cast("int"))
        return local - F.make_ym_interval(F.lit(0), F.lit(self.months)) - F.lit(self.seconds).cast("interval second")


def _relative(text: str) -> TimePoint | None:
    match = _RELATIVE.fullmatch(text)
    if not match:
        return None
    n, unit = int(match.group(1)), match.group(2)
    if unit in _SECONDS:
        return TimePoint(seconds=n * _SECONDS[unit])
    return TimePoint(months=n * (12 if unit == "year" else 1))


def rollup_point(text: str) -> TimePoint:
    """ISO time, ``now`` or ``<n> units``. A zoned ISO time is turned into naive UTC."""
    low = text.strip().lower()
    try:
        value = datetime.fromisoformat(low)
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        return TimePoint(fixed=value)
    except ValueError:
        pass
    point = TimePoint() if low == "now" else _relative(low)
    if point is None:
        raise ValueError(f"unrecognised time {text!r}")
    return point


def _numeric_day(text: str) -> datetime | None:
    digits = text.replace("-", "")
    if digits.isdigit() and len(digits) in (6, 8):
        return datetime(int(digits[:4]), int(digits[4:6]), int(digits[6:8] or 1))
    return None


def fact_time(text: str, now: datetime) -> datetime:
    """As :func:`rollup_point`, in UTC, plus ``today``, ``yesterday``, YYYYMMDD, YYYYMM and YYYY-MM."""
    low = text.strip().lower()
    if low == "now":
        return now
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if low == "today":
        return midnight
    if low == "yesterday":
        return midnight - timedelta(days=1)
    try:
        return datetime.fromisoformat(text.strip().replace("Z", ""))
    except ValueError:
        pass
    day = _numeric_day(low)
    if day is not None:
        return day
    point = _relative(low)
    if point is None:
        raise ValueError(f"unrecognised time {text!r}")
    return point.at(now)


def month_start(text: str) -> date:
    """First day of the month named by YYYYMM, YYYY-MM, a day or an ISO time."""
    text = text.strip()
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        value = _numeric_day(text)
    if value is None:
        raise ValueError(f"unrecognised month {text!r}")
    return date(value.year, value.month, 1)


def yymm_of(value: date) -> int:
    return value.year % 100 * 100 + value.month


def months_between(start: date, end: date) -> list[int]:
    """YYMM of every month from ``start`` to ``end``, both included."""
    out, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        out.append(year % 100 * 100 + month)
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return out
