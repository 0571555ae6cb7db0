"""Row filters."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.scalars import strip

_COMPARISON = re.compile(r"(>=|<=|==|=|>|<)\s*(\d+)")
_OPS = {
    ">=": operator.ge, "<=": operator.le, "==": operator.eq, "=": operator.eq, ">": operator.gt, "<": operator.lt,
}


def parse_csv(value: str | Iterable | None) -> list[str] | None:
    """Multi-select text to a list; ``None`` means "no filter"."""
    if value is None:
        return None
    if not isinstance(value, str):
        return [str(v).strip() for v in value]
    text = value.strip()
    if not text or text.lower() == "all":
        return None
    return [part.strip() for part in text.split(",") if part.strip()]


def _as_ints(values: list[str]) -> list[int]:
    """The values that are integers; other text can match no integer column."""
    return [int(v) for v in values if re.fullmatch(r"[+-]?\d+", v)]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_in(df: DataFrame, col: str, csv: str | Iterable | None) -> Column | None:
    """Membership test typed like the column, so that it can be pushed into the scan.

    The text ``None`` selects nulls: that is how missing quest fields are labelled.
    """
    values = parse_csv(csv)
    if values is None:
        return None
    dtype = df.schema[col].dataType
    typed: list = _as_ints(values) if isinstance(dtype, T.IntegralType) else values
    test = F.col(col).isin(typed) if typed else F.lit(False)
    return test | F.col(col).isNull() if "None" in values else test


def where_in(df: DataFrame, col: str, csv: str | Iterable | None) -> DataFrame:
    test = is_in(df, col, csv)
    return df if test is None else df.where(test)


def where_all_in(df: DataFrame, filters: dict[str, str | Iterable | None]) -> DataFrame:
    for col, csv in filters.items():
        df = where_in(df, col, csv)
    return df


def where_expr(df: DataFrame, col: str, expr_csv: str | None) -> DataFrame:
    """Comparisons joined by OR, e.g. ``>=90,==0``. Unreadable text raises."""
    values = parse_csv(expr_csv)
    if values is None:
        return df
    tests = []
    for raw in values:
        match = _COMPARISON.fullmatch(raw)
        if not match:
            raise ValueError(f"invalid comparison {raw!r} for column {col}")
        tests.append(_OPS[match.group(1)](F.col(col), int(match.group(2))))
    return df.where(any_of(tests))


def where_between(df: DataFrame, col: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Both bounds at once, which the OR list cannot say."""
    if low is not None:
        df = df.where(F.col(col) >= low)
    if high is not None:
        df = df.where(F.col(col) <= high)
    return df


def where_buckets(df: DataFrame, start: datetime, end: datetime, col: str = "bucket") -> DataFrame:
    """Rollup window: the bucket's start lies in ``[start, end)``."""
    return where_days(df, ntz(start), ntz(end), col).where((F.col(col) >= ntz(start)) & (F.col(col) < ntz(end)))


def where_days(df: DataFrame, low: Column | None, high: Column | None, col: str = "bucket") -> DataFrame:
    """On a rollup stored by day (see ``write_rollup``), the days that a window of buckets touches: they prune partitions.

    Other frames are returned as they are.
    """
    if col != "bucket" or ("day", "date") not in df.dtypes:
        return df
    if low is not None:
        df = df.where(F.col("day") >= low.cast("date"))
    return df if high is None else df.where(F.col("day") <= high.cast("date"))


def where_seen(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Fact window: days prune partitions, ``seen_at`` is inclusive at both ends."""
    return df.where(
        F.col("day_date").between(F.lit(start.date()), F.lit(end.date()))
        & F.col("seen_at").between(ntz(start), ntz(end))
    )


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def valid_spawnpoint(x: Column) -> Column:
    return strip(x).rlike("^[0-9a-fA-F]{8,32}$")


def valid_coords(lat: Column, lon: Column, strict: bool = False) -> Column:
    """Finite and in range; ``strict`` also rejects an exact zero in either."""
    lat, lon = lat.try_cast("double"), lon.try_cast("double")
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    if strict:
        ok = ok & (lat != 0.0) & (lon != 0.0)
    return F.coalesce(ok, F.lit(False))


Checks = dict[str, Column]


def _filled(*cols: str) -> Checks:
    return {f"missing:{c}": F.col(c).isNotNull() for c in cols}


def _not_blank(df: DataFrame, *cols: str) -> Checks:
    """Only text columns can be blank; numbers need no rendering."""
    return {f"blank:{c}": strip(F.col(c)) != "" for c in cols if isinstance(df.schema[c].dataType, T.StringType)}


def _sighting_checks(df: DataFrame) -> Checks:
    required = (
        "species", "lat", "lon", "atk", "dfn", "sta", "disappear_time", "first_seen", "spawnpoint_hex", "verified",
    )
    return {
        **_filled(*required),
        "spawnpoint": valid_spawnpoint(F.col("spawnpoint_hex")),
        "coordinates": valid_coords(F.col("lat"), F.col("lon")),
    }


def _quest_checks(df: DataFrame) -> Checks:
    """``keys`` (the message's own key list) tells an absent key from a null value; frames without that column treat null
    as absent."""
    if "keys" in df.columns:
        present = {f"missing:{k}": F.array_contains("keys", k) for k in ("type", "with_ar", "latitude", "longitude")}
    else:
        present = _filled("type", "with_ar")
    reward_ok = F.forall(
        "rewards",
        lambda r: r["type"].isNotNull()
        & r["info"].isNotNull()
        & (F.map_contains_key(r["info"], "pokemon_id") | F.map_contains_key(r["info"], "amount")),
    )
    return {
        **present, **_filled("lat", "lon"),
        "no_reward": F.size("rewards") > 0, "reward": F.coalesce(reward_ok, F.lit(False)),
    }


def _raid_checks(df: DataFrame) -> Checks:
    not_blank = ("gym", "lvl", "lat", "lon", "spawn", "start_ts", "end_ts")
    checks = {
        **_filled("gym", "ex_eligible", "exclusive", "lvl", "boss", "form", "costume", *not_blank),
        **_not_blank(df, *not_blank),
    }
    if "rsvps" in df.columns:
        checks["rsvps"] = F.col("rsvps").isNull() | F.col("rsvps").isin("", "null", "NULL")
    return {**checks, "no_boss": F.col("boss") != 0}


def _invasion_checks(df: DataFrame) -> Checks:
    required = ("display_type", "character_id", "confirmed", "pokestop", "start_ts", "lat", "lon")
    return {**_filled(*required), **_not_blank(df, "pokestop", "start_ts", "lat", "lon")}


_CHECKS = {"sightings": _sighting_checks, "quests": _quest_checks, "raids": _raid_checks, "invasions": _invasion_checks}


def message_checks(df: DataFrame, family: str) -> Checks:
    """The checks of a family by the reason that a row is refused for, in the order in which they are told."""
    return _CHECKS[family](df)


def first_failed(checks: Checks) -> Column:
    """The reason of the first check that a row fails (an unknown outcome fails); null if it passes all."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), reason) for reason, test in checks.items()])


def _valid(df: DataFrame, family: str) -> DataFrame:
    return df.where(all_of(message_checks(df, family).values()))


def valid_sightings(df: DataFrame) -> DataFrame:
    return _valid(df, "sightings")


def valid_quests(df: DataFrame) -> DataFrame:
    """Keys present, and every reward carries a type and either a creature id or an amount."""
    return _valid(df, "quests")


def valid_raids(df: DataFrame) -> DataFrame:
    return _valid(df, "raids")


def valid_invasions(df: DataFrame) -> DataFrame:
    return _valid(df, "invasions")


def _quest_arms(df: DataFrame, arms: list[tuple[int, dict]]) -> DataFrame:
    """OR over the modes that have at least one filter; without any, everything passes."""
    tests = []
    for mode, filters in arms:
        given = {c: parse_csv(v) for c, v in filters.items()}
        if all(v is None for v in given.values()):
            continue
        parts = [is_in(df, c, v) for c, v in given.items() if v]
        tests.append((F.col("mode") == mode) & all_of(parts))
    return df.where(any_of(tests)) if tests else df


def where_quest_items(
    df: DataFrame, ar_task_types=None, normal_task_types=None, ar_item_ids=None, normal_item_ids=None
) -> DataFrame:
    return _quest_arms(
        df,
        [
            (1, {"task_type": ar_task_types, "item_id": ar_item_ids}),
            (0, {"task_type": normal_task_types, "item_id": normal_item_ids}),
        ],
    )


def where_quest_creatures(
    df: DataFrame, ar_task_types=None, normal_task_types=None, ar_poke_ids=None, normal_poke_ids=None
) -> DataFrame:
    return _quest_arms(
        df,
        [
            (1, {"task_type": ar_task_types, "poke_id": ar_poke_ids}),
            (0, {"task_type": normal_task_types, "poke_id": normal_poke_ids}),
        ],
    )


#: field of a quest rollup -> suffix of its filter name (``ar_<suffix>`` and ``normal_<suffix>``)
QUEST_ROLLUP_FIELDS = {
    "task_type": "type",
    "reward_type": "reward_type",
    "item_id": "item_id",
    "amount": "item_amount",
    "creature_id": "poke_id",
    "creature_form": "poke_form",
}


def where_quest_rollup(df: DataFrame, with_ar: str = "all", **filters: str) -> DataFrame:
    """Mode choice plus one filter set per mode, e.g. ``ar_type="1,2", normal_item_id="5"``."""
    arms = []
    for mode, chosen in (("ar", "true"), ("normal", "false")):
        if with_ar not in ("all", chosen):
            continue
        tests = [is_in(df, col, filters.get(f"{mode}_{suffix}")) for col, suffix in QUEST_ROLLUP_FIELDS.items()]
        arms.append((F.col("mode") == mode) & all_of(t for t in tests if t is not None))
    return df.where(any_of(arms))


def exclude_keys(df: DataFrame, keys: Iterable[str] | DataFrame, cols: Iterable[str] = ("species", "form")) -> DataFrame:
    """Drop rows whose colon-joined key is on the hide list (a few texts, or a frame with a ``key`` column)."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
    if isinstance(keys, DataFrame):
        return df.withColumn("_key", key).join(keys.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")
    keys = list(keys)
    return df.where(~key.isin(keys)) if keys else df


def search(df: DataFrame, cols: Iterable[str], text: str | None) -> DataFrame:
    """Case-insensitive substring match in any of the columns."""
    if not text:
        return df
    needle = F.lit(text.lower())
    return df.where(any_of(F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols))
