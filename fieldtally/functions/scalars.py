"""Scalar derivations as pure column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("minute", "hour", "day", "week", "month")
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_SPACES = " \t\n\r\f\x0b"


def iv_pct(atk: Column, dfn: Column, sta: Column) -> Column:
    """Sum of the three values as a percentage of 45, two decimals."""
    return F.round((atk + dfn + sta) / F.lit(45.0) * 100, 2)


def iv_int(iv: Column) -> Column:
    return F.round(iv).cast("int")


def despawn_seconds(disappear: Column, first_seen: Column) -> Column:
    """Both arguments are uncorrected epochs, so the sender's offset cancels out."""
    return disappear - first_seen


def rank1_flag(league: Column) -> Column:
    """True if any entry of the league's list has rank 1."""
    return F.coalesce(F.exists(league, lambda entry: F.coalesce(entry["rank"] == 1, F.lit(False))), F.lit(False))


def epoch_to_ntz(epoch: Column) -> Column:
    """Epoch seconds to a zone-free timestamp; the session time zone plays no part."""
    return F.expr(_EPOCH) + epoch.cast("interval second")


def to_area_local(epoch: Column, offset_hours: Column, sender_offset: int = 0) -> Column:
    """Undo the sender's offset, then apply the area's."""
    return epoch_to_ntz(local_epoch(epoch, offset_hours, sender_offset))


def local_epoch(epoch: Column, offset_hours: Column, sender_offset: int = 0) -> Column:
    return epoch.cast("bigint") + (offset_hours.cast("bigint") - F.lit(int(sender_offset))) * 3600


def iv_bucket(iv: Column) -> Column:
    """Upper edge of the value's class; null outside 0..100."""
    return (
        F.when((iv < 0) | (iv > 100), None)
        .when(iv == 0, 0)
        .when(iv == 100, 100)
        .when(iv <= 25, 25)
        .when(iv <= 50, 50)
        .when(iv <= 75, 75)
        .when(iv <= 90, 90)
        .when(iv < 100, 95)
    ).cast("int")


def tth_bucket(seconds: Column) -> Column:
    """Five-minute class ``0_5`` .. ``55_60``; null for non-positive or one hour and more."""
    low = F.floor(seconds / 300).cast("int") * 5
    label = F.concat(low.cast("string"), F.lit("_"), (low + 5).cast("string"))
    return F.when((seconds > 0) & (seconds < 3600), label)


def bucket(ts: Column, grain: str) -> Column:
    """Start of the minute, hour, day, Monday week or month, as a zone-free timestamp.

    Built from date parts instead of ``date_trunc``: on zone-free input that function would go
    through the session time zone.
    """
    day = ts.cast("date")
    if grain == "minute":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts), F.minute(ts))
    if grain == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    if grain == "day":
        return day.cast("timestamp_ntz")
    if grain == "week":
        return F.trunc(day, "week").cast("timestamp_ntz")
    if grain == "month":
        return F.trunc(day, "month").cast("timestamp_ntz")
    raise ValueError(f"unknown grain {grain!r}; use one of {GRAINS}")


_BUCKET_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_FIRST_MONDAY = 4 * 86400  # 1970-01-05


def bucket_epoch(epoch: Column, grain: str) -> Column:
    """The same bucket start as :func:`bucket`, from and to epoch seconds: integer arithmetic for hot loops."""
    if grain == "month":
        day = F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))
        return F.unix_date(F.trunc(day, "month")).cast("bigint") * 86400
    shift = _FIRST_MONDAY if grain == "week" else 0
    return epoch - F.pmod(epoch - shift, F.lit(_BUCKET_SECONDS[grain]))


def yymm(ts: Column) -> Column:
    """Month as the integer YYMM."""
    return ((F.year(ts) % 100) * 100 + F.month(ts)).cast("int")


def month_key(ts: Column) -> Column:
    """Month as the text YYYYMM."""
    return F.date_format(ts, "yyyyMM")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("int")


def flag(x: Column) -> Column:
    """1 for a non-zero number or true, 0 otherwise (also for null)."""
    return F.coalesce((x.cast("int") != 0).cast("int"), F.lit(0))


def text_flag(x: Column) -> Column:
    """Flag from JSON text: ``true``/``1`` and other non-zero integers are 1, anything else is 0.

    ``false`` is told apart first: a cast that fails makes an error and drops it, which takes longer than all else here.
    """
    low = F.lower(F.btrim(x))
    return F.when(low == "true", 1).when(low == "false", 0).otherwise(F.coalesce((low.try_cast("int") != 0).cast("int"), F.lit(0)))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACES))


def clean_text(x: Column, n: int | None = None, pipe: bool = False) -> Column:
    """Strip, optionally turn pipes into slashes, drop non-ASCII characters; cut to ``n`` if given. Null becomes empty."""
    out = strip(F.coalesce(x, F.lit("")))
    if pipe:
        out = F.translate(out, "|", "/")
    out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    return F.substring(out, 1, n) if n else out


def clean_form(x: Column, n: int | None = None) -> Column:
    """Form text for the monthly table: blank becomes ``0``; cut to ``n`` if given."""
    text = clean_text(x, n)
    return F.when(text == "", "0").otherwise(text)


def to_int(x: Column, default: int | None = 0) -> Column:
    """Integer or the default; unreadable text gives the default."""
    return F.coalesce(x.try_cast("int"), F.lit(default).cast("int"))


def to_double(x: Column, default: float | None = None) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default).cast("double"))


def hex_to_id(x: Column) -> Column:
    """Hexadecimal text of up to 64 bits to an id; longer values give null (see :func:`long_id`).

    Ids are unsigned; one of 2^63 or more is held in a bigint as its bits, a negative number. :func:`unsigned_id` shows it.
    Short texts without blanks at the ends, which is nearly all of them, need no trimming.
    """

    def convert(text: Column) -> Column:
        return F.conv(text, 16, -10).try_cast("bigint")

    plain = (F.length(x) <= 16) & (F.ascii(x) > 32) & (F.ascii(F.substring(x, -1, 1)) > 32)
    digits = F.ltrim(strip(x), F.lit("0"))
    return F.when(plain, convert(x)).when(F.length(digits) <= 16, convert(F.concat(F.lit("0"), digits)))


def unsigned_id(id_: Column) -> Column:
    """The id as the unsigned number it stands for."""
    wide = id_.cast("decimal(20,0)")
    return F.when(id_ < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def long_id(x: Column) -> Column:
    """Whether a hexadecimal text has more than 64 bits, which no id column holds."""
    return F.length(F.ltrim(strip(x), F.lit("0"))) > 16


def shiny_odds(pct: Column) -> Column:
    """``n`` of the odds "1 in n"; null if the rate is not positive."""
    return F.when(pct > 0, F.floor(F.lit(100.0) / pct)).cast("bigint")
