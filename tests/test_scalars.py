"""Literal cases of the scalar functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import scalars as S


def values(spark, pairs, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(pairs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_iv_bucket_edges(spark):
    given = [0.0, 0.1, 25.0, 25.01, 90.0, 99.9, 100.0, 101.0, -1.0]
    assert values(spark, given, "double", S.iv_bucket) == [0, 25, 25, 50, 90, 95, 100, None, None]


def test_remaining_time_edges(spark):
    given = [-5, 0, 1, 299, 300, 3599, 3600]
    assert values(spark, given, "bigint", S.tth_bucket) == [None, None, "0_5", "0_5", "5_10", "55_60", None]


def test_week_starts_on_monday(spark):
    sunday = datetime(2024, 1, 7, 23, 59, 59)
    assert values(spark, [sunday], "timestamp_ntz", lambda c: S.bucket(c, "week")) == [datetime(2024, 1, 1)]
    before = datetime(2023, 12, 31, 12)
    assert values(spark, [before], "timestamp_ntz", lambda c: S.bucket(c, "week")) == [datetime(2023, 12, 25)]


@pytest.mark.parametrize("grain", S.GRAINS)
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/St_Johns"])
def test_both_bucket_forms_agree_in_any_session_zone(spark, grain, zone):
    """Around the clock changes of the session zone, before 1970 and on year ends."""
    epochs = [-86_400_001, -1, 0, 59, 345_599, 345_600, 1_711_846_799, 1_711_850_400, 1_729_990_800, 1_704_067_199, 1_709_164_800]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(e,) for e in epochs], "e bigint").select(
            "e", S.bucket(S.epoch_to_ntz(F.col("e")), grain).alias("a"),
            S.epoch_to_ntz(S.bucket_epoch(F.col("e"), grain)).alias("b"),
        )
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(r.a == r.b for r in got)
    hours = {r.e: r.a for r in got}
    if grain == "hour":
        assert hours[1_711_850_400] == datetime(2024, 3, 31, 2)  # a local time that Berlin's clocks skip


def test_local_time_uses_both_offsets(spark):
    df = spark.createDataFrame([(1_704_067_200, 2)], "e bigint, o int")
    got = df.select(S.to_area_local(F.col("e"), F.col("o"), 3)).first()[0]
    assert got == datetime(2023, 12, 31, 23)


def test_hex_ids(spark):
    given = ["ff", " 0000000000000000000000ff\t", "7fffffffffffffff", "8000000000000000", "f" * 32, "0" * 20, "\tff", "FF"]
    want = [255, 255, 2**63 - 1, -(2**63), None, 0, 255, 255]
    assert values(spark, given, "string", S.hex_to_id) == want


def test_text_cleaning(spark):
    given = ["  Café | Bar ", None, "\t\n", "é|"]
    assert values(spark, given, "string", lambda c: S.clean_text(c, 255, pipe=True)) == ["Caf / Bar", "", "", "/"]
    assert values(spark, ["", None, " x", "a" * 20], "string", lambda c: S.clean_form(c, 15)) == ["0", "0", "x", "a" * 15]
    assert values(spark, ["a" * 20], "string", S.clean_form) == ["a" * 20]


def test_flags_and_casts(spark):
    assert values(spark, ["true", "1", "0", "False", None, "x", " 5 "], "string", S.text_flag) == [1, 1, 0, 0, 0, 0, 1]
    assert values(spark, ["12", " 7 ", "1.5", "", None], "string", lambda c: S.to_int(c, -1)) == [12, 7, -1, -1, -1]
    assert values(spark, [0, 3, None], "int", S.flag) == [0, 1, 0]


def test_odds(spark):
    assert values(spark, [0.0, 0.25, 20.0, 33.0], "double", S.shiny_odds) == [None, 400, 5, 3]


def test_unsigned_ids(spark):
    df = spark.createDataFrame([("ffffffffffffffff",), ("8000000000000000",), ("7f",), ("1" + "0" * 16,)], "h string")
    got = df.select(S.unsigned_id(S.hex_to_id(F.col("h"))).alias("id"), S.long_id(F.col("h")).alias("long")).collect()
    assert [(None if r["id"] is None else int(r["id"]), r["long"]) for r in got] == [(2**64 - 1, False), (2**63, False), (127, False), (None, True)]
