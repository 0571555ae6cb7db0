"""Retention on stored tables, the fold marker, and snapshots that write only what changed."""

import glob
import hashlib
import os
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.operators import retention as RT
from fieldtally.sources import storage as SG
from fieldtally.sources import tables as ST
from fieldtally.streaming import jobs as K

NOW = datetime(2024, 1, 20, 12)


def state(path):
    """Every data file with its time of writing and a digest of its bytes."""
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    return {os.path.relpath(f, path): (os.stat(f).st_mtime_ns, hashlib.md5(open(f, "rb").read()).hexdigest()) for f in files}


def in_day(files, day):
    return {k: v for k, v in files.items() if f"={day}" in k}


@pytest.fixture
def hours(spark):
    return spark.sql(
        """SELECT if(id % 2 = 0, 'A', 'B') AS area, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS bucket,
                  'total' AS metric, id AS cnt FROM range(480)"""
    )


@pytest.fixture
def facts(spark):
    return spark.sql(
        "SELECT date_add(DATE'2024-01-01', CAST(id % 20 AS INT)) AS day_date, id AS spawnpoint, timestamp_ntz'2024-01-01 00:00:00' AS seen_at, "
        "1 AS species, '0' AS form, 1 AS iv, 1 AS level, 1 AS area_id FROM range(200)"
    )


def test_days_are_removed(spark, tmp_path, facts, rows):
    path = str(tmp_path / "facts")
    ST.write_facts(facts, path)
    before = state(path)
    plan = rows(RT.drop_days(spark, path, NOW.date(), 5, dry_run=True))
    assert state(path) == before and [a for _, a in plan] == ["drop"] * 15 + ["keep"] * 5
    assert rows(RT.drop_days(spark, path, NOW.date(), 5)) == plan
    kept = [f"2024-01-{d}" for d in range(16, 21)]
    assert sorted(name for name in os.listdir(path) if name.startswith("day_date=")) == [f"day_date={d}" for d in kept]
    assert state(path) == {k: v for k, v in before.items() if any(f"={d}" in k for d in kept)}
    assert rows(RT.drop_days(spark, path, NOW.date(), 5)) == [(d, "keep") for d in kept]
    assert rows(ST.read_facts(spark, path, "sighting_facts")) == rows(facts.where("day_date >= '2024-01-16'"))
    assert RT.drop_days(spark, str(tmp_path / "nothing"), NOW.date(), 5).count() == 0
    with pytest.raises(ValueError):
        RT.drop_days(spark, path, NOW.date(), 0)


def test_months_are_removed(spark, tmp_path, rows):
    months = spark.sql(f"SELECT CAST(CASE id % 3 WHEN 0 THEN 2311 WHEN 1 THEN 2312 ELSE 2401 END AS INT) AS month_year, 'u' AS username, 1 AS species, '0' AS form, 0 AS shiny, CAST(id AS INT) AS area_id, 1L AS total_count FROM range(9)")
    path = str(tmp_path / "months")
    ST.write_months(months, path)
    assert rows(RT.drop_months(spark, path, date(2024, 1, 5), 2)) == [("2311", "drop"), ("2312", "keep"), ("2401", "keep")]
    assert ST.read_table(spark, path, M.SHINY_MONTHS).count() == 6


def test_rollup_hours_are_removed(spark, tmp_path, hours, rows):
    path = str(tmp_path / "rollup")
    ST.write_rollup(hours, path)
    before = state(path)
    RT.drop_rollup(spark, path, NOW, 0)
    assert state(path) == before
    RT.drop_rollup(spark, path, NOW, 100)  # from 2024-01-16 08:00 on
    want = hours.where("bucket >= timestamp_ntz'2024-01-16 08:00:00'")
    assert rows(ST.read_rollup(spark, path).drop("day")) == rows(want)
    after = state(path)
    assert all(in_day(after, f"2024-01-{d}") == in_day(before, f"2024-01-{d}") for d in range(17, 21))
    RT.drop_rollup(spark, path, NOW, 100)
    assert state(path) == after
    RT.drop_rollup(spark, path, datetime(2024, 1, 20, 23, 30), 0.25)  # all rows of the border day are too old
    assert SG.partitions(spark, path, "day") == []


def facts_at(spark, path, batch, n, day="2024-01-0"):
    rows = spark.range(n).select(
        F.to_date(F.concat(F.lit(day), (F.col("id") % 3 + 1).cast("string"))).alias("day_date"), F.col("id").alias("spawnpoint"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("seen_at"), F.lit(batch).alias("species"), F.lit("0").alias("form"),
        F.lit(1).alias("iv"), F.lit(1).alias("level"), F.lit(1).alias("area_id"),
    )
    ST.partitioned(rows, "day_date", ["area_id"]).option("partitionOverwriteMode", "static").mode("overwrite").parquet(f"{path}/sighting_facts/batch_id={batch}")


def test_marker_is_followed(spark, tmp_path, rows, monkeypatch):
    path, target = str(tmp_path / "live"), str(tmp_path / "folded")
    for batch, n in enumerate((10, 20, 30)):
        facts_at(spark, path, batch, n)
    want = rows(K.read_facts(spark, path, "sighting_facts"))
    assert len(want) == 30 and K.fold_marker(spark, path, "sighting_facts") == (None, -1)

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:  # the fold is written, the marker is not
        patch.setattr(K, "write_pointer", dies)
        with pytest.raises(RuntimeError):
            K.advance(spark, path, target, "sighting_facts")
    assert os.path.isdir(f"{target}/sighting_facts/batch_id=2")
    assert rows(K.read_facts(spark, path, "sighting_facts")) == want
    assert K.advance(spark, path, target, "sighting_facts", last=1) == 1
    assert rows(K.read_facts(spark, path, "sighting_facts")) == want  # what the dead fold left at batch 2 is not read
    assert K.drop_folded(spark, path, "sighting_facts") == 2 and SG.complete_batches(spark, f"{path}/sighting_facts") == [2]
    assert rows(K.read_facts(spark, path, "sighting_facts")) == want
    facts_at(spark, path, 3, 40)
    os.makedirs(f"{path}/sighting_facts/batch_id=4")  # a batch that is still being written
    assert K.advance(spark, path, target, "sighting_facts") == 3
    assert K.advance(spark, path, target, "sighting_facts") == 3
    K.drop_folded(spark, path, "sighting_facts")
    got = rows(K.read_facts(spark, path, "sighting_facts"))
    assert len(got) == 40 and got[: len(want)] == want or set(want) <= set(got)
    with pytest.raises(ValueError):
        K.advance(spark, path, str(tmp_path / "elsewhere"), "sighting_facts")
    RT.drop_days(spark, f"{target}/sighting_facts", date(2024, 1, 3), 1)  # retention on folded deltas
    assert {r["day_date"] for r in K.read_facts(spark, path, "sighting_facts").collect()} == {date(2024, 1, 3)}


def test_marker_of_rollups(spark, tmp_path, hours, rows):
    path, target = str(tmp_path / "live"), str(tmp_path / "folded")
    for batch in range(3):
        hours.write.parquet(f"{path}/sightings/hour/batch_id={batch}")
    want = rows(K.read_rollup(spark, path, "sightings", "hour"), "area", "bucket", "cnt")
    assert K.advance(spark, path, target, "sightings/hour", last=0) == 0 and K.advance(spark, path, target, "sightings/hour") == 2
    assert rows(K.read_rollup(spark, path, "sightings", "hour"), "area", "bucket", "cnt") == want
    K.drop_folded(spark, path, "sightings/hour")
    assert rows(K.read_rollup(spark, path, "sightings", "hour"), "area", "bucket", "cnt") == want


def test_pointer_versions(spark, tmp_path):
    where = str(tmp_path / "mark")
    assert SG.read_pointer(spark, where) is None
    for n in range(4):
        SG.write_pointer(spark, where, {"n": n, "ä": "ü"})
        assert SG.read_pointer(spark, where) == {"n": n, "ä": "ü"}
    assert len([f for f in os.listdir(where) if f.startswith("at-")]) == 2


def test_snapshot_writes_changed_days_only(spark, tmp_path, hours, rows):
    path = str(tmp_path / "snapshot")
    assert len(ST.update_snapshot(spark, path, hours, 0, datetime(2024, 1, 21))) == 20
    before = state(path)
    assert ST.update_snapshot(spark, path, hours, 0, datetime(2024, 1, 22)) == [] and state(path) == before
    changed = hours.withColumn("cnt", F.when(F.col("bucket") == F.lit("2024-01-05 03:00:00").cast("timestamp_ntz"), 999).otherwise(F.col("cnt")))
    more = spark.sql("SELECT 'C' AS area, timestamp_ntz'2024-01-25 00:00:00' AS bucket, 'total' AS metric, 1L AS cnt")
    days = ST.update_snapshot(spark, path, changed.unionByName(more), 0, datetime(2024, 1, 23))
    assert days == [date(2024, 1, 5), date(2024, 1, 25)]
    after = state(path)
    assert {k: v for k, v in after.items() if "2024-01-05" not in k and "2024-01-25" not in k} == {k: v for k, v in before.items() if "2024-01-05" not in k}
    assert rows(ST.restore_rollups(spark, path)) == rows(changed.unionByName(more))
    stamps = {(r["day"].day, r["backed_up_at"].day) for r in spark.read.parquet(path).collect()}
    assert {(5, 23), (25, 23), (4, 21)} <= stamps and (4, 22) not in stamps
    # what fell out of the retention stays as it was; a refresh stamps every current day
    late = hours.where("bucket >= timestamp_ntz'2024-01-20 06:00:00'")
    assert ST.update_snapshot(spark, path, late, 24, datetime(2024, 1, 21), refresh=True) == [date(2024, 1, 20)]
    assert rows(ST.restore_rollups(spark, path)) == rows(changed.unionByName(more))
    assert ST.update_snapshot(spark, path, hours.limit(0), 0, NOW) == []


def test_restore_reads_only_its_days(spark, tmp_path, hours, rows):
    path = str(tmp_path / "snapshot")
    ST.write_snapshot(ST.snapshot_rollups(hours, None, 0, NOW), path)
    got = ST.restore_rollups(spark, path, datetime(2024, 1, 18, 5))
    assert rows(got) == rows(hours.where("bucket >= timestamp_ntz'2024-01-18 05:00:00'"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)
