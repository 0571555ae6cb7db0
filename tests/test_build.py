"""The one-pass build against the single builders, and its plan."""

import os
import re

import pytest

from checks.base import Frames
from checks.payload_files import write_payloads
from fieldtally import schemas as M
from fieldtally.operators import build as BD
from fieldtally.operators.rollups import ROLLUPS
from fieldtally.session import scratch_dir
from fieldtally.sources import tables as ST
from fieldtally.sources.payloads import read_payloads, routed_raw

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def frames(spark):
    return Frames(spark, SF)


@pytest.fixture(scope="module")
def payloads(spark, frames):
    return read_payloads(spark, write_payloads(frames))


@pytest.fixture(scope="module")
def built(spark, frames, payloads):
    path = scratch_dir(spark, "built")
    BD.build_all(payloads, frames.areas, path)
    return path


@pytest.mark.parametrize("family, grain", [(f, g) for f, s in ROLLUPS.items() for g in s.grains])
def test_rollups(spark, frames, built, rows, family, grain):
    want = frames.roll(family, grain)
    assert rows(ST.read_rollup(spark, f"{built}/{family}/{grain}").select(*want.columns)) == rows(want)


def test_facts_points_and_months(spark, frames, built, rows):
    for name in M.FACT_KEYS:
        assert rows(ST.read_facts(spark, f"{built}/{name}", name)) == rows(frames.facts(name)), name
    for name, (_, schema) in BD.POINTS.items():
        assert rows(ST.read_table(spark, f"{built}/{name}", schema)) == rows(frames.points(name)), name
    from fieldtally.operators.merge import shiny_counts

    assert rows(ST.read_table(spark, f"{built}/{BD.MONTHS}", M.SHINY_MONTHS)) == rows(shiny_counts(frames.events("sightings")), *ST.read_table(spark, f"{built}/{BD.MONTHS}", M.SHINY_MONTHS).columns)


def test_source_is_scanned_once(frames, payloads):
    plan = BD.with_areas(payloads, frames.index)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan json", plan)) == 1


def test_wide_rows_equal_the_routes(frames, payloads, rows):
    from fieldtally.sources.payloads import raw_of, wide_payloads

    wide = wide_payloads(payloads)
    for family, want in routed_raw(payloads).items():
        got = raw_of(wide, family)
        columns = [c for c in want.columns if c not in ("keys", "arrival")]
        assert rows(got.drop("keys", "arrival").select(*columns)) == rows(want.select(*columns)), family


def test_raw_frames_give_the_same(spark, frames, built, rows):
    path = scratch_dir(spark, "built")
    BD.build_tables(BD.staged_events({f: frames.raw(f) for f in ("sightings", "raids", "quests", "invasions")}, frames.index), path)
    for name in ("sightings/hour", "weather_iv/month", "raids/minute"):
        a, b = (ST.read_rollup(spark, f"{p}/{name}") for p in (path, built))
        assert rows(a.select(*b.columns)) == rows(b)


def test_a_folder_is_built_once(spark, frames, built, payloads):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        BD.build_all(payloads, frames.areas, built)


def test_malformed_messages(spark, frames):
    lines = ['{"type":"pokemon","message":"oops"}', '{"type":"raid","message":{"gym_id":"g","latitude":"x","longitude":"1"}}', '{"type":"nobody"}', "no json"]
    path = scratch_dir(spark, "payloads")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    out = scratch_dir(spark, "built")
    BD.build_all(read_payloads(spark, path), frames.areas, out)
    assert ST.read_facts(spark, f"{out}/sighting_facts", "sighting_facts").count() == 0
