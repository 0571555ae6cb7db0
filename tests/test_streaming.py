"""Stream equals batch, whatever the chunking; a repeated micro-batch changes nothing."""

import os
import re
from datetime import datetime

import pytest

from checks.base import Frames
from checks.payload_files import FILES, write_payloads
from fieldtally import schemas as M
from fieldtally.operators.ingest import ingest
from fieldtally.operators.merge import shiny_counts
from fieldtally.operators.retention import expire_rollup
from fieldtally.operators.rollups import ROLLUPS
from fieldtally.session import scratch_dir
from fieldtally.sources.payloads import read_payloads, routed_raw, stream_payloads
from fieldtally.streaming import jobs as K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def frames(spark):
    return Frames(spark, SF)


@pytest.fixture(scope="module")
def payloads(frames):
    return write_payloads(frames, files=3)


@pytest.fixture(scope="module")
def rollup_store(spark, frames, payloads):
    path = scratch_dir(spark, "live")
    K.stream_rollups(stream_payloads(spark, payloads, max_files=2 * FILES), frames.areas, path, scratch_dir(spark, "mark")).awaitTermination()
    return path


@pytest.mark.parametrize("family, grain", [(f, g) for f, s in ROLLUPS.items() for g in s.grains])
def test_stream_rollup_equals_batch(spark, frames, rollup_store, rows, family, grain):
    live, batch = K.read_rollup(spark, rollup_store, family, grain), frames.roll(family, grain)
    assert rows(live.select(*batch.columns)) == rows(batch)


def test_several_micro_batches_were_used(spark, rollup_store):
    assert spark.read.parquet(f"{rollup_store}/sightings/hour").select("batch_id").distinct().count() == 2


def test_folding_keeps_the_sums(spark, rollup_store, rows):
    target, again = scratch_dir(spark, "folded"), scratch_dir(spark, "folded")
    K.fold_rollup(spark, rollup_store, target, "quests", "hour", last=0)
    want = K.read_rollup(spark, rollup_store, "quests", "hour")
    got = K.read_rollup(spark, rollup_store, "quests", "hour", folded=target, upto=0)
    assert rows(got.select(*want.columns)) == rows(want)
    K.fold_rollup(spark, rollup_store, target, "quests", "hour", last=1, after=0)
    K.fold_rollup(spark, target, again, "quests", "hour", last=1)
    gone = scratch_dir(spark, "deleted")  # a root whose deltas were all folded and deleted
    got = K.read_rollup(spark, gone, "quests", "hour", folded=again, upto=1)
    assert rows(got.select(*want.columns)) == rows(want)


def test_windows_prune_days_of_folded_rollups(spark, rollup_store):
    target = scratch_dir(spark, "folded")
    K.fold_rollup(spark, rollup_store, target, "sightings", "hour", last=1)
    kept = expire_rollup(K.read_rollup(spark, rollup_store, "sightings", "hour", folded=target, upto=1), datetime(2024, 2, 20), 240)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#", plan)
    assert kept.count() > 0


def test_retention_leaves_expired_days_out_of_folded_data(spark, rollup_store):
    target = scratch_dir(spark, "folded")
    K.fold_rollup(spark, rollup_store, target, "sightings", "hour", last=1, keep=lambda df: expire_rollup(df, datetime(2024, 2, 20), 240))
    days = [f for _, names, _ in os.walk(f"{target}/sightings/hour/batch_id=1") for f in names]
    assert days and min(days) >= "day=2024-02-10"


def test_repeated_batch_changes_no_facts(spark, frames, payloads, rows):
    """The same micro-batch is written twice under one id, as after a crash before the commit."""
    path = scratch_dir(spark, "facts")
    raw = routed_raw(read_payloads(spark, payloads))
    events = {family: ingest(df, family, frames.index) for family, df in raw.items()}
    seen = []
    for _ in range(2):
        K.write_batch_facts(spark, events, path, 0)
        seen.append(
            {name: rows(K.read_facts(spark, path, name)) for name in M.FACT_KEYS}
            | {name: rows(K.read_points(spark, path, name)) for name in K.POINTS}
            | {"shiny": rows(K.read_shiny_months(spark, path))}
        )
    assert seen[0] == seen[1]
    for name in M.FACT_KEYS:
        assert seen[0][name] == rows(frames.facts(name)), name


@pytest.fixture(scope="module")
def fact_store(spark, frames, payloads):
    """Three micro-batches. What is stored is never read: the unreadable delta of a later batch would fail the stream."""
    path = scratch_dir(spark, "facts")
    broken = [f"{path}/{name}/batch_id=99/day_date=2024-01-01" for name in M.FACT_KEYS] + [f"{path}/{name}/batch_id=99" for name in (*K.POINTS, K.MONTHS)]
    for folder in broken:
        os.makedirs(folder)
        with open(f"{folder}/part-0.parquet", "w") as file:
            file.write("not a table")
    K.stream_facts(stream_payloads(spark, payloads, max_files=FILES), frames.areas, path, scratch_dir(spark, "mark")).awaitTermination()
    for folder in broken:
        os.remove(f"{folder}/part-0.parquet")
    return path


def test_fact_stream_in_small_batches(spark, frames, fact_store, rows):
    """Tables ordered by arrival do not depend on the chunking when files arrive in order."""
    assert K.read_deltas(spark, fact_store, "raid_facts", M.RAID_FACTS).select("batch_id").distinct().count() == 3
    for name in ("raid_facts", "invasion_facts", "quest_item_facts", "quest_creature_facts"):
        assert rows(K.read_facts(spark, fact_store, name)) == rows(frames.facts(name)), name
    for name in ("gyms", "pokestops"):
        assert rows(K.read_points(spark, fact_store, name)) == rows(frames.points(name)), name
    keys = M.FACT_KEYS["sighting_facts"]
    assert rows(K.read_facts(spark, fact_store, "sighting_facts").select(*keys)) == rows(frames.facts("sighting_facts").select(*keys))
    assert rows(K.read_points(spark, fact_store, "spawnpoints").select("spawnpoint")) == rows(frames.points("spawnpoints").select("spawnpoint"))
    assert rows(K.read_shiny_months(spark, fact_store)) == rows(
        shiny_counts(frames.events("sightings")).select(*spark.createDataFrame([], M.SHINY_MONTHS).columns)
    )


def test_folding_keeps_facts_points_and_months(spark, fact_store, rows):
    """Two ranges are folded, then both again; the last batch stays a delta."""
    first, again = scratch_dir(spark, "folded"), scratch_dir(spark, "folded")
    for source, target, after, last in ((fact_store, first, -1, 0), (fact_store, first, 0, 1), (first, again, -1, 1)):
        for name in M.FACT_KEYS:
            K.fold_facts(spark, source, target, name, last, after)
        for name in K.POINTS:
            K.fold_points(spark, source, target, name, last, after)
        K.fold_shiny_months(spark, source, target, last, after)
    for folded in (first, again):
        for name in M.FACT_KEYS:
            assert rows(K.read_facts(spark, fact_store, name, folded, 1)) == rows(K.read_facts(spark, fact_store, name)), name
        for name in K.POINTS:
            assert rows(K.read_points(spark, fact_store, name, folded, 1)) == rows(K.read_points(spark, fact_store, name)), name
        assert rows(K.read_shiny_months(spark, fact_store, folded, 1)) == rows(K.read_shiny_months(spark, fact_store))
