"""What is staged is narrow, compressed and deleted when it has been read."""

import os

import pytest
from pyspark.sql import functions as F

from checks import payload_files as P
from checks.base import Frames
from checks.sources_filters import k2_flush_by_rows
from checks.store_queries import build_all_facts
from fieldtally.session import scratch_dir, scratch_root
from fieldtally.operators import build as BD
from fieldtally.sources import bindings as B
from fieldtally.sources.payloads import buffer_rows, read_payloads, stream_payloads


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """Few rows with null keys, repeated keys and null values."""
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "nation": (25, ["CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name"]),
        "lineitem": (90, ["if(id = 5, null, id div 2) AS l_orderkey", "if(id = 7, null, id % 70) AS l_partkey", "id % 9 AS l_suppkey", "CAST(1 + id % 4 AS INT) AS l_linenumber", "if(id = 9, null, CAST(id % 50 AS DOUBLE)) AS l_quantity", "repeat('x', 50) AS l_comment"]),
        "orders": (30, ["if(id = 3, null, id) AS o_orderkey", "if(id = 4, null, id % 4) AS o_custkey", "'x' AS o_comment"]),
        "events": (20, ["if(id = 2, null, id div 2) AS event_id", "if(id = 8, null, id % 3) AS user_id", "'x' AS props"]),
    }
    for name, (n, columns) in tables.items():
        spark.range(n).selectExpr(*columns).write.parquet(f"{path}/{name}.parquet")
    return Frames(spark, path)


def left(spark, before):
    return sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(scratch_root(spark))) - before)


@pytest.mark.parametrize("family", ["sightings", "raids", "quests", "invasions"])
def test_events_are_made_from_the_rows_of_their_table(spark, frames, rows, family):
    source = B.source_rows(spark, frames.sf_dir, family)
    assert not {"l_comment", "o_comment", "props"} & set(source.schema[family].dataType.names)
    made = source.select(B.event_of(source, family).alias("e")).select("e.*")
    assert made.columns == frames.raw(family).columns and rows(made) == rows(frames.raw(family))
    none = source.select(F.when(F.lit(False), F.col(family)).alias(family))
    assert none.where(B.event_of(none, family)["arrival"].isNotNull()).count() == 0


def test_payload_rows_hold_no_text_and_leave_nothing_staged(spark, frames):
    held = P.payload_rows(frames)
    assert {c: t for c, t in held.dtypes if "string" in t} == {"other": "string"}
    before = set(os.listdir(scratch_root(spark)))
    path = P.write_payloads(frames)
    assert left(spark, before) == ["payloads"]
    pairs = frames.raw("quests").join(frames.raw("invasions"), "arrival").count()
    want = frames.raw("sightings").where("arrival IS NOT NULL").count() + frames.raw("raids").where("arrival IS NOT NULL").count() + pairs + 25 * 5
    assert spark.read.text(path).count() == want


def test_a_build_leaves_only_its_tables(spark, frames):
    payloads, out = read_payloads(spark, P.write_payloads(frames)), scratch_dir(spark, "built")
    before = set(os.listdir(scratch_root(spark)))
    BD.build_all(payloads, frames.areas, out)
    assert left(spark, before) == ["built"]
    files = [name for _, _, names in os.walk(out) for name in names if name.startswith("part-")]
    assert files and sum(".zstd." in name for name in files) >= 0.5 * len(files)


def test_queries_leave_only_what_they_return(spark, frames):
    before = set(os.listdir(scratch_root(spark)))
    build_all_facts(frames).count()
    assert left(spark, before) == ["built"]
    before = set(os.listdir(scratch_root(spark)))
    assert {r["type"]: r["n"] for r in k2_flush_by_rows(frames).collect()}["raid"] == 29 + 25
    assert left(spark, before) == ["buffer-mark", "by-rows", "by-rows-mark"]


def test_buffer_files_are_compressed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type": "raid", "message": {"n": 1}}\n' * 5)
    buffer_rows(stream_payloads(spark, str(tmp_path / "in")), str(tmp_path / "buffer"), str(tmp_path / "m"), 2).awaitTermination()
    files = [name for name in os.listdir(tmp_path / "buffer") if name.startswith("part-")]
    assert len(files) == 3 and all(".zstd." in name for name in files)
