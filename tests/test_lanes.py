"""Lanes of a buffer: flushed side by side, each file in exactly one, micro-batches within the limit over restarts."""

import json

import pytest

from checks import sources_filters as Q
from checks.base import Frames
from fieldtally.sources.payloads import _lane_names, buffer_rows, stream_buffered, stream_payloads


@pytest.mark.parametrize("lanes", [2, 3, 8, 16])
def test_any_name_is_in_one_lane(spark, lanes):
    names = [f"part-00000-{digit}2f9-c000.zstd.parquet" for digit in "0123456789abcdef"]
    names += ["a", "x" * 11, "part-123456-7a-c000.parquet", "part-00000-Zed.parquet", "lines of june.parquet", "{1}.parquet", "part-00000-é"]
    globs = [spark._jvm.org.apache.hadoop.fs.GlobPattern(_lane_names(lane, lanes)) for lane in range(lanes)]
    found = {name: [lane for lane, glob in enumerate(globs) if glob.matches(name)] for name in names}
    assert all(len(x) == 1 for x in found.values()), found
    assert {x[0] for x in found.values()} == set(range(lanes))


def test_lanes_lose_and_repeat_nothing(spark, tmp_path):
    source, buffer, lanes, out = tmp_path / "in", str(tmp_path / "buffer"), 3, {}
    source.mkdir()

    def run():
        buffer_rows(stream_payloads(spark, str(source)), buffer, str(tmp_path / "mark"), 2).awaitTermination()
        queries = []
        for lane in range(lanes):
            def flush(batch, batch_id, lane=lane):
                out[lane, batch_id] = [json.loads(r["message"])["n"] for r in batch.collect()]

            rows = stream_buffered(spark, buffer, lane=lane, lanes=lanes).writeStream.foreachBatch(flush)
            queries.append(rows.option("checkpointLocation", str(tmp_path / f"mark-{lane}")).trigger(availableNow=True).start())
        for query in queries:
            query.awaitTermination()

    (source / "a.json").write_text("\n".join(json.dumps({"type": "raid", "message": {"n": i}}) for i in range(30)))
    run()
    before = dict(out)
    (source / "b.json").write_text("\n".join(json.dumps({"type": "raid", "message": {"n": i}}) for i in range(30, 37)))
    run()
    run()
    assert {k: out[k] for k in before} == before and len({lane for lane, _ in out}) > 1
    assert all(len(x) <= 2 for x in out.values())
    assert sorted(n for x in out.values() for n in x) == list(range(37))


def test_lanes_are_numbered(spark, tmp_path):
    for lane, lanes in ((2, 2), (-1, 2), (0, 17)):
        with pytest.raises(ValueError):
            stream_buffered(spark, str(tmp_path), lane=lane, lanes=lanes)


def test_flushes_run_side_by_side(spark, tmp_path, monkeypatch):
    """All lanes are started before one is waited for, and every payload is counted, also where lanes have no file."""
    asked = []

    def stream(spark, path, max_files=1, lane=0, lanes=1):
        asked.append((max_files, lane, lanes))
        return stream_buffered(spark, path, max_files, lane, lanes)

    monkeypatch.setattr(Q, "stream_buffered", stream)
    tables = {
        "nation": (3, ["CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name"]),
        "lineitem": (9, ["id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(1 + id AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity"]),
        "orders": (5, ["id AS o_orderkey", "id AS o_custkey"]),
        "events": (4, ["id AS event_id", "id AS user_id"]),
    }
    for name, (n, columns) in tables.items():
        spark.range(n).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    counts = {r["type"]: r["n"] for r in Q.k2_flush_by_rows(Frames(spark, str(tmp_path))).collect()}
    assert counts == {"pokemon": 12, "raid": 8, "quest": 7, "invasion": 7, "weather": 3}
    assert asked == [(1, lane, Q.LANES) for lane in range(Q.LANES)]
