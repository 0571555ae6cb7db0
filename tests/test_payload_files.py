"""Payload files grow in number, not in size, and are compressed; messages are parsed once."""

import gzip
import json
import os
import re

import pytest

from checks import payload_files as P
from checks.base import Frames
from fieldtally import schemas as M
from fieldtally.operators import audit as A
from fieldtally.session import scratch_root
from fieldtally.sources.payloads import _file_info, read_payloads, routed_raw, wide_payloads
from fieldtally.streaming.jobs import _localised


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "nation": (25, ["CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name"]),
        "lineitem": (900, ["id AS l_orderkey", "id % 70 AS l_partkey", "id % 9 AS l_suppkey", "CAST(1 + id % 4 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity"]),
        "orders": (300, ["id AS o_orderkey", "id % 40 AS o_custkey"]),
        "events": (200, ["id AS event_id", "id % 30 AS user_id"]),
    }
    for name, (n, columns) in tables.items():
        spark.range(n).selectExpr(*columns).write.parquet(f"{path}/{name}.parquet")
    return Frames(spark, path)


def files_of(path):
    names = [name for name in os.listdir(path) if name.startswith("part-")]
    return sorted(names, key=lambda name: os.path.getmtime(f"{path}/{name}"))


def test_longer_deliveries_have_more_files(frames, monkeypatch):
    few = P.write_payloads(frames)
    monkeypatch.setattr(P, "LINES", 60)
    many = P.write_payloads(frames)
    assert len(files_of(few)) == 4 * P.FILES == 2 * P.half_of(frames, few)
    assert len(files_of(many)) >= 24 and P.half_of(frames, many) == len(files_of(many)) / 2
    read = [sorted(line for name in files_of(path) for line in gzip.open(f"{path}/{name}", "rt")) for path in (few, many)]
    assert read[0] == read[1] and len(read[0]) == 900 + 300 + 200 + 25 + 100
    assert max(sum(1 for _ in gzip.open(f"{many}/{name}")) for name in files_of(many)) <= 150


def test_files_are_in_order_of_arrival(frames, monkeypatch):
    monkeypatch.setattr(P, "LINES", 60)
    path, seen = P.write_payloads(frames), []
    for name in files_of(path):
        for line in gzip.open(f"{path}/{name}", "rt"):
            item = json.loads(line)
            if isinstance(item, list):
                seen.append((item[0]["message"]["updated"], item[0]["message"]["pokestop_id"]))
    want = [(1704067200 + i // 8 * 2073, f"stop_{i % 30}") for i in range(200)]
    assert seen == want


def test_a_message_is_parsed_once(spark, frames):
    payloads = read_payloads(spark, P.write_payloads(frames))
    plans = [routed_raw(payloads)["sightings"], routed_raw(payloads)["raids"]]
    for frame in plans:
        assert len(re.findall(r"from_json\(", frame._jdf.queryExecution().optimizedPlan().toString())) == 1
    text = wide_payloads(payloads).where("family = 'raids' AND lat > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", text)) == 4


def test_staged_routing_gives_the_same_rows(spark, frames, rows):
    payloads = read_payloads(spark, P.write_payloads(frames))
    plain, staged = routed_raw(payloads), routed_raw(payloads, staged=True)
    for family, frame in plain.items():
        columns = [c for c in frame.columns if c != "arrival"]
        assert rows(frame, *columns) == rows(staged[family], *columns) and frame.columns == staged[family].columns, family


def test_a_micro_batch_is_staged_once_and_leaves_nothing(spark, frames):
    batch = spark.read.schema(M.ENVELOPE).json(P.write_payloads(frames)).select("type", "message", _file_info())
    before = set(os.listdir(scratch_root(spark)))
    with _localised(batch, frames.index, 0) as events:
        for family, rows in events.items():
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "FileScan json" not in plan and "FileScan parquet" in plan, family
        assert events["raids"].count() == frames.events("raids").count() > 0
        assert len(set(os.listdir(scratch_root(spark))) - before) == 1
    assert set(os.listdir(scratch_root(spark))) == before


def test_outcomes_are_told_once(spark):
    """Level and reason read the outcome of the checks from one column."""
    payloads = spark.createDataFrame([("raid", "{}"), ("raid", None), ("x", "{}"), ("pokemon", "cut")], "type string, message string")
    rows = A.audited(payloads)
    assert [tuple(r) for r in rows.select("family", "reason").collect()] == [
        ("raids", "missing:gym"), ("raids", "no_message"), (None, "unknown_type"), ("sightings", "unreadable"),
    ]
    text = A.rejects(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ELSE missing:ex_eligible|THEN missing:ex_eligible", text)) == 1
