"""Rows that operators must not stumble over: malformed records, shared and missing ids, columns with clashing names."""

import json

import pytest

from fieldtally.llm import chat, near_dup, sharding

LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))


def test_malformed_records(spark):
    good = json.dumps({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "a \ud800 b"}]})
    bad = [
        '{"messages":[{"role":"user","content":"x"}, null]}', '{"messages":[{"role":"user","content":"x"}, "oops"]}', '{"messages":[{"role":"user","content":"x"}, 5, []]}',
        '{"messages":' * 3_000 + "1" + "}" * 3_000, '{"a":' * 3_000 + "1" + "}" * 3_000, "[" * 100_000 + "]" * 100_000, '{"messages": 5}', "null", "", None, "{", "[1]",
        '{"messages":{"role":"user","content":"x"}}',
    ]
    rows = [(0, good)] + [(i, t) for i, t in enumerate(bad, 1)]
    found = chat.canonical_turns(spark.createDataFrame(rows, "id int, record string"), ["id"]).collect()
    assert [(r["role"], r["text"]) for r in found if r["id"] == 0] == [("user", "hi"), ("assistant", "a � b")]
    assert sorted((r["id"], r["part"], r["role"], r["text"]) for r in found if r["id"] != 0) == [(i, None, None, None) for i in range(1, len(rows))]
    deep = '{"prompt":"p","completion":"c","meta":' + "[" * 500 + "]" * 500 + "}"  # what no mapping names may be nested at will
    found = chat.canonical_turns(spark.createDataFrame([(1, deep)], "id int, record string"), ["id"]).collect()
    assert [(r["role"], r["text"]) for r in found] == [("user", "p"), ("assistant", "c")]


CLASHING = "doc_id bigint, text string, _id string, _bucket int, _spread int, _region string, _crc int, _n int, doc string, key string, _1 int, `a.b` int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, 2, "r", 3, 4, "d", "k", 5, 6) for r in rows], CLASHING)


def test_one_of_each_loses_no_text(spark):
    docs = clashing(spark, [(1, LONG), (1, OTHER), (2, LONG), (3, OTHER), (None, LONG + " end"), (None, "alone here"), (None, "alone here"), (4, None), (4, None), (None, None), (5, ""), (6, "")])
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(
        map(str, [(1, LONG), (1, OTHER), (None, "alone here"), (4, None), (4, None), (None, None), (5, "")])
    )
    assert {tuple(r)[2:] for r in kept.collect()} == {("i", 1, 2, "r", 3, 4, "d", "k", 5, 6)}


@pytest.mark.parametrize("n", [1, 300])
def test_sharding_keeps_all_columns(spark, n):
    docs = clashing(spark, [(i % 150, f"t{i}") for i in range(n)] + [(None, None)] * 3)
    out = sharding.sharded(docs)
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == n + 3
    assert {tuple(r)[2:-2] for r in out.collect()} == {("i", 1, 2, "r", 3, 4, "d", "k", 5, 6)}
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.sharded(out)  # columns of these names are replaced
    assert again.columns == out.columns and sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
