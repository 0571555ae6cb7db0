"""Streams flushed by rows: every micro-batch within the limit, nothing lost or repeated over a restart."""

import json

import pytest

from fieldtally.sources.payloads import buffer_rows, stream_buffered, stream_payloads


def deliver(folder, name, first, n):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"type": "raid", "message": {"n": i}}) for i in range(first, first + n)))


@pytest.mark.parametrize("limit", [1, 10, 1000])
def test_micro_batches_hold_the_limit_over_restarts(spark, tmp_path, limit):
    source, buffer, out = tmp_path / "in", str(tmp_path / "buffer"), {}
    total = 4 if limit == 1 else 47

    def flush(batch, batch_id):
        out[batch_id] = [json.loads(r["message"])["n"] for r in batch.collect()]

    def run():
        buffer_rows(stream_payloads(spark, str(source)), buffer, str(tmp_path / "m1"), limit).awaitTermination()
        query = stream_buffered(spark, buffer).writeStream.foreachBatch(flush).option("checkpointLocation", str(tmp_path / "m2"))
        query.trigger(availableNow=True).start().awaitTermination()

    deliver(source, "a.json", 0, total - 2)
    run()
    before = dict(out)
    deliver(source, "b.json", total - 2, 2)
    run()  # both streams go on from their checkpoints
    run()  # and have nothing left to do
    assert {k: out[k] for k in before} == before
    assert all(len(x) <= limit for x in out.values())
    assert sorted(n for x in out.values() for n in x) == list(range(total))
    assert len(out) == len(before) + (2 if limit == 1 else 1)
