"""Hard negatives against all scores worked out in plain Python, and the safety of the angular bounds."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldtally.llm import hard_negatives as hn
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, slot string, angles string, id bigint"


def plain(rows, every, keep=5):
    """rows: (id, vector, label) that take part."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    out = []
    for a, av, al in sorted({(i, tuple(v), label) for i, v, label in whole if i % every == 0}):
        scored = [(-sum(x * y for x, y in zip(av, v, strict=False)), i, label) for i, v, label in whole]
        near = sorted((s, i) for s, i, label in scored if label == al and i != a)[:keep]
        for s, p in near:
            far = sorted((t, i) for t, i, label in scored if label != al and 80 * -s <= 100 * -t <= 100 * -s)[:keep]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(far, 1)]
    return sorted(out)


def test_query_against_all_scores(spark, rows):
    data = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table(spark, SF, "embeddings").collect()]
    assert rows(QUERIES["op13_angular_negatives"](spark, SF)) == sorted(plain(data, 100), key=repr)


def test_clusters_ties_nulls_and_repeats(spark, rows):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    good = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.randrange(3)) for i in range(600)]
    good += [(1000 + i, good[20][1], i % 2) for i in range(40)]  # ties
    good += [good[7], good[7], good[10], (2000, [0.0] * 6, 1), (2010, [], 1), (2020, [1.0, 2.0], 0), (-10, [5.0] * 6, 2)]
    nan, inf = float("nan"), float("inf")
    bad = [(None, [1.0] * 6, 1), (30000, None, 1), (30010, [1.0] * 6, None), (30020, [1.0, None], 1), (30030, [nan] * 6, 1), (30040, [inf, 1.0], 1), (30050, [1e30] * 6, 1)]
    frame = spark.createDataFrame([(*r, 1, "x", "y", 5) for r in good + bad], SCHEMA)
    assert rows(hn.hard_negatives(frame, F.col("id") % 10 == 0)) == sorted(plain(good, 10), key=repr)
    assert hn.hard_negatives(frame.limit(0), F.lit(True)).count() == 0
    assert hn.hard_negatives(frame, F.lit(False)).count() == 0


def test_several_blocks_give_the_same(spark, rows, monkeypatch):
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    monkeypatch.setattr(hn, "BLOCK_VALUES", 64 * 7)
    assert rows(hn.hard_negatives(table(spark, SF, "embeddings"), F.col("id") % 25 == 0)) == sorted(plain(data, 25), key=repr)


def test_bounds_are_safe_and_close_where_directions_are():
    rng = np.random.default_rng(1)
    v = np.floor(256 * np.concatenate([rng.normal(size=(200, 16)), np.ones((5, 16)), -np.ones((5, 16)), np.zeros((2, 16))]))
    directions = hn.spread_out(v, 8)
    r = hn.Rows(np.arange(len(v)), np.zeros(len(v)), v, np.sqrt((v * v).sum(axis=1)), hn.angles_to(v, directions))
    low, high = hn.score_bounds(r, r)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.allclose(hn.scores(r, r, np.ones(exact.shape, bool)), exact) and np.allclose(hn.scores(r, r, np.eye(len(v), dtype=bool)), np.diag(np.diag(exact)))
    near = hn.Rows(r.ids, r.labels, v, r.lengths, hn.angles_to(v, v[:1] / r.lengths[0]))
    low, high = hn.score_bounds(near, near)  # the first row is itself a direction: its scores are all but known
    assert (high[0] - low[0] <= 4 + 1e-5 * r.lengths[0] * r.lengths).all()
