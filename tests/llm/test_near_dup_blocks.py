"""Blocks of the last step of near-duplicates: bounded by texts, shingles and cells, with the links of a plain comparison."""

import numpy as np

from fieldtally.llm import near_dup as N


def texts(seed, n, shared=40):
    """Sorted ids and weights; groups of three share most of their ids."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = np.random.default_rng(i // 3).integers(0, 1 << 40, shared)
        ids = np.unique(np.concatenate([own, rng.integers(0, 1 << 40, int(rng.integers(0, 6)))])).astype(np.int64)
        out.append((ids, (1 + ids % 2).astype(np.int32)))
    return out


def test_overlaps_do_not_depend_on_the_cells():
    some = texts(1, 20)
    plain = np.zeros((20, 20))
    for i, (a, x) in enumerate(some):
        for j, (b, y) in enumerate(some):
            p, q = dict(zip(a, x / x.sum(), strict=True)), dict(zip(b, y / y.sum(), strict=True))
            plain[i, j] = sum(min(v, q[k]) for k, v in p.items() if k in q)
    for cells in (1, 50, 1000, 1 << 22):
        assert np.allclose(N.overlaps(some, some, cells), plain)
    assert N.overlaps([], some).shape == (20, 0) and N.overlaps(some, []).shape == (0, 20)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int32))
    assert not N.overlaps([none], some).any() and not N.overlaps(some, [none]).any()


def test_links_of_small_blocks_join_the_same_groups(spark):
    some = texts(2, 24)
    rows = spark.createDataFrame([(bytes([i]), [int(x) for x in ids], [int(w) for w in ws]) for i, (ids, ws) in enumerate(some)], "node binary, ids array<bigint>, weights array<int>")
    # each text is a component of its own; the first one counts as the largest
    members = spark.createDataFrame([(7, bytes([i]), bytes([i]), 24, 23, bytes([0])) for i in range(24)], "key bigint, node binary, root binary, all bigint, minor bigint, major binary")
    want = {frozenset((i, j)) for i in range(24) for j in range(i) if N.probability_jaccard(*some[i], *some[j]) >= 0.8}
    assert want
    for block, probe, cells in (((256, 1 << 19), (2048, 1 << 21), 1 << 22), ((4, 1 << 19), (7, 1 << 21), 64), ((256, 100), (2048, 150), 1)):
        got = {frozenset((r["a"][0], r["b"][0])) for r in N.block_links(members, rows, N.SKETCH, block, probe, cells).collect()}
        assert got == want
