"""The language model's pairs are shuffled in lists, its tables go when they are replaced, and its draws don't depend on partitions."""

import os
import random

import numpy as np
import pytest

from fieldtally.llm import pitman_yor
from fieldtally.llm.tables import dropped, stored
from fieldtally.session import scratch_root


def test_scores_do_not_depend_on_partitions_and_replaced_tables_are_deleted(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(60)) for _ in range(80)]
    rows = [(None if i == 7 else i % 78, None if i == 9 else text) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    before = set(os.listdir(scratch_root(spark)))
    one = sorted(map(repr, ((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in pitman_yor.score_report(docs.coalesce(1)).collect())))
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(scratch_root(spark))) - before} == {"lm-seats", "lm-scores"}
    few = pitman_yor.Settings(hot_words=20, hot_pairs=5)
    many = spark.createDataFrame(rows[::-1], "doc_id int, text string").repartition(3, "doc_id")
    assert one == sorted(map(repr, ((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in pitman_yor.score_report(many, settings=few).collect())))
    assert len(one) == 80


def test_pairs_are_not_shuffled_as_rows(spark):
    docs = spark.createDataFrame([("a b a b c",), ("b a",), (None,)], "text string")
    pairs = pitman_yor.pair_counts(docs)
    exchange = next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x)
    assert "data#" in exchange  # a packed list by bucket
    h = {w: r["h"] for r in pitman_yor.word_counts(docs.selectExpr("text", "true AS train")).collect() for w in [bytes(r["word"]).decode()]}
    want = {("", "a"): 1, ("a", "b"): 2, ("b", "a"): 2, ("b", "c"): 1, ("c", ""): 1, ("", "b"): 1, ("a", ""): 1, ("", ""): 1}
    assert {(r["uc"], r["wc"]): r["n"] for r in pairs.collect()} == {(h[u], h[w]): n for (u, w), n in want.items()}


@pytest.mark.parametrize("n, pull", [(40, 3.0), (3000, 2000.0)])
def test_draws_by_key_have_the_mean_of_free_draws(n, pull):
    keys, size = np.arange(20_000, dtype=np.uint64), 20_000 if n < 100 else 300
    mine = pitman_yor.tables_of(np.full(size, n), np.full(size, pull), 0.5, pitman_yor.Draws(keys[:size], 4))
    free = pitman_yor.tables_of(np.full(size, n), np.full(size, pull), 0.5, np.random.default_rng(4))
    assert mine.mean() == pytest.approx(free.mean(), rel=0.01) and mine.std() == pytest.approx(free.std(), rel=0.15)
    turned = pitman_yor.tables_of(np.full(size, n), np.full(size, pull), 0.5, pitman_yor.Draws(keys[:size][::-1], 4))
    assert (turned[::-1] == mine).all()


def test_only_stored_tables_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own, kept = spark.read.parquet(str(tmp_path / "own")), stored(spark.range(2), "kept")
    at = set(os.listdir(scratch_root(spark)))
    dropped(own, kept)
    assert own.count() == 3 and len(at - set(os.listdir(scratch_root(spark)))) == 1
