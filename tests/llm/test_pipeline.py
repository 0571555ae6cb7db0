"""The pipeline's stages against brute force, and its behaviour on an empty table."""

from collections import Counter, defaultdict

import corpus_pipeline
from test_operators import SF, base_counts, brute_classes, contamination, words

from fieldtally.llm import mixing, quality
from fieldtally.llm.tables import stored, table


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, items = docs.columns, [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs.collect()
        assert name == "sharding" or docs.columns == columns
    first = table(spark, SF, "documents").collect()
    kept = {r["doc_id"] for r in quality.repetition_report(table(spark, SF, "documents")).where("kept").collect()}
    assert sorted(r["doc_id"] for r in out["quality_rules"]) == sorted(r["doc_id"] for r in first if r["doc_id"] in kept)
    assert all(base_counts(r["text"])[0] >= 50 for r in out["quality_rules"])
    rows = [(r["doc_id"], r["text"]) for r in out["quality_rules"]]
    assert sorted(r["doc_id"] for r in out["near_dedup"]) == sorted({c for _, c in brute_classes(rows)})
    assert sorted(r["doc_id"] for r in out["decontamination"]) == sorted(r["doc_id"] for r in out["near_dedup"] if not contamination(r["text"], items)[-1])
    copies = Counter(r["doc_id"] for r in out["source_mix"])
    taken, target = defaultdict(int), {}
    before = spark.createDataFrame(out["decontamination"], table(spark, SF, "documents").schema)
    for r in mixing.mix_report(before).collect():
        assert copies[r["doc_id"]] <= 3
    source = {r["doc_id"]: (r["source"], len(words(r["text"]))) for r in out["decontamination"]}
    for r in out["source_mix"]:
        taken[source[r["doc_id"]][0]] += source[r["doc_id"]][1]
    longest = defaultdict(int)
    for s, n in source.values():
        longest[s] = max(longest[s], n)
    sizes = spark.createDataFrame(list(source.values()), "source string, size bigint")
    target = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert all(0 <= taken[s] - round(t) <= longest[s] for s, t in target.items())  # the last document stays whole
    slots = defaultdict(list)
    for r in out["sharding"]:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in out["sharding"]) == copies


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0
