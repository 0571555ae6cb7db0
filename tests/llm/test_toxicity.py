"""The decoder against all paths of a lattice, restored disguises, the classifier on held-out and planted documents."""

import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import toxicity as tx
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tables import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, toxic string, score string, held_out int, id int"
#: a made-up vocabulary that marks the documents to be found
MARKS = ["grobnik", "stavulent", "pezzomar"]
DISGUISES = ["gr0bn1k", "g r o b n i k", "grooooobnik", "5tavulent", "st@vul3nt", "p.e.z.z.o.m.a.r", "pezz0mar", "gr*bnik", "s-t-a-v-u-l-e-n-t", "grоbnik", "grob​nik", "ｇｒｏｂｎｉｋ"]


@pytest.fixture(scope="module")
def model(spark):
    return tx.letter_model(tx.letter_counts(table(spark, SF, "documents").select("text")))


def all_paths(units, model):
    """The best total of a lattice by trying every path."""
    best = -math.inf
    for path in itertools.product(*units):
        a = b = 0
        total = sum(cost for _, cost in path)
        for c in map(tx.code, "".join(text for text, _ in path)):
            if c or a or b:
                total += model[(a * 64 + b) * 64 + c]
            a, b = (b, c) if c else (0, 0)
        total += model[(a * 64 + b) * 64] if a or b else 0.0
        best = max(best, total)
    return best


def test_viterbi_finds_the_best_of_all_paths(model):
    rng = random.Random(5)
    for n in range(60):
        spaced = n % 3 == 0
        stretch = "".join(rng.choice("abest013$oo.  " if spaced else "abest013$ooxéа") for _ in range(rng.randint(1, 8)))
        units = tx.readings(stretch, spaced)
        text = tx.decode(units, model)
        reached = [p for p in itertools.product(*units) if "".join(t for t, _ in p) == text]
        assert reached and math.isclose(max(all_paths([[step] for step in p], model) for p in reached), all_paths(units, model)), stretch


def test_pairs_of_letters_are_choices_of_their_own(spark, model):
    rng = random.Random(8)
    words = {"".join(c * rng.choice((1, 1, 2)) for c in rng.choices("abdeilnorstué", k=rng.randint(1, 9))) for _ in range(800)} | {"ii", "oo", "aabb"}
    words = [w for w in words if not tx.TRIPLE.search(w)]
    assert [tx.single(w, model) for w in words] == [tx.decode(tx.readings(w), model) for w in words]
    assert any(tx.single(w, model) != w for w in words) and any(tx.single(w, model) == w for w in words if tx.DOUBLE.search(w))


def test_letter_counts(spark, model):
    texts = ["Ab, abé x", None, "", "12 ab", "y" * (tx.SLICE + 5)]
    counts = tx.letter_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert counts[0, 0, 1] == 3 and counts[0, 1, 2] == 3 and counts[1, 2, 0] == 2 and counts[1, 2, tx.code("é")] == 1
    assert counts[25, 25, 25] == tx.SLICE + 3 and counts[25, 25, 0] == 1
    # the probabilities after any two letters add up to one
    assert all(abs(sum(math.exp(model[(a * 64 + b) * 64 + c]) for c in range(64)) - 1) < 1e-9 for a, b in [(0, 0), (0, 5), (20, 8), (63, 27)])


def test_plain_words_pass(model):
    restorer = tx.Restorer(model)
    assert restorer.words("The later, was on__that day. 12.5 -- (under)") == ["the", "later", "was", "on", "that", "day", "under"]
    assert restorer.words(None) == restorer.words("") == restorer.words("$$ 12 *** !!") == []
    assert restorer.words("aé" * 100_000) == ["aé" * 100_000] and len(restorer.words("z" * 300_000)) == 1
    assert len(restorer.words("a1" * 30_000)) >= 1


def planted(n=1_500, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["th", "er", "on", "an", "st", "re", "ou", "in"]) for _ in range(rng.randint(1, 3))) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(MARKS)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_disguised_words_are_found(spark):
    rows = planted()
    hidden = [(10_000 + i, f"on the red {d} in that inner street") for i, d in enumerate(DISGUISES)]
    clean = [(20_000 + i, t) for i, t in enumerate(["on the red street 12 in that inner 3 rent", "a b c on 5 the 7 other", None, "", "stern!!! 100% re$t"])]
    docs = spark.createDataFrame([(i, t, "x", "x", 1, 1) for i, t in [r[:2] for r in rows] + hidden + clean] + [(None, "stern", None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (5, 0)], "doc_id bigint, toxic int")
    found = {r["doc_id"]: r for r in tx.toxicity_report(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(found[i]["predicted"] == 1 for i, _ in hidden), [(t, found[i]["score"]) for i, t in hidden]
    assert all(found[i]["predicted"] == 0 for i, _ in clean) and found[None]["predicted"] == 0
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found if i is not None)
    assert all(found[i]["predicted"] == y for i, _, y in held)
    again = tx.toxicity_report(docs.repartition(7), labels.repartition(3))
    assert {r["doc_id"]: r["predicted"] for r in again.collect()} == {i: r["predicted"] for i, r in found.items()}


def test_held_out_labels_are_not_read(spark):
    rows = planted(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tx.toxicity_report(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "stern"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r["score"], r["predicted"]) for r in tx.toxicity_report(docs, none).collect()] == [(0.5, 0), (0.5, 0)]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    clean = spark.createDataFrame([(i, 0) for i in ids], "doc_id bigint, toxic int")
    assert [r["score"] for r in tx.toxicity_report(docs, clean).collect()] == pytest.approx([0.5 / (len(ids) + 1)] * 2)
    assert tx.toxicity_report(docs.limit(0), clean).count() == 0


def test_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    found = QUERIES["op11_noisy_channel"](spark, SF).collect()
    assert len(found) == table(spark, SF, "documents").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(labels[r["doc_id"]], r) for r in found if r["held_out"] and r["doc_id"] in labels]
    caught = sum(r["predicted"] for y, r in held if y == 1)
    assert caught >= 0.7 * sum(y == 1 for y, _ in held) and sum(r["predicted"] for y, r in held if y == 0) <= 0.02 * len(held)
