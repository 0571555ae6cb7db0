"""The audit of sources against plain Python, also with digests so short that most of them collide."""

import re
from collections import Counter, defaultdict

import pytest

from fieldtally.llm import divergence
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tables import table

SF = "/root/testdata/sf0.001"
TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, digest string, split int, value string"


def plain(docs, least=10, top=10):
    """docs: (lang, source, text)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = TERMS.findall(text.translate(LOW))
        count[lang, source].update(words)
        seen[lang].update(set(words))
    groups, out = sorted({d[:2] for d in docs}), []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // n for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        q = shares(whole)
        p = {g[1]: shares(count[g]) for g in groups if g[0] == lang}
        for s in p:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", item, -v, k) for k, (v, _, item) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", item, -v, k) for k, (v, _, item) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{chr(97 + i % 23)}{chr(97 + i % 19)}" for i in range(60_000))
    texts = [None, "", "12 34 --", "Same same SAME", "é日本 Éa ÉA", long, "x" * 300_000, "one two, three. one", "a b c d e f g"]
    rows = [(i, texts[i % 9], ["en", "de", None, "", "only"][i % 5], [None, "", "a", "b", "ä", "zz"][i % 6], "clash", 1, "clash") for i in range(180)]
    rows += [(None, "single", "rare", "a", None, None, None), (None, None, "rare", "b", None, None, None)] + [rows[3]] * 12
    return spark.createDataFrame(rows, SCHEMA)


def test_query_and_short_digests(spark, rows):
    docs = [(r["lang"], r["source"], r["text"]) for r in table(spark, SF, "documents").collect()]
    expected = plain(docs)
    assert rows(QUERIES["op12_source_divergence"](spark, SF)) == expected
    assert rows(divergence.audit(table(spark, SF, "documents"), bits=6)) == expected


def test_awkward_rows(spark, rows, awkward):
    expected = plain([(r["lang"], r["source"], r["text"]) for r in awkward.collect()])
    assert rows(divergence.audit(awkward)) == expected
    assert rows(divergence.audit(awkward, bits=2)) == expected
    assert divergence.audit(awkward.limit(0)).count() == 0
    few = awkward.limit(8)  # no term is in ten documents
    assert rows(divergence.audit(few)) == plain([(r["lang"], r["source"], r["text"]) for r in few.collect()])


def test_counts_beyond_long_products(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(7 * 10**15, 9 * 10**15, 3)], "c bigint, n bigint, v bigint")
    assert frame.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()["p"] == 1 + 10**9 * (7 * 10**15 + 2) // (9 * 10**15 + 6)
