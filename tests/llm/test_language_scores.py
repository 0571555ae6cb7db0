"""Word-first backoff written out plainly, and what the bounds of the model do; repeated rows in the blob ledger."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldtally.llm import langid, secret_scan
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.tables import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W\d_]+")


def plain(docs, longest=5):
    """docs: (id, text, lang). lang_pred and score by id, with nothing left out of the model."""
    train = [(t, lang) for i, t, lang in docs if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    languages = sorted({lang for _, lang in train})
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for t, lang in train:
        for w in WORD.findall(t.lower()):
            words[w][lang] += 1
            framed = f"^{w}$"
            for n in range(1, longest + 1):
                for k in range(len(framed) - n + 1):
                    grams[n][framed[k : k + n]][lang] += 1

    def table_of(counts):
        total = Counter()
        for c in counts.values():
            total.update(c)
        return {x: [math.log((c[lang] + 0.5) / (total[lang] + 0.5 * len(counts))) for lang in languages] for x, c in counts.items()}

    known, parts = table_of(words), {n: table_of(g) for n, g in grams.items()}
    size = Counter(lang for _, lang in train)

    def score(w):
        if w in known:
            return known[w]
        framed = f"^{w}$"
        for n in range(min(longest, len(framed)), 0, -1):
            text = framed if n > 1 else w
            rows = [parts[n][text[k : k + n]] for k in range(len(text) - n + 1) if text[k : k + n] in parts[n]]
            if rows:
                return [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        return [0.0] * len(languages)

    out = {}
    for i, t, _ in docs:
        found = WORD.findall((t or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            out[i] = ("und", 0.0)
            continue
        total = [math.log(size[lang] / len(train)) + sum(s[k] for s in map(score, found)) for k, lang in enumerate(languages)]
        best = max(range(len(languages)), key=lambda k: (total[k], -k))
        out[i] = (languages[best], 1 / sum(math.exp(x - total[best]) for x in total))
    return out


def test_predictions_against_plain_scores(spark):
    frame = table(spark, SF, "documents")
    want = plain([(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()])
    production = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op5_word_backoff"](spark, SF).collect()}
    assert sum(production[i] == lang for i, (lang, _) in want.items()) >= 0.99 * len(want)  # rare n-grams are left out there
    for r in langid.language_report(frame, bounds=langid.Bounds(words=10**6, grams=10**6)).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-6)


def test_small_languages_keep_their_words(spark):
    rows = [(i, " ".join(f"big{i}x{k}" for k in range(40)), "en") for i in range(50)] + [(100 + i, f"klein wort nummer{i}", "de") for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "id int, text string, lang string"), langid.Bounds(words=10, grams=30))
    assert {"klein", "wort"} <= set(model.words) and len(model.words) <= 20 and len(model.grams) <= 60
    assert model.score("klein").argmax() == 0


def test_repeated_rows_are_scanned_once(spark, tmp_path):
    rows = [(1, "password=abcdefgh")] * 5 + [(None, "secret: token_1234")] * 5 + [(None, None)] * 3
    ledger = str(tmp_path / "ledger")
    found = secret_scan.secret_report(spark.createDataFrame(rows, "doc_id int, text string"), ledger).collect()
    assert len(found) == 13 and sum(r["n_assign"] for r in found) == 10
    assert spark.read.parquet(ledger).count() == 3
