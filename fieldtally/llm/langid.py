"""Language identification, words first: a known word is scored by its log frequency in each language; an unseen word by the
longest character n-grams (five down to one) of which any is known.

The classifier is fitted on a bounded sample: ``sample_docs`` labelled documents a language, chosen by a hash of the id. Of the
words and n-grams in them it keeps, for each language, the ``words`` and ``grams`` most often seen in that language, with their
counts in all languages; so a language of few documents keeps its own words beside any other. The model is a table that Spark
counts, of a size bounded by the number of languages; it is sent to all tasks. Prediction is a map over all rows without a shuffle.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or nothing could be learned; a text with letters but
nothing known gets the language with most documents; equal scores go to the smaller language name; repeated rows are predicted
alike; an empty table gives an empty result. A null id counts as an empty text in the folds. Only id, text and, for learning,
the language are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Bounds:
    """What the model may hold of each language: documents, words, n-grams; and the longest n-gram."""

    sample_docs: int = 4_000
    words: int = 40_000
    grams: int = 40_000
    longest: int = 5


BOUNDS = Bounds()


@dataclass
class Model:
    """languages, their log priors, rows of the tables by word and by n-gram, and log frequencies by row and language."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    longest: int

    def unseen(self, word: str) -> np.ndarray:
        """Mean score of the known n-grams of the longest length that has any; zeros if there are none."""
        framed = f"^{word}$"
        for n in range(min(self.longest, len(framed)), 0, -1):
            text = framed if n > 1 else word
            at = [i for k in range(len(text) - n + 1) if (i := self.grams.get(text[k : k + n])) is not None]
            if at:
                return self.gram_scores[at].mean(axis=0)
        return np.zeros(len(self.languages))

    def score(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        return self.unseen(word) if at is None else self.word_scores[at]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def log_table(counts: DataFrame, languages: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Rows of the ``most`` frequent entries of each language among (item, lang, n), and their smoothed log frequencies in all."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    chosen = counts.withColumn("place", place).where(F.col("place") <= most).select("item").distinct()
    of_lang = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    rows = counts.join(chosen, "item", "left_semi").groupBy("item").agg(*of_lang).orderBy("item").toArrow()
    seen = np.stack([rows[f"n{i}"].to_numpy().astype(np.float64) for i in range(len(languages))], axis=1) if rows.num_rows else np.zeros((0, len(languages)))
    items = rows["item"].to_pylist()
    kinds = np.array([len(x) for x in items]) if counts.columns[-1] == "size" else np.zeros(len(items), dtype=int)
    scores = np.zeros_like(seen)
    for kind in np.unique(kinds):  # n-grams of one length share their mass
        here = kinds == kind
        scores[here] = np.log((seen[here] + 0.5) / (seen[here].sum(axis=0) + 0.5 * here.sum()))
    return {x: i for i, x in enumerate(items)}, scores


def fit(labelled: DataFrame, bounds: Bounds = BOUNDS) -> Model:
    """Model of the rows (id, text, lang) with a language and a text."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)), bounds.longest)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, bounds.sample_docs / sizes[name])))])
    point = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(point < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.update((w, lang) for w in words_of(text))
            yield pa.RecordBatch.from_pydict({"item": [k[0] for k in seen], "lang": [k[1] for k in seen], "n": pa.array(list(seen.values()), pa.int64())})

    counts = sample.select("text", "lang").mapInArrow(count, "item string, lang string, n bigint").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    words, word_scores = log_table(counts, languages, bounds.words)
    framed = F.concat(F.lit("^"), F.col("item"), F.lit("$"))

    def of_size(size: int) -> Column:
        if size == 1:
            return F.split(framed, "")
        return F.transform(F.sequence(F.lit(1), F.length(framed) - size + 1), lambda at: F.substring(framed, at, F.lit(size)))

    parts = [of_size(size) for size in range(1, bounds.longest + 1)]
    parts = [F.when(F.length(framed) >= size, part).otherwise(F.array().cast("array<string>")) for size, part in enumerate(parts, 1)]
    grams = counts.select(F.explode(F.concat(*parts)).alias("item"), "lang", "n").where("item <> ''").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    grams, gram_scores = log_table(grams.withColumn("size", F.length("item")), languages, bounds.grams)
    prior = np.log(np.array([sizes[name] for name in languages], dtype=np.float64) / sum(sizes.values()))
    return Model(languages, prior, words, word_scores, grams, gram_scores, bounds.longest)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """Per document: id, held_out, lang_pred, score (the share of the best language in the likelihood)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        rows: dict[str, int] = {}
        table = np.zeros((1024, len(model.languages)))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                langs, scores = [], []
                for text in batch.column("text").to_pylist():
                    seen = Counter(words_of(text))
                    if not model.languages or not any(c.isalpha() for w in seen for c in w):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    if len(rows) + len(seen) > 300_000:  # a bounded memory of words, not of texts
                        rows.clear()
                    if len(rows) + len(seen) > len(table):
                        table = np.concatenate([table, np.zeros((max(len(table), len(seen)), table.shape[1]))])
                    for w in [w for w in seen if w not in rows]:
                        table[len(rows)] = model.score(w)
                        rows[w] = len(rows)
                    at = np.fromiter(map(rows.__getitem__, seen), dtype=np.int64, count=len(seen))
                    total = model.prior + np.fromiter(seen.values(), dtype=np.float64, count=len(seen)) @ table[at]
                    best = int(np.argmax(total))
                    langs.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, bounds: Bounds = BOUNDS) -> DataFrame:
    """Predictions for all documents by a model of the rows outside fold 0."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    return predict(docs, fit(labelled.where(fold(F.col("id"), folds) != 0), bounds), id_col, text_col, folds)
