"""Toxicity of texts behind disguises: a noisy-channel decoder restores words, a classifier scores the restored text.

A language model of letter triples (in words, over all texts) says how likely a word is. What is seen instead of a letter is
the channel: a digit or symbol that looks like it, a letter of another script, a repetition, a star over it, separators
between single letters. A disguised stretch becomes a lattice: each place has a few readings with a log probability, and
Viterbi's algorithm finds the path whose readings and letters are likeliest together; the states are the last two letters, so the
result is the exact optimum. Words of letters without repetitions have one reading and pass as they are.

The classifier sees which words, 4- to 6-letter parts of words and beginnings of words a restored text has. Parts that labelled toxic documents have
more often than chance get weights of a logistic regression, none below zero. It is fitted on at most ``sample_docs`` labelled
documents a class (chosen by a hash of the id; near copies, by two smallest hashes of five-word shingles, count once) and
``features`` parts; class weights undo the sampling. The letter counts, of fixed size, cover all texts. Prediction is a map.

Defined cases: null and empty texts get the score of a text without any sign; without labels of both classes all scores are the
smoothed share of toxic ones (0.5 without any label); null labels and ids teach nothing; of several labels of an id the
highest counts; repeated rows are scored alike; an empty table gives an empty result. Only id, text and the label are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import stored

# What a character can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
SAME_SHAPE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Log probabilities of the channel.
AS_LETTER, AS_BREAK, OTHER_SCRIPT, STAR = -1.0, -4.0, -1.0, -math.log(26)
PAIR_FOR_ONE, RUN_FOR_ONE, RUN_FOR_TWO = -6.0, -1.0, -1.5
NO_SEPARATOR, SEPARATOR = -0.2, -3.0

INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
TOKEN = re.compile(r"[\w@$!|+*]+")
SPACED = re.compile(r"(?<![\w@$!|+*])[\w@$!|+](?:[ .\-*~/]{1,2}[\w@$!|+]){2,}(?![\w@$!|+*])")
DOUBLE, TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1*", re.DOTALL)
#: 26 letters, and 37 classes of all others
CODES = 64
SLICE = 1 << 18
#: words up to this length are remembered by a task, and so many of them
SHORT, REMEMBERED = 40, 200_000


@dataclass(frozen=True)
class Bounds:
    """What the classifier may hold: labelled documents of a class, parts of words, and the documents a part must be in."""

    sample_docs: int = 4_000
    features: int = 3_000
    least_docs: int = 3
    chance: float = 15.0  #: log-likelihood ratio that a part must exceed


BOUNDS = Bounds()


@lru_cache(maxsize=1 << 16)
def code(char: str) -> int:
    """0 for what is no letter, 1 to 26 for a to z, up to 63 for the classes of other letters."""
    if not char.isalpha() or ord(char) > 0xFFFF:
        return 0
    lower = char.lower()[0]
    return ord(lower) - 96 if "a" <= lower <= "z" else 27 + ord(lower) % 37


_codes: np.ndarray | None = None


def codes_of(text: str) -> np.ndarray:
    """Codes of the characters, with every non-letter twice, so that words don't look over their borders."""
    global _codes
    if _codes is None:
        _codes = np.array([0 if 0xD800 <= i < 0xE000 else code(chr(i)) for i in range(0x10000)], dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    found = _codes[np.where(points < 0x10000, points, 0)]
    return np.repeat(found, np.where(found == 0, 2, 1))


def letter_counts(texts: DataFrame) -> np.ndarray:
    """How often each letter triple stands in the words of all texts: CODES^3 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                before = np.zeros(2, dtype=np.int64)
                for at in range(0, len(text or ""), SLICE):
                    codes = np.concatenate([before, codes_of(text[at : at + SLICE]), [0, 0] if at + SLICE >= len(text) else []]).astype(np.int64)
                    cells = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
                    # counting by sorting is cheaper than a pass over all cells while texts are short
                    if len(cells) < 4096:
                        cell, n = np.unique(cells, return_counts=True)
                        total[cell] += n
                    else:
                        total += np.bincount(cells, minlength=CODES**3)
                    before = codes[-2:]
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    rows = texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # one row a cell at most
    out = np.zeros(CODES**3, dtype=np.float64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(CODES, CODES, CODES)


def letter_model(counts: np.ndarray, weight: float = 5.0) -> list[float]:
    """Log probability of a letter after two others, each order smoothed by the next shorter one."""
    counts = counts.copy()
    counts[:, 0, 0] = 0.0  # a word has ended; the next begins with a letter
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + weight * one) / (two.sum(axis=1, keepdims=True) + weight)
    three = (counts + weight * two[None]) / (counts.sum(axis=2, keepdims=True) + weight)
    return np.log(three).ravel().tolist()


Unit = list[tuple[str, float]]


def readings(stretch: str, spaced: bool = False) -> list[Unit]:
    """The lattice of a stretch: for each place its possible readings; a blank ends a word."""
    other_script = any("a" <= c <= "z" for c in stretch)
    units: list[Unit] = []
    for match in RUN.finditer(stretch):
        char, n = match.group(1), match.end() - match.start()
        if char == "*" and not spaced:
            units += [[(c, STAR) for c in LETTERS]] * n
        elif char in LOOKS_LIKE:
            unit = [(c, AS_LETTER) for c in LOOKS_LIKE[char]] + [(" ", AS_BREAK)]
            unit += [(c + c, AS_LETTER) for c in LOOKS_LIKE[char] if n > 1]
            units.append(unit)
        elif not char.isalpha():
            units.append([(" ", SEPARATOR), ("", NO_SEPARATOR)] if spaced else [(" ", 0.0)])
        else:
            as_is = [(char, 0.0)] + ([(SAME_SHAPE[char], OTHER_SCRIPT)] if other_script and char in SAME_SHAPE else [])
            if n == 1:
                units.append(as_is)
            elif n == 2:
                units.append([(c * 2, cost) for c, cost in as_is] + [(c, cost + PAIR_FOR_ONE) for c, cost in as_is])
            else:
                units.append([(c, cost + RUN_FOR_ONE) for c, cost in as_is] + [(c * 2, cost + RUN_FOR_TWO) for c, cost in as_is])
    return units


def decode(units: list[Unit], model: list[float]) -> str:
    """The likeliest reading of a lattice; of equals the first."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for unit in units:
        options = [(text, cost, [code(c) for c in text]) for text, cost in unit]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a0, b0), (score, path) in states.items():
            for text, cost, codes in options:
                a, b, total = a0, b0, score + cost
                for c in codes:
                    if c:
                        total += model[(a * CODES + b) * CODES + c]
                        a, b = b, c
                    elif a or b:
                        total += model[(a * CODES + b) * CODES]
                        a = b = 0
                if (a, b) not in after or total > after[a, b][0]:
                    after[a, b] = (total, (path, text))
        states = after
    best, path = -math.inf, None
    for (a, b), (score, link) in states.items():
        total = score + (model[(a * CODES + b) * CODES] if a or b else 0.0)
        if total > best:
            best, path = total, link
    parts = []
    while path is not None:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def single(word: str, model: list[float]) -> str:
    """What :func:`decode` finds for a word of letters in which at most two in a row are equal.

    One or two of a letter c between x and y leave the same last two letters (c, y) behind, so each pair is a choice of its own.
    """
    out, at = [], 0
    for match in DOUBLE.finditer(word):
        i = match.start()
        x, c, y = code(word[i - 1]) if i else 0, code(word[i]), code(word[i + 2]) if i + 2 < len(word) else 0
        twice = model[(x * CODES + c) * CODES + c] + model[(c * CODES + c) * CODES + y]
        if PAIR_FOR_ONE + model[(x * CODES + c) * CODES + y] > twice:
            out.append(word[at : i + 1])
            at = i + 2
    return "".join(out) + word[at:] if out else word


@dataclass
class Restorer:
    """Restores the words of texts, and remembers short ones."""

    model: list[float]
    known: dict[str, list[str]] = field(default_factory=dict)

    def token(self, token: str) -> list[str]:
        found = self.known.get(token)
        if found is None:
            core = token.strip("!|+*")
            if core.isalpha() and not TRIPLE.search(core) and (core.isascii() or not any(c in SAME_SHAPE for c in core)):
                found = [single(core, self.model)]
            elif any(c.isalpha() for c in core):
                found = decode(readings(core), self.model).split()
            else:
                found = []
            if len(token) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = found
        return found

    def spaced(self, match: re.Match) -> str:
        stretch = match.group(0)
        return f" {decode(readings(stretch, spaced=True), self.model)} " if sum(c.isalpha() for c in stretch) > 1 else stretch

    def tokens(self, text: str | None) -> list[str]:
        text = (text or "").lower()
        if not text.isascii():
            text = INVISIBLE.sub("", text)
            if not unicodedata.is_normalized("NFKC", text):
                text = unicodedata.normalize("NFKC", text)
        return TOKEN.findall(SPACED.sub(self.spaced, text.replace("_", " ")))

    def words(self, text: str | None) -> list[str]:
        """The restored words in order."""
        return [w for t in self.tokens(text) for w in self.token(t)]


def parts_of(word: str) -> set[str]:
    """The word, its parts of four to six characters with marks at its ends, and its beginnings with what length follows."""
    framed, n_letters = f"^{word}$", len(word)
    parts = {framed[i : i + n] for n in (4, 5, 6) for i in range(len(framed) - n + 1)}
    return parts | {framed} | {f"^{word[:n]}+{(n_letters - n + 1) // 2}" for n in (4, 5, 6) if n < n_letters}


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@dataclass
class Classifier:
    base: float
    index: dict[str, int]
    weights: np.ndarray
    heads: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.heads = {part[:4] for part in self.index}

    def signs(self, word: str) -> list[int]:
        """Features of a word; parts are only looked up if any feature begins like one of them."""
        framed = f"^{word}$"
        if self.heads.isdisjoint({framed[i : i + 4] for i in range(max(1, len(framed) - 3))}):
            return []
        return [at for part in parts_of(word) if (at := self.index.get(part)) is not None]


def fitted(rows: list[np.ndarray], toxic: np.ndarray, weights: np.ndarray, n_features: int, ridge: float = 0.1, rounds: int = 1_000) -> tuple[float, np.ndarray]:
    """Logistic regression with no weight below zero, by accelerated projected gradient steps. rows: the features of each document."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if len(row) else np.zeros(0, np.int64)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[at], minlength=len(rows)).astype(np.float64)

    def back(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v[row], minlength=n_features).astype(np.float64)

    v = np.ones(n_features)
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(weights * forward(v))
        v /= max(np.linalg.norm(v), 1e-12)
    curve = 0.25 * (1.5 * np.linalg.norm(back(weights * forward(v))) + weights.sum()) + ridge
    w = ahead = np.zeros(n_features)
    base = base_ahead = math.log((weights @ toxic + 0.5) / (weights @ (1 - toxic) + 0.5))
    pace = 1.0
    for _ in range(rounds):
        miss = weights * (1 / (1 + np.exp(-np.clip(base_ahead + forward(ahead), -40, 40))) - toxic)
        new = np.maximum(ahead - (back(miss) + ridge * ahead) / curve, 0.0)
        new_base = base_ahead - (miss.sum() + 0.01 * base_ahead) / curve
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, base_ahead = new + (pace - 1) / faster * (new - w), new_base + (pace - 1) / faster * (new_base - base)
        w, base, pace = new, new_base, faster
    return base, w


def sketch(words: list[str]) -> tuple[int, int]:
    """Two smallest hashes of the five-word shingles."""
    hashes = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
    return min(hashes), min((h * 0x9E3779B1 ^ 0x85EBCA6B) & 0xFFFFFFFF for h in hashes)


def fit(docs: DataFrame, labels: DataFrame, model: list[float], bounds: Bounds = BOUNDS) -> Classifier:
    """docs: id, text. labels: id, toxic (one row an id, no nulls)."""
    spark = docs.sparkSession
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    base = math.log((toxic + 0.5) / (clean + 0.5))
    if not clean or not toxic:
        return Classifier(base, {}, np.zeros(0))
    share = {y: min(1.0, bounds.sample_docs / n) for y, n in sizes.items()}
    point = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(point < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    sent = spark.sparkContext.broadcast(model)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            words = [restorer.words(t) for t in batch.column("text").to_pylist()]
            marks = [sketch(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("toxic"), pa.array([m[0] << 32 | m[1] for m in marks], pa.uint64()).view(pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
                names=["id", "toxic", "mark", "words"],
            )

    # the chosen labels are bounded by twice ``sample_docs``; so are the documents that meet them, and their words
    sample = docs.join(F.broadcast(chosen), "id")
    schema = f"id {sample.schema['id'].dataType.simpleString()}, toxic int, mark bigint, words array<string>"
    restored = sample.select("id", "toxic", F.col("text")).mapInArrow(restore, schema)
    restored = stored(restored.groupBy("mark", "toxic").agg(F.min_by("words", "id").alias("words")), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for y, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                seen[y].update(set().union(*map(parts_of, words)))
        for y in (0, 1):
            yield pa.RecordBatch.from_pydict({"part": pa.array(seen[y].keys(), pa.string()), "clean": pa.array([n * (1 - y) for n in seen[y].values()], pa.int64()), "toxic": pa.array([n * y for n in seen[y].values()], pa.int64())})

    n = restored.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).first()
    found = restored.select("toxic", "words").mapInArrow(count, "part string, clean bigint, toxic bigint").groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    each = F.col("clean") + F.col("toxic")
    ratio = 2 * (term(F.col("toxic"), each * (n["toxic"] / (n["toxic"] + n["clean"]))) + term(F.col("clean"), each * (n["clean"] / (n["toxic"] + n["clean"]))))
    more = F.col("toxic") * n["clean"] > F.col("clean") * n["toxic"]
    best = found.where((F.col("toxic") >= bounds.least_docs) & more).withColumn("ratio", ratio).where(F.col("ratio") > bounds.chance)
    index = {r["part"]: i for i, r in enumerate(best.orderBy(F.desc("ratio"), "part").limit(bounds.features).collect())}
    sent_index = spark.sparkContext.broadcast(Classifier(base, index, np.zeros(len(index))))

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({s for w in words for s in sent_index.value.signs(w)}) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "signs"])

    rows = restored.select("toxic", "words").mapInArrow(signs, "toxic int, signs array<bigint>").toArrow()  # bounded by the sample
    toxic_rows = rows["toxic"].to_numpy().astype(np.float64)
    weights = np.where(toxic_rows == 1, 1 / share[1], 1 / share[0])
    base, learned = fitted([np.array(x, dtype=np.int64) for x in rows["signs"].to_pylist()], toxic_rows, weights, len(index))
    return Classifier(base, index, learned)


def predict(docs: DataFrame, model: list[float], classifier: Classifier, folds: int, held: int, threshold: float) -> DataFrame:
    """docs: id, text."""
    sent = docs.sparkSession.sparkContext.broadcast((model, classifier))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, classifier = sent.value
        restorer = Restorer(model)
        plain: set[str] = set()  # tokens without a sign, and the signs of others
        marked: dict[str, list[int]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                found: set[int] = set()
                tokens = set(restorer.tokens(text))
                if len(plain) + len(marked) > REMEMBERED:
                    plain, marked = set(), {}
                fresh = tokens - plain - marked.keys()
                for token in tokens & marked.keys():
                    found.update(marked[token])
                for token in fresh:
                    at = [s for w in restorer.token(token) for s in classifier.signs(w)]
                    found.update(at)
                    if len(token) <= SHORT:
                        if at:
                            marked[token] = at
                        else:
                            plain.add(token)
                total = classifier.base + float(classifier.weights[sorted(found)].sum())
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, total)))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["id", "held_out", "score"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, score double"
    scored = docs.select("id", (fold(F.col("id"), folds) == held).alias("held_out"), "text").mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7, bounds: Bounds = BOUNDS) -> DataFrame:
    """Per document: id, held_out, score, predicted. Labels of the held-out fold are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("id"), folds) != held))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    model = letter_model(letter_counts(rows.select("text")))
    return predict(rows, model, fit(rows, known, model, bounds), folds, held, threshold).withColumnRenamed("id", id_col)
