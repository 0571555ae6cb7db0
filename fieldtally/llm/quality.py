"""Quality rules by repetition: rolling hashes of word n-grams in numpy tell which characters lie in repeated passages.

Each text is judged alone, so the work is one map over the rows without a shuffle; memory is bounded by a piece of about a
megabyte, or by one text where that is longer.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 50 words); blank lines never count
as duplicates; repeated rows are judged one by one, alike; an empty table gives an empty result. Only the id and the text
are read for the measures, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.text import Piece, mixed, pieces, rolling, span_hashes, spans, words

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules. ``coverage``: for a length n, the largest share of a text's word characters in n-grams that the
    text has twice or more (first included). These words also lie in repeated 3-grams, so limits near the base rule's 50 % never fire."""

    min_words: int = 50
    max_repeat_percent: int = 50
    coverage: tuple[tuple[int, float], ...] = ((5, 0.30), (7, 0.27), (10, 0.25))
    max_dup_line_share: float = 0.50
    max_dup_line_chars: float = 0.40


RULES = RepetitionRules()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a window of n words which their own text has twice or more, the first one included."""
    marks = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < n:
        return marks
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    keys = mixed(rolling(hashes, n)[at] + mixed(row[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    hits = at[np.union1d(order[same], order[same + 1])]
    edges = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + n, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_lines(piece: Piece, word_starts: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row: lines with a word, those equal to an earlier one, and the word characters of the latter."""
    starts, ends = spans(piece.data != 10, piece.bounds)
    with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    row = np.searchsorted(piece.bounds, starts, side="right") - 1
    keys = mixed(span_hashes(piece.data, starts, ends) + mixed(row.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    total = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=total[1:])
    of = total[ends] - total[starts]
    n = len(piece)
    return (
        np.bincount(row, minlength=n),
        np.bincount(row[again], minlength=n),
        np.bincount(row[again], weights=of[again], minlength=n).astype(np.int64),
    )


def measured(piece: Piece, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts, shares and verdicts of the rows of a piece."""
    found, n = words(piece), len(piece)
    inside = np.zeros(len(piece.data) + 1, dtype=np.int8)
    np.add.at(inside, found.starts, 1)
    np.add.at(inside, found.ends, -1)
    chars = (np.cumsum(inside[:-1]) > 0) & ((piece.data & 0xC0) != 0x80)  # a code point counts at its first byte
    total = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(chars, out=total[1:])
    lengths, row = total[found.ends] - total[found.starts], found.row
    n_words, word_chars = np.diff(found.rows), piece.sums(chars)
    lines, dup_lines, dup_chars = repeated_lines(piece, found.starts, chars)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": piece.sums(SYMBOLS[piece.data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(row[covered(found.hashes, row, 3)], minlength=n),
    }
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    kept = ~out["base_failed"]
    for length, most in rules.coverage:
        marks = covered(found.hashes, row, length)
        share = np.bincount(row[marks], weights=lengths[marks], minlength=n) / np.maximum(word_chars, 1)
        out[f"dup_{length}gram_share"] = share
        kept &= share <= most
    out["dup_line_char_share"] = dup_chars / np.maximum(word_chars, 1)
    kept &= (dup_lines <= rules.max_dup_line_share * lines) & (out["dup_line_char_share"] <= rules.max_dup_line_chars)
    out["kept"] = kept
    return out


def judged(texts: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts, shares and verdicts of a column of texts."""
    parts = [measured(piece, rules) for piece in pieces(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RULES) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept`` and the measured shares."""
    shares = [f"dup_{n}gram_share" for n, _ in rules.coverage] + ["dup_line_char_share"]
    kinds = [*((c, "bigint") for c in COUNTS), ("base_failed", "boolean"), ("kept", "boolean"), *((c, "double") for c in shares)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = judged(batch.column(1), rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(found[c], arrow[k]) for c, k in kinds)], names=["id", *(c for c, _ in kinds)]
                )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {k}" for c, k in kinds)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_repetitive(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RULES) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judged(batch.column(at), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
