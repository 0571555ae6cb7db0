"""Language-model scoring by a hierarchical Pitman-Yor model.

Tokens are words (A to Z lower-cased) and an end after each text. Each training token is a customer of the restaurant of the word
before it (of the end before a text's first word). Every table there sends one customer to the word restaurant, the parent of
all these contexts. Its base measure spells a word byte by byte: restaurants of the two bytes before, whose parents are the restaurants of the last
byte, whose parent is the restaurant without context, over a uniform base. Every table of the word restaurant sends one customer
per byte down this hierarchy, and every table there one to its parent. Each text is a context with a restaurant of its own,
whose customers are its tokens so far and whose parent is the restaurant of the word before.

Seating is sampled by Gibbs sweeps. In a sweep, each word's customers take seats anew, given the tables of all other words and
the spelling probabilities of the last sweep (customers come in blocks over which the chance of a new table changes by 2 %
at most); then the spelling restaurants are seated from the tables. Words are independent given the last sweep, so Spark seats
them in parallel, and no state but the spelling tables is carried on. Probabilities are averaged over the sweeps after burn-in. The
contexts are seated ``pair_turns`` times, at first by the number of contexts of each word, then by the word probabilities of the
turn before; after each turn the word restaurant is seated anew from their tables. A pair that occurs once has one table, so only
the others are drawn. The last turn's seating of the contexts is kept.

Words that no training text has are one outcome, as they are in the base formula, so that both are probabilities of the same
events: its probability is what the known words leave. A text's own mass for such a word comes on
top of it; the masses of the text's other unknown words are left out, so the probabilities sum to one at most.

Counting covers all training texts. The table of words is distributed and never collected. The spelling table has at
most 257^3 cells whatever the corpus (some ten thousands in practice); it and what was learned of the ``hot_words`` most frequent words
are sent to all tasks, and so are the ``hot_pairs`` most frequent pairs. Words, pairs and questions are shuffled as packed lists: a list
holds what one chunk of texts has for one bucket of hashes, and names frequent words by their rank. Pairs that occur once
are never rows of a table. To be scored, a chunk of texts asks the buckets for its other pairs and words; a pair that training texts do not
have goes back to its word. The texts are read twice for that, in the same order; if they come in another one, scoring fails.

All draws depend on the seed and on the word or pair alone, so scores don't depend on how rows are dealt out.

Defined cases: a null or empty text is one end token; without training texts every token is the unknown
word, of probability one; repeated rows are scored each; a null id counts as an empty text in the folds; an empty table gives an empty result.
Only id and text are read. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.tables import dropped, stored
from fieldtally.llm.text import LOWER, Piece, Words, mixed, pieces, words

EDGE = 256  # a symbol for the start and the end of a word
SYMBOLS = 257
#: hash that stands for the end token, whose spelling is the empty word
END = 0


@dataclass(frozen=True)
class Settings:
    strength: float = 1.0
    spelling_discount: float = 0.5
    spelling_strength: float = 5.0
    text_discount: float = 0.8
    text_strength: float = 150.0
    pair_strength: float = 5.0
    pair_turns: int = 2
    burn_in: int = 2
    samples: int = 3
    hot_words: int = 1 << 18
    hot_pairs: int = 1 << 18


SETTINGS = Settings()
#: words, different within a piece of text, that a task holds before it passes counts on
COUNT_TOKENS = 4_000_000
#: bytes of text whose pairs a task counts and scores together
CHUNK_BYTES = 1 << 23
#: rows that a task holds before it deals them out to buckets
DEALT_ROWS = 1_000_000
#: stands before a word in an entry that asks for the word itself; no word has this hash but by chance
ALONE = np.uint64(1)


def fold(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes, the first bytes of all numbers first."""
    plain = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], np.int64).tobytes() + (pa.compress(plain, codec="zstd", asbytes=True) if plain else b"")


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    lengths = np.frombuffer(data, np.int64, len(kinds))
    sizes = [int(n) * np.dtype(k).itemsize for n, k in zip(lengths, kinds, strict=True)]
    plain = pa.decompress(data[8 * len(kinds) :], sum(sizes), codec="zstd") if sum(sizes) else b""
    whole, at, found = np.frombuffer(plain, np.uint8), 0, []
    for n, size, kind in zip(lengths, sizes, kinds, strict=True):
        found.append(np.ascontiguousarray(whole[at : at + size].reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return found


def bucket_number(spark: SparkSession, tokens: int = 0) -> int:
    """Several buckets for each task of a shuffle, and of a bounded size."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // 3_000_000)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of data as an Arrow column of bytes."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1] - starts, lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and which of them each key is."""
    order = np.argsort(keys)
    there = keys[order]
    new = np.concatenate([[True], there[1:] != there[:-1]])[: len(there)]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return there[new], order[new], of


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, n: how often each word of any text occurs in training texts. ``docs``: text, train. Words are shuffled as packed
    lists, by buckets of their hashes."""
    buckets = bucket_number(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        spelled: list[pa.Array] = []
        held, ends, rows = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ends, rows
            h, n = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
            keys, first, of = grouped(h)
            total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)
            spelling = pa.concat_arrays([*spelled, pa.array([], pa.binary())]).take(pa.array(first))
            bounds = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            full = [k for k in range(buckets) if k == 0 or bounds[k] < bounds[k + 1]]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spelling), b" ")
            lists = [packed(np.frombuffer(joined[k].as_buffer(), np.uint8)) for k in full]
            numbers = [packed(total[bounds[k] : bounds[k + 1]]) for k in full]
            end = [ends if k == 0 else 0 for k in full]
            for kept in (hashes, counts, spelled):
                kept.clear()
            held, ends, rows = 0, 0, 0
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(lists, pa.binary()), pa.array(numbers, pa.binary()), pa.array(end, pa.int64())], names=["bucket", "words", "n", "ends"])

        for batch in batches:
            train = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for piece in pieces(batch.column(0)):
                found = words(piece, lower=True)
                used = train[piece.rows]
                keys, first, of = grouped(found.hashes)
                hashes.append(keys)
                counts.append(np.bincount(of, weights=used[found.row], minlength=len(keys)).astype(np.int64))
                spelled.append(gathered(LOWER[piece.data], found.starts[first], found.ends[first]))
                held += len(keys)
                ends += int(used.sum())
                rows += len(piece)
                if held >= COUNT_TOKENS:
                    yield flush()
        if rows:
            yield flush()

    def merged(rows: pa.Table) -> pa.Table:
        data = np.concatenate([np.append(unpacked(x.as_py(), np.uint8)[0], np.uint8(32)) for x in rows["words"]])
        n = np.concatenate([unpacked(x.as_py(), np.int64)[0] for x in rows["n"]])
        found = words(Piece(slice(0, 1), data, np.array([0, len(data)])))
        keys, first, of = grouped(found.hashes)
        total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.int64)
        spelling = gathered(data, found.starts[first], found.ends[first])
        if rows["bucket"][0].as_py() == 0:
            keys, total = np.append(keys, np.uint64(END)), np.append(total, sum(rows["ends"].to_pylist()))
            spelling = pa.concat_arrays([spelling, pa.array([b""], pa.binary())])
        return pa.table({"h": keys.view(np.int64), "word": spelling, "n": total})

    return docs.mapInArrow(run, "bucket int, words binary, n binary, ends bigint").groupBy("bucket").applyInArrow(merged, "h bigint, word binary, n bigint")


def in_order(found: Words, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and hash of the token before, of all tokens of a piece with the end of each text; before a text stands an end."""
    row = np.concatenate([found.row, np.arange(n_rows)])
    order = np.argsort(row, kind="stable")  # the end comes last
    hashes = np.concatenate([found.hashes, np.full(n_rows, END, np.uint64)])[order]
    return row[order], hashes, np.roll(hashes, 1)


def pair_keys(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes + mixed(before))


class Hot:
    """The most frequent words: their hashes by rank, and the ranks by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.rank = np.argsort(hashes).astype(np.int32)
        self.sorted = hashes[self.rank]

    def coded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank or -1, and the hash of words without a rank (0 for others)."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int32), hashes
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        known = self.sorted[at] == hashes
        return np.where(known, self.rank[at], -1).astype(np.int32), np.where(known, np.uint64(0), hashes)

    def plain(self, ranks: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.where(ranks >= 0, self.hashes[ranks], rest) if len(self.hashes) else rest


@dataclass
class Entries:
    """Pairs in the order in which a chunk deals them out: by bucket, then by the ranks of their words."""

    keys: np.ndarray
    u: tuple[np.ndarray, np.ndarray]
    w: tuple[np.ndarray, np.ndarray]
    order: np.ndarray  # of what was given
    bounds: np.ndarray  # of buckets

    @staticmethod
    def of(before: np.ndarray, hashes: np.ndarray, keys: np.ndarray, hot: Hot, buckets: int) -> Entries:
        return Entries.coded(hot.coded(before), hot.coded(hashes), keys, len(hot.hashes), buckets)

    @staticmethod
    def coded(u: tuple[np.ndarray, np.ndarray], w: tuple[np.ndarray, np.ndarray], keys: np.ndarray, ranks: int, buckets: int) -> Entries:
        bucket, ranks = bucket_of(keys, buckets), np.uint64(ranks + 1)
        order = np.argsort((bucket * ranks + (u[0] + 1).astype(np.uint64)) * ranks + (w[0] + 1).astype(np.uint64), kind="stable")
        return Entries(keys[order], (u[0][order], u[1][order]), (w[0][order], w[1][order]), order, np.searchsorted(bucket[order], np.arange(buckets + 1)))

    def dealt(self, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Bucket and packed entries with further values, given in this order."""
        for k in np.flatnonzero(np.diff(self.bounds)):
            here = slice(self.bounds[k], self.bounds[k + 1])
            cold = [x[1][here][x[0][here] < 0] for x in (self.u, self.w)]
            yield int(k), packed(self.u[0][here], self.w[0][here], *cold, *(x[here] for x in more))


def undealt(data: bytes, hot: Hot, *kinds: type) -> list[np.ndarray]:
    """Hashes of both words of packed entries, and the further values."""
    u, w, u_cold, w_cold, *more = unpacked(data, np.int32, np.int32, np.uint64, np.uint64, *kinds)
    found = []
    for ranks, cold in ((u, u_cold), (w, w_cold)):
        rest = np.zeros(len(ranks), np.uint64)
        rest[ranks < 0] = cold
        found.append(hot.plain(ranks, rest))
    return [*found, *more]


@dataclass
class Tokens:
    """The tokens of some texts: their rows, the different words (hashes, ranks and, of words without one, hashes), the word of each
    token, the different pairs as places of their words, their keys, and the pair of each token."""

    row: np.ndarray
    words: np.ndarray
    coded: tuple[np.ndarray, np.ndarray]
    word: np.ndarray
    u: np.ndarray
    w: np.ndarray
    keys: np.ndarray
    pair: np.ndarray

    @staticmethod
    def of(texts: pa.ChunkedArray, hot: Hot) -> Tokens:
        found = [(piece.rows.start, in_order(words(piece, lower=True), len(piece))) for piece in pieces(texts)]
        row = np.concatenate([row + start for start, (row, _, _) in found])
        known, _, word = grouped(np.concatenate([hashes for _, (_, hashes, _) in found]))
        pairs, _, pair = grouped(np.roll(word, 1) * len(known) + word)  # a text's last token is an end, as is what stands before it
        u, w = pairs // len(known), pairs % len(known)
        return Tokens(row, known, hot.coded(known), word, u, w, pair_keys(known[u], known[w]), pair)

    def entries(self, some: np.ndarray, alone: np.ndarray, ranks: int, buckets: int) -> Entries:
        """Some of the pairs, and after them words that stand alone."""
        (rank, rest), w = self.coded, np.concatenate([self.w[some], alone])
        u_rank = np.concatenate([rank[self.u[some]], np.full(len(alone), -1, np.int32)])
        u_rest = np.concatenate([rest[self.u[some]], np.full(len(alone), ALONE)])
        keys = np.concatenate([self.keys[some], pair_keys(np.full(len(alone), ALONE), self.words[alone])])
        return Entries.coded((u_rank, u_rest), (rank[w], rest[w]), keys, ranks, buckets)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows in order, by chunks of about CHUNK_BYTES of text, and the chunk's first row number. Columns: row, text and others."""
    held, size = [], 0
    for batch in batches:
        lengths = np.diff(np.frombuffer((text := batch.column("text").cast(pa.large_string())).buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            upto = at + min(int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK_BYTES - size)) + 1, batch.num_rows - at)
            held.append(batch.slice(at, upto - at))
            size += int(lengths[at:upto].sum())
            at = upto
            if size >= CHUNK_BYTES:
                yield held[0].column("row")[0].as_py(), pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield held[0].column("row")[0].as_py(), pa.Table.from_batches(held)


PAIR = "us int, uc bigint, ws int, wc bigint, n bigint"


def coded_pairs(u: np.ndarray, w: np.ndarray, hot: Hot) -> list[pa.Array]:
    """Rank (or -1) and hash (null if there is a rank) of the words of pairs."""
    return [x for h in (u, w) for ranks, rest in [hot.coded(h)] for x in (pa.array(ranks), pa.array(rest.view(np.int64), mask=ranks >= 0))]


def pair_counts(texts: DataFrame, hot: Hot = Hot(np.zeros(0, np.uint64)), tokens: int = 0) -> DataFrame:
    """us, uc, ws, wc, n: how often the word w follows the word u in the training texts; a word is its rank among ``hot`` or else its
    hash. ``texts``: text. Pairs are shuffled as packed lists, by buckets of their keys."""
    buckets = bucket_number(texts.sparkSession, tokens)
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, chunk in chunks(batches):
            tokens = Tokens.of(chunk["text"], sent.value)
            some = tokens.entries(np.arange(len(tokens.keys)), np.zeros(0, np.int64), len(sent.value.hashes), buckets)
            dealt = list(some.dealt(np.bincount(tokens.pair)[some.order]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names=["bucket", "data"])

    def merged(rows: pa.Table) -> pa.Table:
        u, w, n = (np.concatenate(x) for x in zip(*(undealt(x.as_py(), sent.value, np.int64) for x in rows["data"]), strict=True))
        _, first, of = grouped(pair_keys(u, w))
        return pa.Table.from_arrays([*coded_pairs(u[first], w[first], sent.value), pa.array(np.bincount(of, weights=n).astype(np.int64))], names=["us", "uc", "ws", "wc", "n"])

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "bucket int, data binary").groupBy("bucket").applyInArrow(merged, PAIR)


def seated_pairs(rows: DataFrame, hot: Hot, known: tuple[np.ndarray, np.ndarray], discount: float, settings: Settings, seed: int) -> DataFrame:
    """The pairs with t, their tables. ``rows``: pairs and, for words without a rank, p (the probability of w) and tables (of the context
    u, last turn); ``known``: both by rank."""
    sent = rows.sparkSession.sparkContext.broadcast((hot, *known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, *known = sent.value
        for batch in batches:
            if batch.num_rows:
                us, ws, n = (batch.column(c).to_numpy() for c in ("us", "ws", "n"))
                p, tables = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("p", "tables"))
                for values, ranks, of in ((p, ws, known[0]), (tables, us, known[1])):
                    values[ranks >= 0] = of[ranks[ranks >= 0]]
                u, w = (hot.plain(ranks, batch.column(c).fill_null(0).to_numpy().view(np.uint64)) for ranks, c in ((us, "uc"), (ws, "wc")))
                t = tables_of(n, (settings.pair_strength + discount * tables) * p, discount, Draws(pair_keys(u, w), seed))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("us", "uc", "ws", "wc", "n")), pa.array(t)], names=["us", "uc", "ws", "wc", "n", "t"])

    return rows.mapInArrow(run, PAIR + ", t bigint")


def ranked(types: DataFrame, hot: Hot) -> DataFrame:
    """The words with s, their rank or -1, and c, the hash of words without a rank (null for others)."""
    sent = types.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, rest = sent.value.coded(batch.column("h").to_numpy().view(np.uint64))
            columns = [*batch.columns, pa.array(ranks), pa.array(rest.view(np.int64), mask=ranks >= 0)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "s", "c"])

    return types.mapInArrow(run, "h bigint, word binary, n bigint, s int, c bigint")


def hot_words(types: DataFrame, settings: Settings) -> Hot:
    found = types.orderBy(F.desc("n"), "h").limit(settings.hot_words).select("h").toArrow()  # bounded by the settings
    return Hot(found["h"].to_numpy().view(np.uint64))


def by_rank(words: DataFrame, size: int, *names: str) -> list[np.ndarray]:
    """Columns of the words that have a rank."""
    found = words.where("s >= 0").select("s", *names).toArrow()
    out = []
    for name in names:
        values = np.zeros(size, found[name].to_numpy().dtype)
        values[found["s"].to_numpy()] = found[name].to_numpy()
        out.append(values)
    return out


def fewer(pairs: DataFrame, saved: Column) -> tuple[DataFrame, DataFrame]:
    """s, c and the sum of ``saved`` for the words that stand first in pairs (u), and for those that stand second (w)."""
    return tuple(
        pairs.groupBy(F.col(f"{x}s").alias("s"), F.coalesce(f"{x}c", F.lit(0)).alias("_c")).agg(F.sum(saved).alias(x)) for x in ("u", "w")
    )


@dataclass
class Seating:
    """What the contexts and the word restaurant were learned to be. ``words``: h, s, c, n, p, tables (of the word's context);
    ``more``: us, uc, ws, wc, n, t of the pairs that occur more than once."""

    words: DataFrame
    more: DataFrame
    discount: float


def seated_words(types: DataFrame, pairs: DataFrame, hot: Hot, settings: Settings) -> Seating:
    """Seats the contexts and the word restaurant. A pair that occurs once has one table. So a context, whose customers are all
    tokens after the word, has as many tables as the word occurs, less n - t for each pair of n > 1; likewise the word restaurant's customers."""
    seen = Observation()
    more = stored(pairs.observe(seen, F.sum(F.when(F.col("n") == 1, 1)).alias("once"), F.sum(F.when(F.col("n") == 2, 1)).alias("twice"), F.count(F.lit(1)).alias("all")).where("n > 1"), "lm-pairs")
    once, twice, every = (seen.get.get(k) or 0 for k in ("once", "twice", "all"))
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    coded = ranked(types, hot).withColumn("_c", F.coalesce("c", F.lit(0)))

    def counted(pairs: DataFrame, words: DataFrame, saved: Column) -> DataFrame:
        """The words with customers and tables, less what pairs save; ``often``: some pair of the word occurs more than once."""
        first, second = fewer(pairs, saved)
        found = words.join(first, ["s", "_c"], "left").join(second, ["s", "_c"], "left")
        gone = lambda x: F.col("n") - F.coalesce(x, F.lit(0))
        return found.select("h", "word", "n", "s", "c", gone("w").alias("customers"), gone("u").alias("tables"), (F.col("w").isNotNull() | F.col("u").isNotNull()).alias("often"))

    used = stored(counted(more, coded, F.col("n") - 1), "lm-customers")
    words = used.select("s", "c", "often", (F.col("customers") / float(max(every, 1))).alias("p"), "tables")
    seats, scores = None, None
    for turn in range(settings.pair_turns):
        known = by_rank(words, len(hot.hashes), "p", "tables")
        none = [F.lit(None).cast("double").alias(x) for x in ("p", "tables")]
        rest = words.where("s < 0 AND often")
        columns = ["us", "uc", "ws", "wc", "n"]
        cold = more.where("us < 0 OR ws < 0")
        # a word with a rank needs no join; its rows are dealt by the pair's other word
        cold = cold.join(rest.select(F.col("c").alias("_w"), "p"), (F.coalesce("wc", "uc") == F.col("_w")) & (F.col("ws") < 0), "left")
        cold = cold.join(rest.select(F.col("c").alias("_u"), F.col("tables").cast("double").alias("tables")), (F.coalesce("uc", "wc") == F.col("_u")) & (F.col("us") < 0), "left")
        rows = more.where("us >= 0 AND ws >= 0").select(*columns, *none).unionByName(cold.select(*columns, "p", "tables"))
        last, seats = seats, stored(seated_pairs(rows, hot, known, discount, settings, 2000 + turn), "lm-seats")
        before = [x for x in (last, scores) if x is not None]
        keep = used.withColumn("_c", F.coalesce("c", F.lit(0)))
        again = counted(seats, keep.where("often").drop("customers", "tables"), F.col("n") - F.col("t"))
        old, used = used, stored(keep.where("NOT often").drop("_c").unionByName(again), "lm-customers")
        scores = word_scores(used, used.agg(F.sum("customers")).first()[0] or 0, settings)
        dropped(old, *before)
        words = scores.select("h", "s", "c", "n", "often", "tables", F.pow(F.lit(10.0), F.col("score")).alias("p"))
    dropped(used, more)
    return Seating(words.drop("often"), seats, discount)


def pair_scores(types: DataFrame, pairs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """h, n, p, back of all words (probability; what the word's context passes on to the word restaurant), and u, w, c, p, n of all
    pairs (how often w follows u; its probability there; how often w occurs). ``pairs``: without ranks."""
    seating = seated_words(types, pairs, Hot(np.zeros(0, np.uint64)), settings)
    strength = F.lit(settings.pair_strength)
    every = seating.words.select("h", "n", "p", ((strength + seating.discount * F.col("tables")) / (strength + F.col("n"))).alias("back"))
    seats = seating.more.unionByName(pairs.where("n = 1").withColumn("t", F.lit(1).cast("bigint"))).select(F.col("uc").alias("u"), F.col("wc").alias("w"), F.col("n").alias("c"), "t")
    after = seats.join(every.select(F.col("h").alias("u"), "back", F.col("n").alias("total")), "u").withColumn("own", (F.col("c") - seating.discount * F.col("t")) / (strength + F.col("total")))
    return every, after.join(every.select(F.col("h").alias("w"), "p", "n"), "w").select("u", "w", "c", (F.col("own") + F.col("back") * F.col("p")).alias("p"), "n")


class Draws:
    """Random numbers that depend on nothing but the seed and a dish's key: the same however rows are dealt out and ordered."""

    def __init__(self, keys: np.ndarray, seed: int) -> None:
        self.keys = mixed(keys + mixed(np.array([seed], np.uint64)))

    def drawn(self, at: np.ndarray, seated: np.ndarray, block: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each block of customers of the dishes ``at``, those who open a table, each with chance p. Blocks are cut so that few
        do, and each part is drawn by inversion."""
        m = block.astype(np.int64)
        parts = np.minimum(np.ceil(m * p / 20.0).astype(np.int64), m)
        parts = np.maximum(parts, 1)
        if parts.max(initial=1) == 1:
            return self._inverted(self.keys[at], seated, m, p)
        of = np.repeat(np.arange(len(at)), parts)
        first = np.cumsum(parts) - parts
        k = np.arange(len(of)) - first[of]
        sizes = m[of] // parts[of] + (k < m[of] % parts[of])
        return np.add.reduceat(self._inverted(self.keys[at][of], seated[of] + k, sizes, p[of]), first)

    @staticmethod
    def _inverted(keys: np.ndarray, number: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        uniform = (mixed(keys + mixed(number.astype(np.uint64))) >> np.uint64(11)) * 2.0**-53
        chance = np.where(m == 1, 1 - p, np.exp(m * np.log1p(-p)))
        out = np.zeros(len(m), np.int64)
        on = np.flatnonzero(uniform >= chance)
        chance, uniform, m, odds, k = chance[on], uniform[on] - chance[on], m[on], (p / (1 - p))[on], 0
        while len(on):
            k += 1
            out[on] = k
            chance = chance * odds * (m - k + 1) / k
            more = (uniform >= chance) & (k < m)
            on, uniform, chance, m, odds = on[more], uniform[more] - chance[more], chance[more], m[more], odds[more]
        return out


def tables_of(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator | Draws) -> np.ndarray:
    """Tables that each dish ends up with when its customers sit down one after the other. ``pull``: (strength + discount *
    tables of the restaurant) * the parent's probability of the dish, which a new table weighs; i customers at t tables weigh
    i - discount * t."""
    tables = np.minimum(customers, 1).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated, left, own, t = np.ones(len(at)), customers[at].astype(np.float64) - 1, pull[at], np.ones(len(at), dtype=np.int64)
    while len(at):
        block = np.minimum(np.maximum(1, np.floor(0.02 * (seated + own))), left)
        p = own / (own + seated - discount * t)
        new = rng.drawn(at, seated, block, p) if isinstance(rng, Draws) else rng.binomial(block.astype(np.int64), p)
        t = np.minimum(t + new, (seated + block).astype(np.int64))
        seated, left = seated + block, left - block
        tables[at] = t
        on = left > 0
        at, seated, left, own, t = at[on], seated[on], left[on], own[on], t[on]
    return tables


@dataclass
class Spelling:
    """Probabilities of a symbol after two others: ``one`` after the last alone, plus the seen cells' own mass."""

    one: np.ndarray
    cells: np.ndarray
    mass: np.ndarray
    contexts: np.ndarray
    passed: np.ndarray

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """keys: (before last * 257 + last) * 257 + symbol."""
        context = keys // SYMBOLS
        p = self.one[context % SYMBOLS, keys % SYMBOLS]
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            p = np.where(self.contexts[at] == context, self.passed[at], 1.0) * p
            at = np.minimum(np.searchsorted(self.cells, keys), len(self.cells) - 1)
            p = p + np.where(self.cells[at] == keys, self.mass[at], 0.0)
        return np.log10(p)


UNIFORM = Spelling(np.full((SYMBOLS, SYMBOLS), 1.0 / SYMBOLS), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))


def seated_spelling(cells: np.ndarray, customers: np.ndarray, before: Spelling, settings: Settings, seed: int) -> Spelling:
    """One sweep through the spelling restaurants; ``before``: the last sweep's probabilities, which new tables are drawn by."""
    d, s, rng = settings.spelling_discount, settings.spelling_strength, np.random.default_rng(seed)
    context, symbol = cells // SYMBOLS, cells % SYMBOLS
    contexts, of = np.unique(context, return_inverse=True)
    pull = (s + d * np.bincount(of, minlength=len(contexts))[of]) * before.one[context % SYMBOLS, symbol]
    tables = tables_of(customers, pull, d, rng)
    parent = np.bincount((context % SYMBOLS) * SYMBOLS + symbol, weights=tables, minlength=SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
    root = np.full(SYMBOLS, 1.0 / SYMBOLS)
    opened = parent > 0
    flat = tables_of(parent[opened].astype(np.int64), ((s + d * opened.sum(axis=1, keepdims=True)) * root)[opened], d, rng)
    up = np.zeros_like(parent)
    up[opened] = flat
    below = up.sum(axis=0)
    lowest = tables_of(below.astype(np.int64), np.full(SYMBOLS, (s + d * (below > 0).sum()) / SYMBOLS), d, rng)
    zero = (below - d * lowest + (s + d * lowest.sum()) / SYMBOLS) / (s + below.sum())
    share = s + parent.sum(axis=1, keepdims=True)
    one = (parent - d * up + (s + d * up.sum(axis=1, keepdims=True)) * zero) / share
    total = s + np.bincount(of, weights=customers)
    passed = (s + d * np.bincount(of, weights=tables)) / total
    return Spelling(one, cells, (customers - d * tables) / total[of], contexts, passed)


def spelled_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells (two symbols before and the symbol) of all words, edges included, and the word of each cell."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(bounds)
    ends = np.cumsum(lengths + 1)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, EDGE, dtype=np.int64)
    plain = np.ones(len(symbols), dtype=bool)
    plain[ends - 1] = False
    symbols[plain] = data
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    last, second = np.roll(symbols, 1), np.roll(symbols, 2)
    place = np.arange(len(symbols)) - np.repeat(ends - lengths - 1, lengths + 1)
    last[place < 1] = EDGE
    second[place < 2] = EDGE
    return (second * SYMBOLS + last) * SYMBOLS + symbols, owner


@dataclass
class State:
    """What a sweep starts from: tables of the word restaurant and the spelling."""

    tables: float
    spelling: Spelling


@dataclass
class Spelled:
    """The cells of a batch of words: the different ones, which of them each cell is, and its word."""

    keys: np.ndarray
    of: np.ndarray
    owner: np.ndarray
    rows: int

    @staticmethod
    def words(batch: pa.RecordBatch) -> Spelled:
        cells, owner = spelled_cells(batch.column("word"))
        return Spelled(*np.unique(cells, return_inverse=True), owner, batch.num_rows)

    def base(self, spelling: Spelling) -> np.ndarray:
        """Probability of each word's spelling."""
        return 10.0 ** np.bincount(self.owner, weights=spelling.log10(self.keys)[self.of], minlength=self.rows)


def word_tables(batch: pa.RecordBatch, base: np.ndarray, state: State, settings: Settings, discount: float, seed: int) -> np.ndarray:
    """Tables of the words in a batch."""
    draws = Draws(batch.column("h").to_numpy().view(np.uint64), seed)
    return tables_of(batch.column("customers").to_numpy(), (settings.strength + discount * state.tables) * base, discount, draws)


def summed_cells(types: DataFrame, tables: Callable[[pa.RecordBatch, Spelled], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells and customers of the spelling restaurants, and the number of tables. ``tables`` gives those of a batch of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 65_536):
                batch = whole.slice(start, 65_536)
                spelled = Spelled.words(batch)
                t = tables(batch, spelled)
                total = np.bincount(spelled.of, weights=t[spelled.owner]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(spelled.keys, -1)), pa.array(np.append(total, t.sum()))], names=["cell", "n"])

    seats = types.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    cells, n = seats["cell"].to_numpy(), seats["n"].to_numpy()
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    return cells[cells >= 0], n[cells >= 0], int(n[cells < 0].sum())


def sweep(types: DataFrame, alone: tuple[np.ndarray, np.ndarray, int], state: State, settings: Settings, discount: float, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Seats all words; cells and customers of the spelling restaurants, and the number of tables. ``alone``: those of the words
    with one customer, who has one table in every sweep."""
    sent = types.sparkSession.sparkContext.broadcast(state)
    cells, n, tables = summed_cells(
        types.where("customers > 1"),
        lambda batch, spelled: word_tables(batch, spelled.base(sent.value.spelling), sent.value, settings, discount, seed),
    )
    keys, of = np.unique(np.concatenate([cells, alone[0]]), return_inverse=True)
    return keys, np.bincount(of, weights=np.concatenate([n, alone[1]]), minlength=len(keys)).astype(np.int64), tables + alone[2]


def word_scores(types: DataFrame, tokens: int, settings: Settings) -> DataFrame:
    """h, n, score: log10 of each word's probability, averaged over the sampled seatings, and any further columns. ``types``: h, word, n and, unless they are
    n, customers; ``tokens``: all customers."""
    if "customers" not in types.columns:
        types = types.withColumn("customers", F.col("n"))
    written = stored(known_scores(types, tokens, settings), "lm-scores")
    used = written.where("h IS NULL").agg(F.sum("score")).first()[0] or 0.0
    unknown = float(np.log10(max(1.0 - used, 1.0 / (tokens + 2.0))))
    return written.where("h IS NOT NULL").withColumn("score", F.when(F.col("n") > 0, F.col("score")).otherwise(F.lit(unknown)))


def known_scores(types: DataFrame, tokens: int, settings: Settings) -> DataFrame:
    """h, n, score of the words that training texts have (null for others) and further columns, and per batch a row without h: the sum of its
    probabilities."""
    kinds = types.agg(F.sum(F.when(F.col("customers") == 1, 1)).alias("once"), F.sum(F.when(F.col("customers") == 2, 1)).alias("twice"), F.sum(F.when(F.col("customers") > 0, 1)).alias("all")).first()
    once, twice = kinds["once"] or 0, kinds["twice"] or 0
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    state, states = State(float(kinds["all"] or 0), UNIFORM), []
    alone = summed_cells(types.where("customers = 1"), lambda batch, _: np.ones(batch.num_rows, np.int64)) if tokens else None
    for turn in range(settings.burn_in + settings.samples if tokens else 0):
        cells, n, tables = sweep(types, alone, state, settings, discount, turn)
        state = State(float(tables), seated_spelling(cells, n, state.spelling, settings, turn))
        if turn >= settings.burn_in:
            states.append(state)
    sent = types.sparkSession.sparkContext.broadcast(states or [state])
    further = [x for x in types.schema.fields if x.name not in ("h", "word", "n", "customers")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "n", "score", *(x.name for x in further)]
        for whole in batches:
            for start in range(0, whole.num_rows, 65_536):
                batch = whole.slice(start, 65_536)
                seen = batch.column("n").to_numpy() > 0
                customers = batch.column("customers").to_numpy()
                spelled = Spelled.words(batch)
                mean = np.zeros(batch.num_rows)
                for k, one in enumerate(sent.value):
                    base = spelled.base(one.spelling)
                    tables = word_tables(batch, base, one, settings, discount, 1000 + k)
                    mean += (customers - discount * tables + (settings.strength + discount * one.tables) * base) / (settings.strength + tokens)
                mean /= len(sent.value)
                score = pa.array(np.log10(np.maximum(mean, 1e-300)), mask=~seen)
                own = [batch.column(x.name) for x in further]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), score, *own], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([mean[seen].sum()]), *(pa.nulls(1, x.type) for x in own)], names=names)

    return types.mapInArrow(run, "h bigint, n bigint, score double" + "".join(f", {x.name} {x.dataType.simpleString()}" for x in further))


def text_scores(docs: DataFrame, seating: Seating, hot: Hot, everything: int, distinct: int, settings: Settings) -> DataFrame:
    """id, held_out and sums over the tokens of each text. ``docs``: row, id, held_out, text.

    Chunks of texts ask for their pairs and for their words without a rank, by packed lists dealt to buckets; a bucket counts which pairs
    training texts have once, looks up the others, and answers each list in its order. Then texts and answers meet by chunk.
    """
    spark, buckets = docs.sparkSession, bucket_number(docs.sparkSession, everything)
    size = len(hot.hashes)
    by_n = seating.more.orderBy(F.desc("n"), "us", "uc", "ws", "wc").limit(settings.hot_pairs).toArrow()  # bounded by the settings
    plain = [hot.plain(by_n[f"{x}s"].to_numpy(), by_n[f"{x}c"].fill_null(0).to_numpy().view(np.uint64)) for x in ("u", "w")]
    keys = pair_keys(*plain)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((hot, by_rank(seating.words, size, "n", "p", "tables"), [keys[order], by_n["n"].to_numpy()[order], by_n["t"].to_numpy()[order]]))
    d, s = seating.discount, settings.pair_strength

    def place(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    def asked(texts: pa.ChunkedArray) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, Entries]:
        """Tokens; which pairs are known here, and where; the words without a rank; the pairs and words to be asked for."""
        tokens = Tokens.of(texts, sent.value[0])
        at, here = place(sent.value[2][0], tokens.keys)
        cold = np.flatnonzero(tokens.coded[0] < 0)
        return tokens, here, at, cold, tokens.entries(np.flatnonzero(~here), cold, size, buckets)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in chunks(batches):
            held = chunk["held_out"].to_numpy(zero_copy_only=False).astype(bool)
            tokens, here, _, cold, some = asked(chunk["text"])
            train = np.bincount(tokens.pair, weights=~held[tokens.row], minlength=len(tokens.keys)) > 0
            dealt = list(some.dealt(np.concatenate([train[~here], np.zeros(len(cold), bool)])[some.order].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([number] * len(dealt), pa.int64()), pa.array([x for _, x in dealt], pa.binary())], names=["bucket", "chunk", "data"])

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (us, uc, ws, wc, n, t, p), dealt to buckets."""
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            u, w = (sent.value[0].plain(rows[f"{x}s"].to_numpy(), rows[f"{x}c"].fill_null(0).to_numpy().view(np.uint64)) for x in ("u", "w"))
            some = Entries.of(u, w, pair_keys(u, w), sent.value[0], buckets)
            dealt = list(some.dealt(*(rows[c].to_numpy()[some.order] for c in ("n", "t", "p"))))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.nulls(len(dealt), pa.int64()), pa.array([x for _, x in dealt], pa.binary())], names=["bucket", "chunk", "data"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= DEALT_ROWS:
                yield flush()
        if held:
            yield flush()

    def answered(rows: pa.Table) -> pa.Table:
        told = [undealt(x.as_py(), sent.value[0], np.int64, np.int64, np.float64) for x in rows.filter(rows["chunk"].is_null())["data"]]
        known, n, t, p = (np.concatenate(x) for x in zip(*((pair_keys(u, w), *more) for u, w, *more in told), strict=True)) if told else (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.float64))
        order = np.argsort(known)
        known, n, t, p = known[order], n[order], t[order], p[order]
        asks = rows.filter(rows["chunk"].is_valid())
        lists = [(u == ALONE, pair_keys(u, w), train > 0) for u, w, train in (undealt(x.as_py(), sent.value[0], np.uint8) for x in asks["data"])]
        seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys[train] for _, keys, train in lists)]))
        found = []
        for alone, keys, _ in lists:
            at, hit = place(known, keys)
            once = place(seen, keys)[1].astype(np.int64)
            some = [np.where(hit, x[at], once) if len(x) else once for x in (n, t)]
            found.append(packed(keys.sum(keepdims=True), *some, p[at[alone]] if len(p) else np.zeros(0)))
        return pa.table({"chunk": asks["chunk"].cast(pa.int64()), "bucket": asks["bucket"].cast(pa.int32()), "data": pa.array(found, pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(chunk.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bucket", "data"])

    def scored(rows: pa.Table) -> pa.Table:
        chunk = pa.ipc.open_stream(rows.filter(rows["bucket"].is_null())["data"][0].as_py()).read_all()
        tokens, here, at, cold, some = asked(chunk["text"])
        n, t, p = np.zeros(len(some.keys), np.int64), np.zeros(len(some.keys), np.int64), np.zeros(len(some.keys))
        answers = rows.filter(rows["bucket"].is_valid())
        asks = np.flatnonzero(np.diff(some.bounds))
        if sorted(answers["bucket"].to_pylist()) != asks.tolist():
            raise ValueError("the texts of a chunk were not read twice in the same order")
        to, pairs = some.order, len(some.keys) - len(cold)
        for k, data in zip(answers["bucket"].to_pylist(), answers["data"], strict=True):
            part = slice(some.bounds[k], some.bounds[k + 1])
            check, some_n, some_t, some_p = unpacked(data.as_py(), np.uint64, np.int64, np.int64, np.float64)
            if check[0] != some.keys[part].sum():
                raise ValueError("the texts of a chunk were not read twice in the same order")
            n[to[part]], t[to[part]] = some_n, some_t
            p[to[part][to[part] >= pairs]] = some_p
        _, ranked_words, (_, pair_n, pair_t) = sent.value
        c, seats = np.empty(len(here), np.int64), np.empty(len(here), np.int64)
        for all_of, asked_for, known in ((c, n, pair_n), (seats, t, pair_t)):
            all_of[~here], all_of[here] = asked_for[:pairs], known[at[here]]
        ranks = tokens.coded[0]
        word_n, word_p, word_tables = (np.empty(len(ranks), x.dtype) for x in (n, p, t))
        for values, asked_for, known in zip((word_n, word_p, word_tables), (n, p, t), ranked_words, strict=True):
            values[ranks >= 0], values[cold] = known[ranks[ranks >= 0]], asked_for[pairs:]
        total = s + word_n
        after = np.where(c > 0, c - d * seats, 0.0) / total[tokens.u] + ((s + d * word_tables) / total)[tokens.u] * word_p[tokens.w]
        row = tokens.row
        own, free = text_restaurants(row, tokens.word.astype(np.uint64), len(chunk), settings)
        base = np.log10((word_n + 1) / (everything + distinct + 1.0))
        sums = [np.bincount(row, weights=x, minlength=len(chunk)) for x in ((word_n > 0)[tokens.word], base[tokens.word], np.log10(own + free * after[tokens.pair]))]
        columns = [chunk["id"], chunk["held_out"], pa.array(np.bincount(row, minlength=len(chunk))), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    columns = ["us", "uc", "ws", "wc", "n", "t", "p"]
    marked = seating.words.where("s < 0").select(F.lit(-1).alias("us"), F.lit(int(ALONE)).cast("bigint").alias("uc"), F.col("s").alias("ws"), F.col("c").alias("wc"), "n", F.col("tables").alias("t"), "p")
    known = seating.more.withColumn("p", F.lit(0.0)).select(*columns).unionByName(marked)
    shape = "bucket int, chunk bigint, data binary"
    asks = docs.select("row", "held_out", "text").mapInArrow(asking, shape).unionByName(known.mapInArrow(telling, shape))
    answers = asks.groupBy("bucket").applyInArrow(answered, "chunk bigint, bucket int, data binary")
    whole = docs.mapInArrow(texts, "chunk bigint, bucket int, data binary").unionByName(answers)
    kind = docs.schema["id"].dataType.simpleString()
    return whole.groupBy("chunk").applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def text_restaurants(row: np.ndarray, hashes: np.ndarray, n_rows: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each token, in order: the mass of its word in its text's restaurant, and the mass that goes to the parent. The
    customers are the earlier tokens of the text; each word has one table."""
    keys = mixed(hashes + mixed(row.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    earlier = np.empty(len(keys), dtype=np.int64)
    earlier[order] = np.arange(len(keys)) - begin
    first = np.searchsorted(row, np.arange(n_rows))[row]
    seated = np.arange(len(row)) - first
    tables = np.concatenate([[0], np.cumsum(earlier == 0)])
    tables = tables[:-1] - tables[first]
    d, s = settings.text_discount, settings.text_strength
    return np.maximum(earlier - d, 0) * (earlier > 0) / (s + seated), (s + d * tables) / (s + seated)


def score_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, settings: Settings = SETTINGS) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (fold(F.col(id_col), folds) == held).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    types = stored(word_counts(rows.select("text", (~F.col("held_out")).alias("train"))), "lm-types")
    total = types.agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("n") > 0, 1)).alias("distinct")).first()
    tokens, distinct = total["tokens"] or 0, total["distinct"] or 0
    hot = hot_words(types, settings)
    seating = seated_words(types, pair_counts(rows.where("NOT held_out").select("text"), hot, tokens), hot, settings)
    dropped(types)
    found = text_scores(rows, seating, hot, tokens, distinct, settings)
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
