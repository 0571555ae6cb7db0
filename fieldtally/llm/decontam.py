"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. Every k words give a hash; of every ``window``
consecutive hashes the smallest is a fingerprint. Texts that share k + window - 1 words in a row share a window of hashes and
so its smallest: with k = 6 and window = 8, no shared span of 13 words is missed. Documents that share a fingerprint with an
item are read again; each of their k-grams found in the item aligns the two, and the alignment is extended to all words that
agree; runs of 13 or more are hits. An item of fewer than 13 words is one window, sought by the hash of all its words.

Only candidates are shuffled with their text. The items' fingerprints are broadcast while they are few (counted first) and
shuffled beyond. Defined cases: a null or blank text has no words and is clean; an item without words never occurs; repeated
rows of documents get a result each, repeated items count once; a null item id reads as an empty text; empty tables give
clean documents or no rows. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally.llm.tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: words of a hash, hashes of a window, words of a contaminated window
K, WINDOW, SPAN = 6, 8, 13
#: rows of the largest table that is broadcast
BROADCAST_ROWS = 500_000


def small(frame: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows; otherwise as it is."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def word_list(text: Column) -> Column:
    """The words of a text in order."""
    # lower() would also change other letters; it may be used where every character is ASCII
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BREAK), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK_ANY_CASE), "")).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def shifted(values: Column, by: int, fold: Callable[[Column, Column], Column]) -> Column:
    """fold of each element and the one ``by`` further on; the last ``by`` elements have none and go."""
    return let(values, lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))), F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0))), fold))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hash of every n consecutive elements, by doubling."""
    if n == 1:
        return hashes
    half = n // 2
    if n % 2 == 0:
        return shifted(gram_hashes(hashes, half), half, lambda a, b: F.xxhash64(a, b))
    return let(
        hashes,
        lambda h: F.zip_with(
            F.slice(gram_hashes(h, n - 1), F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(0))),
            F.slice(h, F.lit(n), F.greatest(F.size(h) - n + 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        ),
    )


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprints(grams: Column) -> Column:
    """The smallest of every eight consecutive hashes, each value once; of fewer than eight, the smallest of all."""
    least = lambda a, b: F.least(a, b)
    minima = lambda g: F.array_distinct(shifted(shifted(shifted(g, 1, least), 2, least), 4, least))
    few = lambda g: F.filter(F.array(F.array_min(g)), lambda x: x.isNotNull())
    return let(grams, lambda g: F.when(F.size(g) < WINDOW, few(g)).otherwise(minima(g)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k (a row's key: equal for equal rows only) and _text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_k"), text.alias("_text"))


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_id, _k, item, from, to: each window of an item that occurs in a document, at words from to (exclusive)."""
    bench = stored(
        items.select("item", word_list(F.col("_text")).alias("iw")).where("size(iw) > 0").distinct().withColumn("part", F.xxhash64("item", "iw")), "decon-items"
    )
    long_items = bench.where(F.size("iw") >= SPAN)
    marks = small(stored(long_items.select(F.explode(fingerprints(gram_hashes(word_hashes(F.col("iw")), K))).alias("fp")).distinct(), "decon-marks"))
    hashed = docs.select("_id", "_k", word_hashes(word_list(F.col("_text"))).alias("wh"))
    found = hashed.select("_id", "_k", F.explode(fingerprints(gram_hashes(F.col("wh"), K))).alias("fp")).join(marks, "fp").select("_id", "_k")
    lengths = [r[0] for r in bench.where(F.size("iw") < SPAN).select(F.size("iw")).distinct().collect()]  # twelve at most
    short = {n: bench.where(F.size("iw") == n).select(gram_hashes(word_hashes(F.col("iw")), n)[0].alias("fp"), "part") for n in sorted(lengths)}
    for n, whole in short.items():
        found = found.union(hashed.select("_id", "_k", F.explode(gram_hashes(F.col("wh"), n)).alias("fp")).join(small(whole.select("fp").distinct()), "fp").select("_id", "_k"))
    candidates = stored(found.distinct(), "decon-candidates")
    again = stored(docs.join(small(candidates), ["_id", "_k"], "left_semi").dropDuplicates(["_id", "_k"]).select("_id", "_k", word_list(F.col("_text")).alias("dw")), "decon-words")
    wh = word_hashes(F.col("dw"))
    anchors = long_items.select("part", F.posexplode(gram_hashes(word_hashes(F.col("iw")), K)).alias("q", "fp"))
    hits = again.select("_id", "_k", F.posexplode(gram_hashes(wh, K)).alias("p", "fp")).join(small(anchors), "fp").select("_id", "_k", "part", (F.col("p") - F.col("q")).alias("shift"))
    for n, whole in short.items():
        hits = hits.union(again.select("_id", "_k", F.posexplode(gram_hashes(wh, n)).alias("p", "fp")).join(small(whole), "fp").select("_id", "_k", "part", F.col("p").alias("shift")))
    sizes = bench.select("part", F.size("iw").alias("m"))
    # each alignment with the words of the document beside the item's; documents are read once for all their alignments
    cuts = (
        hits.distinct()
        .join(small(sizes), "part")
        .groupBy("_id", "_k")
        .agg(F.collect_list(F.struct("part", "shift", "m")).alias("cuts"))
        .join(again, ["_id", "_k"])
        .withColumn("cut", F.explode("cuts"))
        .select("_id", "_k", "cut.part", "cut.shift", F.greatest(F.col("cut.shift"), F.lit(0)).alias("low"), "cut.m", "dw")
        .select("_id", "_k", "part", "low", (F.col("low") - F.col("shift")).alias("skip"), F.slice("dw", F.col("low") + 1, F.col("shift") + F.col("m") - F.col("low")).alias("cut"))
    )
    beside = cuts.join(small(bench.select("part", "item", "iw")), "part")
    equal = F.zip_with(F.col("cut"), F.slice("iw", F.col("skip") + 1, F.greatest(F.size("cut"), F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    need = F.least(F.size("iw"), F.lit(SPAN))
    beside = beside.select("_id", "_k", "item", "low", need.alias("need"), equal.alias("same"))
    room = F.size("same") - F.col("need")
    starts = F.filter(
        F.when(room >= 0, F.sequence(F.lit(0), room)).otherwise(F.array().cast("array<int>")), lambda i: F.forall(F.slice(F.col("same"), i + 1, F.col("need")), lambda x: x)
    )
    return beside.withColumn("at", F.explode(starts)).select("_id", "_k", "item", (F.col("low") + F.col("at")).alias("from"), (F.col("low") + F.col("at") + F.col("need")).alias("to"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """By _id and _k of the documents that hold a window: n_hit (words inside windows), n_items, ids (of these items)."""
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("_text"))
    found = stored(occurrences(keyed(docs, id_col, text_col), named).distinct(), "decon-found")
    before = Window.partitionBy("_id", "_k").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("to") - F.greatest(F.col("from"), F.coalesce(F.max("to").over(before), F.lit(0))))
    hit = found.select("_id", "_k", "from", "to").distinct().withColumn("n", fresh).groupBy("_id", "_k").agg(F.sum("n").alias("n_hit"))
    which = found.select("_id", "_k", "item").distinct().groupBy("_id", "_k").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    return hit.join(which, ["_id", "_k"])


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **items_cols: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit)."""
    found = stored(contamination(docs, items, id_col, text_col, **items_cols), "decon-report")
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_k"), n_words(text).alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return slim.join(small(found), ["_id", "_k"], "left").select(
        F.col(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **items_cols: str) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    found = stored(contamination(docs, items, id_col, text_col, **items_cols), "decon-report").select("_id", "_k", "n_hit")
    text = F.col(text_col).cast("string")
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_k"), n_words(text).alias("_n"))
    joined = marked.join(small(found), ["_id", "_k"], "left")
    return joined.where(~F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("_n")), F.lit(False))).select("_doc.*")
