"""Mixing sources to target weights with a low-discrepancy schedule.

The words of each source, its documents shuffled by a hash, are a stream that is cut into blocks of equal size. A schedule of
slots says which source comes next: slot k gets the golden-ratio point k * phi mod 1, rounded to a multiple of 1 / slots so
that each multiple is met once (k * a mod slots with a the nearest number to slots / phi that shares no factor with it). The
points fall through the cumulative shares of the sources, so every stretch of the schedule holds the sources nearly in their
shares, and the whole schedule holds exactly as many slots of a source as it needs. The r-th slot of a source takes the
r-th block of its stream, again from the start once the stream is used up; the last slot is cut at the target.

Targets: the sources in order of their names by code point (null last) weigh 1, 2, 3, repeating, and share the words of
all documents; a target stops at ``cap`` times its source's words, and the excess goes to the others by weight.

Defined cases: a null or blank text has size 0 and is never taken; repeated rows are separate entries of the stream; a source
without words has target 0; an empty table gives an empty result; only id, text and source are read. Equal ids are
ordered by the text's hash; fully equal rows are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import running_sums, stored

BREAK = r"[\x20\x09-\x0D]+"
#: parameters: words in a block, copies of a document at most, slots and documents that one task numbers
BLOCK_WORDS, CAP, SLOTS_A_CHUNK, DOCS_A_BUCKET = 2048, 3, 1 << 16, 4_000


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAK), "")).cast("bigint")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, at (its place in the order of names), target. ``sizes`` has source and size; the result has one row per source.

    The common level (target = level * weight unless capped) is found by rounds; each only brings three sums to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("at", T.LongType())])
    numbered = sizes.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), schema)
    numbered = stored(numbered, "mix-sources").withColumn("weight", F.col("at") % 3 + 1)
    level = 0.0
    while True:
        free = F.col("weight") * F.lit(level) <= F.col("source_size") * cap
        row = numbered.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(free, F.col("weight"))).alias("weights"),
            F.sum(F.when(~free, F.col("source_size") * cap)).alias("capped"),
        ).first()
        if not row["weights"]:
            break
        higher = float((row["total"] or 0) - (row["capped"] or 0)) / float(row["weights"])
        if higher <= level:
            break
        level = higher
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double"))
    return numbered.select("source", "source_size", "at", target.alias("target"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, chunk: int = SLOTS_A_CHUNK) -> DataFrame:
    """slot, source, rank: which source each slot takes its next block from. ``sources`` as made by source_targets.

    Slots are numbered within their source by counting chunks of the schedule first, so no task sees a whole source.
    """
    spark = sources.sparkSession
    needed = with_blocks(sources, block_words).withColumn("slots", F.ceil(F.round("target") * F.col("blocks") / F.col("source_size")))
    needed = needed.where("slots > 0").select("source", "at", F.col("slots").cast("bigint").alias("slots"), F.lit(1).alias("all"))
    numbered = running_sums(needed, ["all"], ["at"], F.floor(F.col("at") / DOCS_A_BUCKET), F.col("slots"), "first")
    shares = stored(numbered.select("source", "slots", "first"), "mix-shares")
    total = shares.agg(F.sum("slots")).first()[0] or 0
    step = max(1, round(total * (math.sqrt(5) - 1) / 2))
    while math.gcd(step, max(total, 1)) != 1:
        step += 1
    wide = lambda c: c.cast("decimal(19,0)")
    point = (wide(F.col("id")) * wide(F.lit(step)) % wide(F.lit(max(total, 1)))).cast("bigint")
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"))
    # A band of points belongs to one source or is cut between a few: a join on bands, not on ranges.
    band = max(1, total // 4096)
    bands = shares.withColumn("band", F.explode(F.sequence(F.floor(F.col("first") / band), F.floor((F.col("first") + F.col("slots") - 1) / band))))
    drawn = slots.withColumn("band", F.floor(F.col("point") / band)).join(bands, "band").where("point >= first AND point < first + slots")
    return running_sums(drawn.select("slot", "source"), ["source"], ["slot"], F.floor(F.col("slot") / chunk), F.lit(1), "rank")


def with_blocks(frame: DataFrame, block_words: int) -> DataFrame:
    """Adds the number of blocks of the row's source."""
    return frame.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("bigint"))


def cut_at(number: Column) -> Column:
    """First word of a block; the blocks of a source differ by a word at most."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.floor(wide(number) * wide(F.col("source_size")) / wide(F.col("blocks"))).cast("bigint")


def document_streams(sizes: DataFrame, docs_a_bucket: int = DOCS_A_BUCKET) -> DataFrame:
    """Adds ``start``: where the document begins in its source's shuffled stream. ``sizes``: id, source, size, shuffle."""
    buckets = max(1, sizes.count() // docs_a_bucket)
    bucket = F.floor(F.conv(F.substring("shuffle", 1, 7), 16, 10).cast("bigint") * F.lit(buckets) / F.lit(16**7)).cast("int")
    return running_sums(sizes, ["source"], ["shuffle", "id", "size"], bucket, F.col("size"), "start")


def mixed_pieces(sizes: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: one row per slot and document with words in its block: slot, block, id, row, source, words first to
    last (exclusive) of the document. Sorted by slot and ``first`` it is the training order."""
    streams = document_streams(sizes).where("size > 0")
    known = targets.select(F.col("source").alias("_s"), "source_size", "target")
    placed = with_blocks(streams.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), block_words)
    wide = lambda c: c.cast("decimal(19,0)")
    of_word = lambda word: F.floor((wide(word) * wide(F.col("blocks")) + wide(F.col("blocks")) - 1) / wide(F.col("source_size"))).cast("bigint")
    cut = placed.withColumn("block", F.explode(F.sequence(of_word(F.col("start")), of_word(F.col("start") + F.col("size") - 1))))
    cut = (
        cut.withColumn("from", F.greatest(F.col("start"), cut_at(F.col("block"))))
        .withColumn("to", F.least(F.col("start") + F.col("size"), cut_at(F.col("block") + 1)))
        .where("from < to")
    )
    slots = with_blocks(schedule(targets, block_words).join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("source"), block_words)
    slots = slots.select("slot", "_s", (F.col("rank") % F.col("blocks")).alias("_block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))
    joined = cut.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
    stop = F.round("target").cast("bigint") - F.col("epoch") * F.col("source_size")  # words of this epoch that still count
    return (
        joined.withColumn("to", F.least(F.col("to"), stop))
        .where("from < to")
        .select("slot", "block", "epoch", "id", "row", "source", (F.col("from") - F.col("start")).alias("first"), (F.col("to") - F.col("start")).alias("last"))
    )


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size, shuffle and row (which tells rows with equal ids apart), stored so that they are made once."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|mix")))
    return stored(slim.select("id", "source", n_words(F.col("text")).alias("size"), key.alias("shuffle"), F.monotonically_increasing_id().alias("row")), "mix-sizes")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes of it, repeats counted."""
    sizes = sized(docs, id_col, text_col, source_col)
    targets = stored(source_targets(sizes), "mix-targets")
    taken = mixed_pieces(sizes, targets, block_words).groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    known = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return (
        sizes.join(taken, "row", "left")
        .join(known, F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with their columns, whole: a document comes as often as the mix begins to take it.

    Only the last document of a source's target is taken in part by the schedule; here it stays whole.
    """
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"), F.xxhash64(*docs.columns).alias("_id"))
    counts = mix_counts(marked)
    return marked.join(counts, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def mix_counts(marked: DataFrame) -> DataFrame:
    """_id and copies; rows with an equal content hash are one entry that stands for all of them."""
    whole = marked.groupBy("_id").agg(F.max(n_words(F.col("_text"))).alias("one"), F.max("_source").alias("source"), F.count("*").alias("rows"))
    sizes = stored(
        whole.select(
            F.col("_id").alias("id"), "source", (F.col("one") * F.col("rows")).alias("size"), F.md5(F.col("_id").cast("string")).alias("shuffle"), F.col("_id").alias("row")
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(sizes), "mix-targets")
    pieces = mixed_pieces(sizes, targets)
    return pieces.groupBy(F.col("row").alias("_id"), "epoch").agg(F.lit(1).alias("n")).groupBy("_id").agg(F.sum("n").cast("int").alias("copies"))
