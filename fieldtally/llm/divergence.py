"""How far apart the sources of a language are in their terms, with late string materialisation.

Terms are runs of letters: A to Z, lower-cased, and all non-ASCII characters. Tasks turn each term into a 64-bit digest and count
digests per (lang, source); only these numbers are shuffled. A language keeps the digests that enough of its documents have.
A second pass over the texts gives the smallest and the largest string of each kept digest: where the two differ, different
terms share the digest, and these digests alone are counted again with their strings, so that collisions are split exactly.
Shares, divergences and ranks are worked out on digests; only rows that can be in a result are joined with their strings.

A share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)) in a group of N occurrences of the language's V kept terms, the
divergence of two shares floor((p - q)^2 / (p + q)), all in whole numbers. Sources are compared on all kept terms, also those
that neither has: with p0 the share of a count of zero, the sum over all terms is V f(p0, q0), plus what each source's own terms
change against the other's p0 (from a histogram of its shares), plus a correction for the terms that both have. Only the last
needs terms of both at once; it is added up inside tasks, so no pair of sources becomes a row per term.

The second pass asks a bitmap of fixed size which digests are kept; a join settles it exactly, whatever the bitmap lets through.
Nulls in text, lang and source read as empty; texts without terms count as documents of their group; repeated rows are
documents of their own; a language without kept terms has zero as the value of every pair and no terms; equal values rank by
the bytes of the name; an empty table gives an empty result. Columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally.llm.tables import stored
from fieldtally.llm.text import pieces, words

PIECE_BYTES = 4 << 20
#: bytes of A to Z after lower-casing, and of all non-ASCII characters
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True
#: bits of the bitmap of digests, a megabyte
BITMAP = 1 << 23
CONTEXT = ["lang", "source"]
TERM = ["lang", "digest", "split"]


def group_numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Number of each row's (lang, source), and the groups in order."""
    found: dict[tuple[str, str], int] = {}
    numbers = [found.setdefault(x, len(found)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
    return np.array(numbers, dtype=np.int64), list(found)


def term_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each span as strings."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def counted(docs: DataFrame, bits: int) -> DataFrame:
    """lang, source, digest, tf (occurrences) and df (documents) of all terms."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, groups = group_numbers(batch)
            names = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
            for piece in pieces(batch.column("text"), PIECE_BYTES):
                w = words(piece, lower=True, inside=LETTERS)
                if not len(w.hashes):
                    continue
                row = w.row
                group, digest = numbers[piece.rows][row], (w.hashes & mask).view(np.int64)
                order = np.lexsort((row, digest, group))
                group, digest, row = group[order], digest[order], row[order]
                new = np.concatenate([[True], (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])])
                at = np.flatnonzero(new)
                new[1:] |= row[1:] != row[:-1]
                tf, df = np.diff(np.append(at, len(row))), np.add.reduceat(new.astype(np.int64), at)
                out = pa.RecordBatch.from_arrays(
                    [names[0].take(pa.array(group[at])), names[1].take(pa.array(group[at])), pa.array(digest[at]), pa.array(tf), pa.array(df)],
                    names=["lang", "source", "digest", "tf", "df"],
                )
                for start in range(0, out.num_rows, 1 << 16):
                    yield out.slice(start, 1 << 16)

    rows = docs.mapInArrow(run, "lang string, source string, digest bigint, tf bigint, df bigint")
    return rows.groupBy("lang", "source", "digest").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, term: list[str], least_docs: int) -> DataFrame:
    """The rows of terms that enough documents of their language have, with the term's count in the language."""
    whole = Window.partitionBy(*term)
    found = counts.withColumn("lang_df", F.sum("df").over(whole)).withColumn("lang_tf", F.sum("tf").over(whole))
    return found.where(F.col("lang_df") >= least_docs).drop("df", "lang_df")


def bitmap_of(digests: DataFrame) -> np.ndarray:
    """A bit for each digest at its lowest bits: at most a megabyte, in rows of 32768 bits."""
    place = (F.col("digest").bitwiseAND(BITMAP - 1)) + 1
    rows = digests.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros(BITMAP, dtype=bool)
    for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[(bucket - 1) * 32768 : bucket * 32768] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    return out


def strings_of(docs: DataFrame, digests: DataFrame, bits: int, per_group: bool) -> DataFrame:
    """The different strings of the given digests: one row each (per piece of text), or with their counts per group."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap_of(digests)))
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            numbers, groups = group_numbers(batch)
            for piece in pieces(batch.column("text"), PIECE_BYTES):
                w = words(piece, lower=True, inside=LETTERS)
                digest = w.hashes & mask
                here = np.flatnonzero(wanted[(digest & np.uint64(BITMAP - 1)).astype(np.int64)])
                if not len(here):
                    continue
                digest = digest[here].view(np.int64)
                data = np.where((piece.data >= 65) & (piece.data <= 90), piece.data + 32, piece.data).astype(np.uint8)
                if not per_group:
                    # one span of each different (digest, length, second hash) is enough, as equal strings agree in all three;
                    # strings that differ in any are told apart here, and those that differ in none have their bytes compared
                    _, first, same = np.unique(digest, return_index=True, return_inverse=True)
                    head = here[first][same]
                    odd = w.ends[here] - w.starts[here] != w.ends[head] - w.starts[head]
                    even = np.flatnonzero(~odd)
                    lengths = (w.ends - w.starts)[here[even]]
                    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    unlike = data[np.repeat(w.starts[here[even]], lengths) + inner] != data[np.repeat(w.starts[head[even]], lengths) + inner]
                    if unlike.any():
                        odd[even[np.repeat(np.arange(len(even)), lengths)[unlike]]] = True
                    take = np.concatenate([first, np.flatnonzero(odd)])
                    table = pa.table({"digest": pa.array(digest[take]), "term": term_strings(data, w.starts[here[take]], w.ends[here[take]])})
                    yield from table.group_by(["digest", "term"]).aggregate([]).to_batches(1 << 16)
                    continue
                row = w.row[here]
                table = pa.table({"row": row, "digest": digest, "term": term_strings(data, w.starts[here], w.ends[here])})
                table = table.group_by(["row", "digest", "term"]).aggregate([([], "count_all")])
                group = numbers[piece.rows][table["row"].to_numpy()]
                columns = {"lang": [groups[g][0] for g in group], "source": [groups[g][1] for g in group], "digest": table["digest"], "term": table["term"]}
                yield from pa.table(columns | {"tf": table["count_all"], "df": pa.array(np.ones(len(group), np.int64))}).to_batches(1 << 16)

    if not per_group:
        return docs.mapInArrow(run, "digest bigint, term string")
    rows = docs.mapInArrow(run, "lang string, source string, digest bigint, term string, tf bigint, df bigint")
    return rows.groupBy("lang", "source", "digest", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: Column, occurrences: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)) in decimals; 1 for a language without terms."""
    whole = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (occurrences + 2 * terms).cast("decimal(20,0)"))
    return F.when(terms == 0, 1).otherwise(whole + 1)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_corrections(rows: DataFrame) -> DataFrame:
    """lang, one, other, value: for pairs of sources (one < other), summed over the terms that both have, what the sum of
    both one-sided changes gets wrong. Rows of a term are next to each other; pairs are added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        rest: pa.Table | None = None
        for batch in batches:
            rest = add(sums, pa.concat_tables([rest, pa.table(batch)]) if rest is not None else pa.table(batch))
            if len(sums) > 500_000:
                yield result(sums)
                sums.clear()
        if rest is not None:
            add(sums, pa.concat_tables([rest, rest.slice(0, 1).set_column(0, "digest", pa.array([rest["digest"][-1].as_py() ^ 1]))]))
        yield result(sums)

    def add(sums: dict[tuple[str, str, str], int], table: pa.Table) -> pa.Table:
        """Adds all terms but the last, whose rows may go on; returns these."""
        table = table.combine_chunks()
        codes = [table[c].combine_chunks().dictionary_encode() for c in ("lang", "split", "source")]
        lang, split, source = (c.indices.to_numpy() for c in codes)
        digest = table["digest"].to_numpy()
        new = np.concatenate([[True], (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1]) | (split[1:] != split[:-1])])
        term = np.cumsum(new)
        end = int(np.flatnonzero(new)[-1])
        p, p0 = table["p"].to_numpy(), table["p0"].to_numpy()
        n_sources = len(codes[2].dictionary)
        for step in range(1, end):
            i = np.flatnonzero(term[: end - step] == term[step:end])
            if not len(i):
                break
            j = i + step
            value = gaps(p[i], p[j]) - gaps(p[i], p0[j]) - gaps(p0[i], p[j]) + gaps(p0[i], p0[j])
            key, back = np.unique((lang[i].astype(np.int64) * n_sources + source[i]) * n_sources + source[j], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, value)
            for k, v in zip(key.tolist(), total.tolist(), strict=True):
                name = codes[0].dictionary[k // n_sources // n_sources].as_py(), codes[2].dictionary[k // n_sources % n_sources].as_py(), codes[2].dictionary[k % n_sources].as_py()
                sums[name] = sums.get(name, 0) + v
        return table.slice(end)

    def result(sums: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "one", "other", "value"])

    ordered = rows.select("digest", "lang", "split", "source", "p", "p0").repartition(*TERM).sortWithinPartitions(*TERM, "source")
    return ordered.mapInArrow(run, "lang string, one string, other string, value bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank. ``bits`` shortens the digests, for tests of collisions."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = stored(kept_terms(counted(docs, bits), ["lang", "digest"], least_docs), "divergence-digests")
    found = strings_of(docs, kept, bits, per_group=False).join(kept.select("digest").distinct(), "digest", "left_semi")
    names = stored(found.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "divergence-names")
    kept = kept.withColumn("split", F.lit(""))
    mixed = names.where("low <> high").select("digest")
    if not mixed.isEmpty():  # different terms under one digest: count these by their strings
        again = strings_of(docs, mixed, bits, per_group=True).join(mixed, "digest", "left_semi").withColumnRenamed("term", "split")
        kept = kept.join(mixed, "digest", "left_anti").unionByName(kept_terms(again, TERM, least_docs))

    sizes = kept.groupBy(*CONTEXT).agg(F.sum("tf").alias("n"))
    terms = kept.select(*TERM).distinct().groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select(*CONTEXT).distinct().join(sizes, CONTEXT, "left").join(terms, "lang", "left").na.fill(0, ["n", "v"])
    groups = stored(groups.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang"))), "divergence-groups")  # one row a source
    zero = groups.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("n"), F.col("v")))
    rows = kept.join(zero, CONTEXT).withColumn("p", share(F.col("tf"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("lang_tf"), F.col("lang_n"), F.col("v")))
    rows = stored(rows.select(*CONTEXT, "digest", "split", "p", "p0", "q"), "divergence-shares")
    return pair_part(zero, rows).unionByName(term_part(rows, names, top))


def pair_part(zero: DataFrame, rows: DataFrame) -> DataFrame:
    """All other sources of each source's language by their divergence."""
    other = zero.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    neither = zero.join(other, "lang").where("source <> item").select(*CONTEXT, "item", (F.col("v") * gap(F.col("p0"), F.col("q0"))).alias("value"))
    shares = rows.groupBy(*CONTEXT, "p", "p0").agg(F.count("*").alias("times"))
    alone = shares.join(other, "lang").where("source <> item").groupBy(*CONTEXT, "item").agg(F.sum(F.col("times") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    both = shared_corrections(rows)
    parts = [neither, alone, alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")]
    parts += [both.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "value") for a, b in (("one", "other"), ("other", "one"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = whole.groupBy(*CONTEXT, "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*CONTEXT).orderBy(F.desc("value"), "item")
    return whole.select(*CONTEXT, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def term_part(rows: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """The terms that set each source most apart from its language. Ties at the last rank are kept until strings decide."""
    above = rows.where("p > q").select(*CONTEXT, "digest", "split", gap(F.col("p"), F.col("q")).alias("value"))
    part = Window.partitionBy(*CONTEXT, F.pmod("digest", F.lit(64))).orderBy(F.desc("value"))
    whole = Window.partitionBy(*CONTEXT).orderBy(F.desc("value"))
    chosen = above.withColumn("place", F.rank().over(part)).where(F.col("place") <= top)
    chosen = chosen.withColumn("place", F.rank().over(whole)).where(F.col("place") <= top)
    chosen = chosen.join(names, "digest").withColumn("item", F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split")))
    order = Window.partitionBy(*CONTEXT).orderBy(F.desc("value"), "item")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*CONTEXT, F.lit("term").alias("part"), "item", "value", "rank")
