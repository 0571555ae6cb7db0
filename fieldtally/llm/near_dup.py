"""Near-duplicates by ProbMinHash: signatures of weighted word shingles, banding, exact verification, components.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A to Z lower-cased; a shingle is five
consecutive words (a shorter text is one shingle), weighted by how often the text has it. Every shingle starts a Poisson
process whose rate is its weight; each arrival falls into a random register, and a register keeps the shingle of its first
arrival. A process ends early once its next arrival is later than the latest first arrival of all registers. Two texts
agree in a register with the probability of their probability Jaccard similarity (equal to Jaccard where all weights are 1).

Texts with equal words share a node. Nodes that agree in a band of registers are candidates; a link is a candidate pair with
an exact probability Jaccard of 0.8 or more; a class is a component of links. Small buckets are compared pair by pair. In a larger one, members are compared with one
centre, then components are formed, and only pairs of different components are left to compare; at the end all of these
are. So no group of copies is expanded into all its pairs, and no candidate pair between different classes is left out.

Defined cases: a null text is a class of its own; texts without words are copies of each other; repeated rows are copies; the
class id is the smallest id of the class (null if all its ids are null); an empty table gives an empty result. Only id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.graph import components
from fieldtally.llm.tables import stored
from fieldtally.llm.text import WORDY, mixed, pieces, powers, rolling, words


@dataclass(frozen=True)
class Sketch:
    """Parameters: words in a shingle, bands and registers in a band, least similarity. A pair of similarity 0.8 shares no
    band with probability (1 - 0.8^6)^28 = 0.0002."""

    width: int = 5
    bands: int = 28
    rows: int = 6
    least: float = 0.8


SKETCH = Sketch()
ID_BITS = np.uint64(50)
#: rows of the largest table of wanted ids that is broadcast; beyond, it is shuffled
BROADCAST_ROWS = 1_000_000
#: buckets of so many members are compared pair by pair at once
FEW = 16
#: mean members outside the largest component from which on another round of centres is tried, and sizes of blocks
MINOR, BLOCK, PROBES = 1024, 256, 2048
#: mean shingles of a block of either kind, and numbers in a table of a block's shares
BLOCK_SHINGLES, PROBE_SHINGLES, CELLS = 1 << 19, 1 << 21, 1 << 22


def shingles(piece, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """digests (two numbers a row), and row, id, weight of each row's distinct shingles, sorted by row and id."""
    found = words(piece, lower=True, inside=WORDY)
    n, row, counts = len(piece), found.row, np.diff(found.rows)
    digests = np.zeros((n, 2), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        place = powers(int(counts.max()))[np.arange(len(row)) - np.repeat(found.rows[:-1], counts)]
        for k, codes in enumerate((found.hashes, mixed(found.hashes))):
            digests[full, k] = mixed(np.add.reduceat(codes * place, found.rows[:-1][full]) + counts[full].astype(np.uint64))
    keys, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(row) >= width:
        at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        keys, at = mixed(rolling(found.hashes, width)[at]), row[at]
    short = full[counts[full] < width]
    keys, at = np.concatenate([keys, digests[short, 0]]), np.concatenate([at, short])
    packed = np.sort((at.astype(np.uint64) << ID_BITS) | (keys >> (np.uint64(64) - ID_BITS)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    weights = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return digests, (packed >> ID_BITS).astype(np.int64), packed & ((np.uint64(1) << ID_BITS) - np.uint64(1)), weights


def prob_min_hash(n: int, row: np.ndarray, ids: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """Signatures of n rows with m registers: the id whose process was the first to arrive in each register."""
    first = np.full(n * m, np.inf)
    kept = np.zeros(n * m, dtype=np.uint64)
    when, rate, step = np.zeros(len(ids)), weights.astype(np.float64), 0
    while len(ids):
        step += 1
        draws = mixed(ids + np.uint64(step * 0xD1B54A32D192ED03 % 2**64))
        when = when - np.log(((draws >> np.uint64(20)).astype(np.float64) + 1.0) / float(2**44 + 1)) / rate
        register = row * m + ((draws & np.uint64(0xFFFFF)) * np.uint64(m) >> np.uint64(20)).astype(np.int64)
        np.minimum.at(first, register, when)
        won = first[register] == when
        kept[register[won]] = ids[won]
        open_rows = np.unique(row)
        latest = np.zeros(n)
        latest[open_rows] = first.reshape(n, m)[open_rows].max(axis=1)
        alive = when < latest[row]
        row, ids, when, rate = row[alive], ids[alive], when[alive], rate[alive]
    return kept.reshape(n, m)


def node_values(digests: np.ndarray, texts: pa.Array) -> pa.Array:
    """16 bytes a row, null where the text is null."""
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(np.ascontiguousarray(digests))])
    return pa.compute.if_else(pa.compute.is_valid(texts), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))


def sketched(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """id, node, keys (one number a band; none where the text has no words)."""
    m = sketch.bands * sketch.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                digests, row, ids, weights = shingles(piece, sketch.width)
                signature = prob_min_hash(len(piece), row, ids, weights, m).reshape(len(piece), sketch.bands, sketch.rows)
                keys = np.zeros((len(piece), sketch.bands), dtype=np.uint64)
                for k in range(sketch.rows):
                    keys = mixed(keys * np.uint64(3) + signature[:, :, k])
                keys = mixed(keys + np.arange(sketch.bands, dtype=np.uint64))
                full = np.bincount(row, minlength=len(piece)) > 0
                offsets = np.concatenate([[0], np.cumsum(full * sketch.bands)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel().view(np.int64)))
                texts = batch.column(1).slice(piece.rows.start, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.rows.start, len(piece)), node_values(digests, texts), values], names=["id", "node", "keys"]
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node binary, keys array<bigint>")


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """node, ids, weights: the weighted shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                digests, row, ids, weights = shingles(piece, width)
                offsets = pa.array(np.searchsorted(row, np.arange(len(piece) + 1)).astype(np.int32))
                texts = batch.column(0).slice(piece.rows.start, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        node_values(digests, texts),
                        pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(weights.astype(np.int32))),
                    ],
                    names=["node", "ids", "weights"],
                )

    return docs.mapInArrow(run, "node binary, ids array<bigint>, weights array<int>")


def probability_jaccard(ids_a: np.ndarray, x: np.ndarray, ids_b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    both, at_a, at_b = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    xs, ys = x[at_a], y[at_b]
    ratios, of = np.unique(xs / ys, return_inverse=True)
    alone_x, alone_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    sums = np.array([np.maximum(xs, r * ys).sum() + alone_x + r * alone_y for r in ratios])
    return float((xs / sums[of]).sum())


def verified(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity reaches ``least``, with the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for name in ("ids_a", "weights_a", "ids_b", "weights_b"):
                column = batch.column(name)
                values, offsets = np.asarray(column.values), np.asarray(column.offsets)
                lists.append([values[offsets[i] : offsets[i + 1]] for i in range(len(column))])
            found = np.array([probability_jaccard(*x) for x in zip(*lists, strict=True)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"]).filter(pa.array(found >= least))

    left = rows.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"), F.col("weights").alias("weights_a"))
    right = rows.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"), F.col("weights").alias("weights_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, similarity double")


def links(docs: DataFrame, sketches: DataFrame, sketch: Sketch) -> DataFrame:
    """node and root: components of the verified links, which connect every class."""
    entries = sketches.select(F.explode("keys").alias("key"), "node").distinct()
    crowded = entries.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("n > 1")
    members = stored(entries.join(crowded, "key"), "near-members")
    wanted = stored(sketches.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "near-wanted")
    ids = wanted.select(F.col("id").alias("_id")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    again = docs.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    rows = stored(shingle_rows(again.select("text"), sketch.width).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-shingles")
    # All pairs of small buckets, so at most FEW / 2 a member; of others, the members with the bucket's centre.
    listed = members.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("node").alias("all"))
    later = lambda a: F.transform(F.filter("all", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = listed.select(F.explode(F.flatten(F.transform("all", later))).alias("pair")).select("pair.*")
    stars = members.where((F.col("n") > FEW) & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    roots = connected(pairs.union(stars), rows, sketch, None)
    rest, before, turn = members.where(F.col("n") > FEW).select("key", "node"), float("inf"), 0
    while True:
        turn += 1
        placed = stored(rest.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-placed")
        order = F.xxhash64("node", F.lit(turn))
        groups = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("order"), F.col("node").alias("centre"), F.col("root").alias("own"))).alias("first"))
        split = stored(
            groups.groupBy("key")
            .agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.min("first").alias("first"))
            .where("roots > 1")
            .select("key", "all", (F.col("all") - F.col("most.n")).alias("minor"), F.col("most.root").alias("major"), "first.centre", "first.own"),
            "near-split",
        )
        size = split.agg(F.sum("all").alias("rows"), F.sum(F.col("all") * F.col("minor")).alias("pairs")).first()
        if not size["rows"]:
            return roots
        # A centre costs a comparison a member. Once that no longer joins groups, or little is left, all members outside a
        # bucket's largest component are compared with all members of other components.
        last = size["pairs"] <= MINOR * size["rows"] or size["pairs"] > before / 2
        before = size["pairs"]
        if last:
            edges = block_links(placed.join(split.select("key", "all", "minor", "major"), "key"), rows, sketch)
            return components(edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "near-roots")
        rest = placed.join(split, "key")
        roots = connected(rest.where("root <> own").select(F.col("centre").alias("a"), F.col("node").alias("b")), rows, sketch, roots)
        rest = stored(rest.select("key", "node"), "near-rest")


def overlaps(held: list[tuple[np.ndarray, np.ndarray]], probes: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """Overlap of the shares of every probe (row) with those of every held text (column), each given as ids and weights.

    The ids are taken in ranges, for which the held texts' shares fit a table of ``cells`` numbers.
    """
    out = np.zeros((len(probes), len(held)))
    if not len(held) or not len(probes):
        return out
    owner = np.repeat(np.arange(len(held)), [len(ids) for ids, _ in held])
    known, at = np.unique(np.concatenate([ids for ids, _ in held]), return_inverse=True)
    share = np.concatenate([weights / max(weights.sum(), 1) for _, weights in held])
    width = max(1, cells // len(held))
    for start in range(0, len(known), width):
        part = known[start : start + width]
        inside = (at >= start) & (at < start + len(part))
        table = np.zeros((len(held), len(part)))
        table[owner[inside], at[inside] - start] = share[inside]
        for n, (ids, weights) in enumerate(probes):
            place = np.minimum(np.searchsorted(part, ids), len(part) - 1)
            hit = part[place] == ids
            if hit.any():
                out[n] += np.minimum(table[:, place[hit]], weights[hit] / weights.sum()).sum(axis=1)
    return out


def block_links(
    members: DataFrame, rows: DataFrame, sketch: Sketch, block: tuple[int, int] = (BLOCK, BLOCK_SHINGLES), probe: tuple[int, int] = (PROBES, PROBE_SHINGLES), cells: int = CELLS
) -> DataFrame:
    """Links a, b between members of different components in a bucket. ``members``: key, node, root, all, minor, major.

    The members outside the largest component are cut into blocks, all members into probes, of about so many texts
    and shingles as ``block`` and ``probe`` say; a task holds one of either, so that memory is bounded but for single texts
    that are longer, and no row is made for a pair without a link.
    """
    weighed = members.join(rows.select("node", F.size("ids").alias("size")), "node")
    sizes = weighed.groupBy("key").agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("root") != F.col("major"), F.col("size"))).alias("minor_size"))
    members = members.join(sizes, "key")

    def parts(count: str, size: str, limit: tuple[int, int]):
        return F.ceil(F.greatest(F.col(count) / limit[0], F.col(size) / limit[1])).cast("int")

    blocks, probes = parts("minor", "minor_size", block), parts("all", "all_size", probe)
    of_block, of_probe = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int"), F.pmod(F.xxhash64("node", F.lit("probe")), probes).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    builds = members.where("root <> major").select("key", of_block.alias("block"), every(probes).alias("probe"), F.lit(True).alias("build"), "node", "root")
    others = members.select("key", every(blocks).alias("block"), of_probe.alias("probe"), F.lit(False).alias("build"), "node", "root")
    held = builds.union(others).join(rows, "node")

    def run(table: pa.Table) -> pa.Table:
        lists = []
        for name in ("ids", "weights"):
            column = table.column(name).combine_chunks()
            values, offsets = np.asarray(column.values), np.asarray(column.offsets)
            lists.append([values[offsets[i] : offsets[i + 1]] for i in range(len(column))])
        texts = list(zip(*lists, strict=True))
        nodes, roots, build = (table.column(c).to_pylist() for c in ("node", "root", "build"))
        left, right = [i for i, x in enumerate(build) if x], [i for i, x in enumerate(build) if not x]
        # the overlap of the two distributions is an upper bound of the similarity
        bounds = overlaps([texts[i] for i in left], [texts[j] for j in right], cells)
        found: set[tuple[int, bytes]] = set()
        links: list[tuple[bytes, bytes]] = []
        for n, k in np.argwhere(bounds >= sketch.least - 1e-9):
            i, j = left[k], right[n]
            if roots[i] != roots[j] and (i, roots[j]) not in found and probability_jaccard(*texts[i], *texts[j]) >= sketch.least:
                found.add((i, roots[j]))
                links.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return held.groupBy("key", "block", "probe").applyInArrow(run, "a binary, b binary")


def connected(pairs: DataFrame, rows: DataFrame, sketch: Sketch, roots: DataFrame | None) -> DataFrame:
    """node and root once the verified ones among ``pairs`` are added to the components so far."""
    ordered = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    edges = verified(ordered, rows, sketch.least).select("a", "b")
    if roots is not None:
        edges = edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(edges, "near-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = SKETCH) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), exact_id (smallest id with the same words),
    class_size."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = stored(sketched(slim, sketch), "near-sketches")
    roots = links(slim, sketches, sketch)
    nodes = sketches.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("exact_id"), F.count("*").alias("n"))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stored(nodes, "near-nodes")
    classes = nodes.groupBy("root").agg(F.min("exact_id").alias("class_id"), F.sum("n").alias("class_size"))
    known = nodes.join(classes, "root").select("node", "exact_id", "class_id", "class_size")
    return sketches.select("id", "node").join(known, "node", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("exact_id")).alias("exact_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = SKETCH) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id, of equal ids that with the smallest
    hash of its text; ids come before nulls. Rows with equal id and text are one. Every row with a null text stays.

    A row goes by its id and text, so texts that share an id, or have none, are kept apart.
    """
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"), text.alias("text"))
    report = stored(near_duplicates(packed, "key", "text", sketch), "near-report")
    kept = stored(report.where(F.col("key").eqNullSafe(F.col("class_id"))).groupBy(F.col("key").alias("chosen")).agg(F.count("*").alias("n")), "near-kept")
    out = packed.join(kept.select("chosen"), F.col("key").eqNullSafe(F.col("chosen")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.where("text IS NULL").unionByName(out.where("text IS NOT NULL").dropDuplicates(["key"]))
    return out.select("doc.*")
