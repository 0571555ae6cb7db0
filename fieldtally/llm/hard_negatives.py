"""Hard negatives by angular triangle filtering: for an anchor and each of its nearest rows of the same label, the highest
scoring rows of other labels whose score lies in a window below the positive's.

A vector is turned into whole numbers, floor(256 x); a score is the integer inner product. For every row the angles to a few
reference directions are stored. By the triangle inequality for angles, two rows' angles to one direction differ by at most
the angle between the rows, and add up to at least it; so all directions together give an interval for the cosine, which times
both lengths bounds the score. The interval is widened by far more than the rounding of floats. Only rows whose interval
meets what is still wanted (the best scores so far, or a window) get the integer product; how many that are depends on the
data, the result does not.

Anchors are handled in blocks of a bounded size, which are sent to all tasks; each block passes over the rows twice, once
for positives and once for negatives. Tasks keep the first few rows of each anchor only, and these are merged in two steps.
Rows are never shuffled.

Defined cases: rows without an id or label, and those with a null vector or a null or non-finite component take no part; nor
do vectors whose whole numbers are longer than 2^26, whose scores floats can't hold exactly. Vectors of different lengths are
compared as if the shorter ended in zeros. An anchor without positives, and a positive without rows in its window give no
rows. Repeated rows count as often as they stand; an anchor that stands twice is one, and rows with an anchor's id are not its
positives. An empty table gives an empty result. Columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally.llm.tables import stored

SCALE = 256
DIRECTIONS = 8
SAMPLE_ROWS = 1_000
#: components of a block of anchors, and of the rows scored at a time
BLOCK_VALUES = 1 << 18
CHUNK_ROWS = 1_024
LONGEST = float(1 << 26)
TOP = "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


@dataclass
class Rows:
    """Vectors of whole numbers (as floats that hold them exactly) with their lengths and angles to the directions."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    angles: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the longest (or to ``width``)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction of length one; a row of zeros is at a right angle to all."""
    width = max(vectors.shape[1], directions.shape[1])
    v, d = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, directions))
    lengths = np.sqrt((v * v).sum(axis=1))
    return np.arccos(np.clip(v @ d.T / np.maximum(lengths, 1.0)[:, None], -1.0, 1.0))


def spread_out(vectors: np.ndarray, n: int) -> np.ndarray:
    """At most n directions of the given vectors, each as far as can be from those before it."""
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(unit):
        return np.zeros((0, vectors.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
    return unit[chosen]


def score_bounds(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Safe lower and upper bounds of the scores of all rows of a with all of b."""
    product = a.lengths[:, None] * b.lengths[None, :]
    near, far = np.zeros(product.shape), np.full(product.shape, np.pi)
    for k in range(a.angles.shape[1]):
        x, y = a.angles[:, k][:, None], b.angles[:, k][None, :]
        np.maximum(near, np.abs(x - y), out=near)
        total = x + y
        np.minimum(far, np.minimum(total, 2 * np.pi - total), out=far)
    slack = 1.0 + 1e-9 * product  # beyond any rounding of the cosines; angles get a millionth
    low = product * np.cos(np.minimum(far + 1e-6, np.pi)) - slack
    return low, product * np.cos(np.maximum(near - 1e-6, 0.0)) + slack


def scores(a: Rows, b: Rows, wanted: np.ndarray) -> np.ndarray:
    """Exact scores where wanted, zeros elsewhere."""
    width = min(a.vectors.shape[1], b.vectors.shape[1])
    x, y = a.vectors[:, :width], b.vectors[:, :width]
    if wanted.mean() > 0.05:
        return np.where(wanted, x @ y.T, 0.0)
    out = np.zeros(wanted.shape)
    i, j = np.nonzero(wanted)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[i[s], j[s]] = np.einsum("nd,nd->n", x[i[s]], y[j[s]])
    return out


class Best:
    """The first ``keep`` (score down, id up) of each key."""

    def __init__(self, keys: int, keep: int):
        self.keep = keep
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(keys, -np.inf)  # a score below it can't enter any more

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        last = place == self.keep - 1
        self.least[key[last]] = score[last]
        stay = place < self.keep
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK_ROWS):
            yield rows_of(whole.slice(start, CHUNK_ROWS))


def rows_of(batch: pa.RecordBatch | pa.Table) -> Rows:
    return Rows(
        batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vector")),
        batch.column("length").to_numpy(), matrix(batch.column("angles")),
    )


def prepared(rows: DataFrame, id_col: Column, label_col: Column, vector_col: Column) -> DataFrame:
    """id, label, vector of whole numbers, length and angles of the rows that take part, written."""
    vector = vector_col.cast("array<double>")
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.select(id_col.cast("bigint").alias("id"), label_col.cast("bigint").alias("label"), F.when(fine, vector).alias("vector"))
    whole = whole.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    whole = whole.withColumn("vector", F.transform("vector", lambda x: F.floor(x * float(SCALE)).cast("double")))
    whole = whole.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))).where(F.col("length") <= LONGEST)
    sample = whole.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE_ROWS).select("vector").toArrow()  # bounded; its size never changes a result
    sent = whole.sparkSession.sparkContext.broadcast(spread_out(matrix(sample["vector"]), DIRECTIONS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = angles_to(matrix(batch.column("vector")), sent.value)
            offsets = np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1]
            yield batch.append_column("angles", pa.ListArray.from_arrays(pa.array(offsets), pa.array(angles.ravel())))

    return stored(whole.mapInArrow(measure, "id bigint, label bigint, vector array<double>, length double, angles array<double>"), "negatives-rows")


def first(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows of each anchor and slot with their rank, by parts of an anchor first."""
    order = [F.desc("score"), F.asc("id")]
    part = Window.partitionBy("anchor", "slot", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy(*order)
    whole = Window.partitionBy("anchor", "slot").orderBy(*order)
    leaders = found.withColumn("place", F.row_number().over(part)).where(F.col("place") <= keep)
    return leaders.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= keep)


def table_of(best: Best, slots: int, anchors: Rows, ids: np.ndarray | None, values: np.ndarray | None) -> pa.RecordBatch:
    anchor, slot = best.key // slots, best.key % slots
    columns = [
        pa.array(anchor, pa.int32()), pa.array(slot, pa.int32()), pa.array(anchors.ids[anchor], pa.int64()),
        pa.array(np.zeros(len(anchor), np.int64) if ids is None else ids[anchor, slot], pa.int64()),
        pa.array(np.zeros(len(anchor), np.int64) if values is None else values[anchor, slot].astype(np.int64), pa.int64()),
        pa.array(best.id, pa.int64()), pa.array(best.score.astype(np.int64), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "anchor_id", "positive_id", "positive_score", "id", "score"])


def positives(rows: DataFrame, block: Rows, keep: int) -> DataFrame:
    """For each anchor of the block its first rows of the same label."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors), keep)
        for part in chunks(batches):
            wanted = (anchors.labels[:, None] == part.labels[None, :]) & (anchors.ids[:, None] != part.ids[None, :])
            wanted &= score_bounds(anchors, part)[1] >= best.least[:, None]
            exact = scores(anchors, part, wanted)
            i, j = np.nonzero(wanted & (exact >= best.least[:, None]))
            best.add(i, exact[i, j], part.ids[j])
        yield table_of(best, 1, anchors, None, None)

    return first(rows.mapInArrow(run, TOP), keep)


def negatives(rows: DataFrame, block: Rows, near: pa.Table, slots: int, keep: int, share: int) -> DataFrame:
    """For each anchor and positive the first rows of other labels whose score is ``share`` to 100 per cent of the positive's."""
    ids, high = np.zeros((len(block), slots), np.int64), np.full((len(block), slots), -np.inf)
    anchor, slot = near["anchor"].to_numpy(), near["place"].to_numpy() - 1
    ids[anchor, slot], high[anchor, slot] = near["id"].to_numpy(), near["score"].to_numpy()
    low = np.where(np.isinf(high), np.inf, np.ceil(high * share / 100 - 1e-6))  # a bound for the filter; the test itself is in whole numbers
    sent = rows.sparkSession.sparkContext.broadcast((block, ids, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, low, high = sent.value
        best = Best(len(anchors) * slots, keep)
        for part in chunks(batches):
            least = np.maximum(low, best.least.reshape(len(anchors), slots))
            under, over = score_bounds(anchors, part)
            wanted = np.zeros(under.shape, dtype=bool)
            for k in range(slots):
                wanted |= (over >= least[:, k][:, None]) & (under <= high[:, k][:, None])
            wanted &= anchors.labels[:, None] != part.labels[None, :]
            exact = scores(anchors, part, wanted)
            for k in range(slots):
                i, j = np.nonzero(wanted & (exact >= least[:, k][:, None]) & (exact <= high[:, k][:, None]))
                inside = share * high[i, k].astype(np.int64) <= 100 * exact[i, j].astype(np.int64)
                best.add(i[inside] * slots + k, exact[i, j][inside], part.ids[j][inside])
        yield table_of(best, slots, anchors, ids, high)

    return first(rows.mapInArrow(run, TOP), keep)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", n_positives: int = 5, n_negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchor`` is a condition on the column id."""
    ready = prepared(rows, F.col(id_col), F.col("label") if label is None else label, F.col(vector_col))
    chosen = stored(ready.where(anchor).distinct(), "negatives-anchors")
    size = chosen.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    per_block = max(1, BLOCK_VALUES // max(size["width"] or 1, 64))
    blocks = -(-size["n"] // per_block)
    found = rows.sparkSession.createDataFrame([], TOP + ", place int")
    for block in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block)
        anchors = rows_of(part.orderBy("id", "label", "vector").toArrow())
        if len(anchors):
            near = positives(ready, anchors, n_positives).toArrow()  # n_positives rows an anchor of the block
            found = found.unionByName(stored(negatives(ready, anchors, near, n_positives, n_negatives, share), "negatives-found"))
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
