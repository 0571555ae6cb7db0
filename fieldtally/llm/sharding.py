"""Sharding by a weighted hash tree, in DataFrame functions only.

A key descends from the root to a region, a rack and a shard. At each level every child draws ``-ln(u) / weight`` with u a
hash of the key and the child's name, and the smallest draw wins: children win in proportion to their weights. A draw
depends on nothing but key, child and weight, so a change of weight moves keys only into or out of the subtree whose weight
changed, and the other children keep their draws. A new shard comes as a subtree of its own (a new region holding one rack
with it), so that it takes keys only into itself.

Defined cases: a null key is a key like any other (it draws as the empty text); equal keys go to the same shard; a null text
has size 1 and checksum 0; an empty table gives an empty result; further columns are kept, and names that begin with ``_``
are used on the way. Slots follow (hash of key, key, checksum); equal rows get neighbouring slots in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tables import running_sums


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: 16 shards: two regions of two racks of four shards
TREE = tuple(Leaf(f"r{i // 8}", f"r{i // 8}k{i // 4 % 2}", i) for i in range(16))


def grown(tree: tuple[Leaf, ...]) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a region and rack of its own, of the mean weight."""
    n = 1 + max(leaf.shard for leaf in tree)
    weight = sum(leaf.weight for leaf in tree) / len(tree)
    return (*tree, Leaf(f"grown{n}", f"grown{n}k", n, weight))


def draw(key: Column, node: str, weight: float) -> Column:
    """The node's draw: exponential with the weight as its rate. 52 bits of an MD5 digest make the uniform number."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / float(2**52 + 1)) / F.lit(float(weight))


def chosen(key: Column, children: dict[str, float]) -> Column:
    """Name of the child with the smallest draw; the smaller name among equal draws."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(draw(key, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(children.items())]))["n"]


def with_shard(docs: DataFrame, key: str, tree: tuple[Leaf, ...] = TREE, into: str = "shard") -> DataFrame:
    """Adds the shard of each row: three choices, one below the other. No shuffle."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    regions: dict[str, dict[str, dict[str, float]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, {})[str(leaf.shard)] = leaf.weight
    total = lambda racks: sum(sum(shards.values()) for shards in racks.values())
    placed = docs.withColumn("_region", chosen(text, {r: total(racks) for r, racks in regions.items()}))
    rack = shard = None
    for region, racks in regions.items():
        here = F.col("_region") == region
        pick = chosen(text, {k: sum(s.values()) for k, s in racks.items()})
        rack = F.when(here, pick) if rack is None else rack.when(here, pick)
    placed = placed.withColumn("_rack", rack)
    for racks in regions.values():
        for name, shards in racks.items():
            here, pick = F.col("_rack") == name, chosen(text, shards)
            shard = F.when(here, pick) if shard is None else shard.when(here, pick)
    return placed.withColumn(into, shard.cast("int")).drop("_region", "_rack")


def with_slots(placed: DataFrame, key: str, text: str = "text", rows_a_bucket: int = 4_000, into: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard. Shards are cut into buckets of hash ranges of about
    ``rows_a_bucket`` rows; buckets are counted, then rows are numbered within their bucket."""
    marked = placed.withColumn("_spread", F.xxhash64(F.col(key).cast("string"), F.lit("slot"))).withColumn(
        "_crc", F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")) if text in placed.columns else F.lit(0)
    )
    buckets = max(1, placed.select(F.lit(1)).count() // rows_a_bucket)
    width = max(1, -(-(2**64) // buckets))
    bucket = F.floor((F.col("_spread").cast("double") + float(2**63)) / float(width)).cast("int")
    order = ["_spread", key, "_crc"]
    return running_sums(marked, ["shard"], order, bucket, F.lit(1), into).drop("_spread", "_crc")


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", tree: tuple[Leaf, ...] = TREE) -> DataFrame:
    """The documents with ``shard`` and ``slot``. Columns of these names in the input are replaced; all others come through,
    whatever they are called, as they travel in a struct."""
    plain = docs.drop("shard", "slot")
    whole = F.col(text) if text in plain.columns else F.lit(None)
    packed = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("doc"), F.col(key).alias("key"), whole.cast("string").alias("text"))
    return with_slots(with_shard(packed, "key", tree), "key").select("doc.*", "shard", "slot")


def shard_report(docs: DataFrame, key: str = "doc_id", text: str = "text", tree: tuple[Leaf, ...] = TREE) -> DataFrame:
    """Per row: size in bytes plus 1, checksum, law, shard, slot, and the shard once the tree has grown by one.

    The text itself is not shuffled.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(key), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = with_shard(with_shard(slim, key, tree), key, grown(tree), "grown_shard")
    numbered = with_slots(placed.withColumn("_text", F.col("text_crc32").cast("string")), key, "_text")
    return numbered.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
