"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    shard: int
    weight: float = 1.0


#: Regions of racks of shards.
Tree = tuple[tuple[tuple[Leaf, ...], ...], ...]

SLOT_BUCKETS = 1024


def default_tree(n_shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """n equal shards, filled rack by rack and region by region; one more shard extends the last rack or opens the next one."""
    leaves = [Leaf(i) for i in range(n_shards)]
    rack = [tuple(leaves[i : i + per_rack]) for i in range(0, n_shards, per_rack)]
    return tuple(tuple(rack[i : i + racks]) for i in range(0, len(rack), racks))


def _draw(key: Column, leaf: Leaf) -> Column:
    """An exponential draw with the leaf's weight as rate, from 53 bits of a hash of key and shard number."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(leaf.shard)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(float(leaf.weight))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard reached by descending region, rack and shard, at each level into the child of the least draw.

    A subtree's draw is the least of its leaves' draws, which has its total weight as rate; so a child is chosen with the
    probability of its weight at each level, and a changed or added leaf alters no draw but those on its own path: rows move
    only out of a subtree that lost weight or into one that gained weight, at every level.
    """
    leaves = [[[(x.shard, _draw(key, x)) for x in rack if x.weight > 0] for rack in region] for region in tree]

    def descend(children: list[tuple[Column, Column]]) -> Column:
        out, least = children[-1][1], _least([d for d, _ in children])
        for draw, then in reversed(children[:-1]):
            out = F.when(draw <= least, then).otherwise(out)
        return out

    regions = []
    for region in leaves:
        racks = [(_least([d for _, d in rack]), descend([(d, F.lit(s)) for s, d in rack])) for rack in region if rack]
        if racks:
            regions.append((_least([d for d, _ in racks]), descend(racks)))
    return descend(regions).cast("int")


def assign(docs: DataFrame, n_shards: int = 16, tree: Tree | None = None, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its key, size (UTF-8 bytes + 1), text_crc32, law `key`, shard, slot in the shard and the shard under the grown tree.

    Rows are the same whatever else the table holds: shard and grown_shard follow from the key alone. Equal keys share a
    shard; a null key is a key of its own. A null text has size 1 and the checksum of no bytes. Repeated rows get slots of
    their own. An empty table gives no rows; further columns are ignored. Slots are numbered in (shard, hash bucket) parts,
    whose offsets come from at most shards x SLOT_BUCKETS counts, so no shard is sorted in one task.
    """
    tree = tree or default_tree(n_shards)
    grown = grown or default_tree(n_shards + 1)
    n = sum(len(rack) for region in tree for rack in region)
    k, t = F.col(key), F.coalesce(F.col(text), F.lit(""))
    part = F.pmod(F.xxhash64(k, F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    light = docs.select(k.alias("doc_id")).select("doc_id", shard_of(F.col("doc_id"), tree).alias("shard"), part.alias("part") if key == "doc_id" else F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int").alias("part"))
    counts = light.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most n * SLOT_BUCKETS rows
    offsets = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    rows = docs.select(k.alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), tree), "grown_shard": shard_of(F.col("doc_id"), grown), "part": F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")})
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    small = F.broadcast(offsets) if n * SLOT_BUCKETS <= 1 << 20 else offsets
    return rows.withColumn("rn", within).join(small, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"), "grown_shard"
    )
