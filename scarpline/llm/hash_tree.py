"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

The tree has regions, racks and shards. Every shard draws an exponential
number with its weight as rate from a hash of the row's key; a rack's draw is
the smallest of its shards and a region's the smallest of its racks, so the
draw of a subtree has the subtree's weight as rate. A row descends to the
region, then the rack, then the shard with the smallest draw. When a weight
changes, only rows that enter or leave the changed subtree move; a new shard
takes rows only into itself.

Slots are gapless per shard and need no sort of a whole shard: rows are
numbered inside (shard, input partition), and counts give each such group its
offset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scarpline.llm import common


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, rack_size: int = 4, region_size: int = 16) -> list[Leaf]:
    """Shards of weight one, filled rack by rack and region by region."""
    return [Leaf(s // region_size, s // rack_size, s) for s in range(shards)]


def _draw(leaf: Leaf, key: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(leaf.shard)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.log(u) / F.lit(leaf.weight)).alias("draw"), F.lit(leaf.shard).alias("shard"))


def _least(draws: list[Column]) -> Column:
    return F.array_min(F.array(*draws))


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key."""
    leaves = [leaf for leaf in tree if leaf.weight > 0]
    regions = []
    for region in sorted({leaf.region for leaf in leaves}):
        racks = []
        for rack in sorted({leaf.rack for leaf in leaves if leaf.region == region}):
            racks.append(_least([_draw(leaf, key) for leaf in leaves if (leaf.region, leaf.rack) == (region, rack)]))
        regions.append(_least(racks))
    return _least(regions)["shard"]


def shard_rows(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Place every row, with its shard when one more shard exists.

    Size is the UTF-8 length of the text (NULL: none) plus 16. A NULL id is
    placed by the checksum and size of its text. Repeated rows share a shard
    and get slots of their own. No rows give no rows. Other columns are not
    read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), common.whole(text).cast("binary").alias("_bytes")).select(
        "doc_id",
        (F.octet_length("_bytes") + 16).cast("long").alias("size"),
        F.crc32("_bytes").alias("text_crc32"),
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_row"),
    )
    key = F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))), F.lit(0))
    key = F.when(F.col("doc_id").isNotNull(), key).otherwise(F.xxhash64("text_crc32", "size"))
    rows = rows.withColumn("_key", key)
    rows = rows.withColumn("shard", place(F.col("_key"), even_tree(shards)))
    rows = rows.withColumn("grown_shard", place(F.col("_key"), even_tree(shards + 1))).drop("_key")
    group = ["shard", "_part"]
    inside = Window.partitionBy(*group).orderBy("doc_id", "text_crc32", "size", "_row")
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_nth", F.row_number().over(inside) - 1)
    return numbered.join(offsets, group).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_nth") + F.col("_before")).cast("long").alias("slot"), "grown_shard",
    )
