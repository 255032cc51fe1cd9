"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) never span shards. Items enter, largest first, the shard with the tightest
remaining capacity that still holds them, found in a balanced tree. With a given number of
shards, an item that fits nowhere goes to the emptiest shard; without one, a new shard is opened.

One packing of all groups would pass everything through one process. Only groups of at least
1/ITEMS of all bytes (so at most ITEMS of them) are items of their own; all other groups are
gathered, by hash, into ITEMS bundles of whole groups, and the bundles are the remaining items.
The packing itself then sees at most 2 * ITEMS items at any size of the input; with a given capacity,
2 * PER_SHARD for each shard where that is more.

Null texts count no bytes and form one group; empty texts another. Repeated rows are documents of
their own. A group larger than a shard's share keeps its shard to itself as far as possible.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import gapless
from provlake.session import cut_lineage

ITEMS = 2048
#: With a capacity: least bundles for each shard, so that bundles stay well below the capacity.
PER_SHARD = 16


class Tree:
    """A balanced search tree (treap) over (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key) -> int:
        return zlib.crc32(repr(key).encode())

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def _insert(self, node, key):
        if node is None:
            return [key, self._rank(key), None, None]
        side = 2 if key < node[0] else 3
        node[side] = child = self._insert(node[side], key)
        if child[1] > node[1]:  # rotate the child up
            other = 5 - side
            node[side], child[other] = child[other], node
            return child
        return node

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, node, key):
        if node[0] == key:
            return self._merge(node[2], node[3])
        side = 2 if key < node[0] else 3
        node[side] = self._remove(node[side], key)
        return node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def ceiling(self, key):
        """The smallest key that is at least ``key``, or None."""
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def largest(self):
        node = self.root
        while node and node[3]:
            node = node[3]
        return node and node[0]


def best_fit_decreasing(items: list[tuple[object, int]], capacity: int,
                        bins: int | None = None) -> dict[object, int]:
    """Item -> bin. Larger items first, ties in the order of their names."""
    tree, placed, opened = Tree(), {}, bins or 0
    for b in range(opened):
        tree.insert((capacity, -b))
    for name, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        at = tree.ceiling((size, -opened))
        if at is None and bins is None:
            at = (capacity, -opened)
            opened += 1
        else:
            at = at or tree.largest()
            tree.remove(at)
        placed[name] = -at[1]
        tree.insert((at[0] - size, at[1]))
    return placed


def shard(docs: DataFrame, shards: int = 8, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row, sizes near equal.

    With a ``capacity`` in bytes, ``shards`` is not used: as few shards are opened as the packing
    needs, none above the capacity but those of a single larger group.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    narrow = cut_lineage(docs.select(
        "doc_id", F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5("text")).alias("_group")))
    groups = narrow.groupBy("_group").agg(F.sum("size").alias("bytes"))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    bundles = ITEMS if capacity is None else max(ITEMS, PER_SHARD * -(-total // capacity))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles))
    item = F.when(F.col("bytes") >= -(-total // bundles), F.concat(F.lit("g"), F.col("_group"))).otherwise(
        F.concat(F.lit("b"), bundle.cast("string")))
    items = [(r[0], r[1]) for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes")).collect()]
    if capacity is None:
        placed = best_fit_decreasing(items, -(-total // shards), shards)
    else:
        placed = best_fit_decreasing(items, capacity)
        shards = max(placed.values(), default=0) + 1
    big = spark.createDataFrame([(k[1:], v) for k, v in placed.items() if k[0] == "g"],
                                "_group string, _big int")
    small = spark.createDataFrame([(int(k[1:]), v) for k, v in placed.items() if k[0] == "b"],
                                  "_bundle long, _small int")
    rows = (narrow.withColumn("_bundle", bundle)
            .join(F.broadcast(big), "_group", "left").join(F.broadcast(small), "_bundle", "left")
            .withColumn("shard", F.coalesce("_big", "_small")))
    return gapless(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot",
                   min(1024, max(1, 8192 // shards))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
