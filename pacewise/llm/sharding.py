"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path,
and the smallest draw wins, so a child receives its share of the weight. A
child's draw depends on nothing but the key and that child: when weights change
inside one subtree, a row moves only into (weight up) or out of (weight down)
that subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pacewise.llm.common import stage, text_or_empty


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class ShardTree:
    """The leaves of a region / rack / shard tree; the cluster's configuration, at most some hundred leaves."""

    leaves: tuple[Leaf, ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> ShardTree:
        """``regions`` x ``racks`` x ``shards`` equal leaves, numbered in order."""
        names = [(f"g{g}", f"r{r}") for g in range(regions) for r in range(racks) for _ in range(shards)]
        return ShardTree(tuple(Leaf(g, r, i) for i, (g, r) in enumerate(names)))

    def grown(self, weight: float = 1.0) -> ShardTree:
        """One more shard, in a region of its own: only the root's choice changes, so rows move only into it."""
        n = max(x.shard for x in self.leaves) + 1
        return ShardTree((*self.leaves, Leaf(f"new{n}", "r0", n, weight)))

    def reweighted(self, shard: int, weight: float) -> ShardTree:
        return ShardTree(tuple(Leaf(x.region, x.rack, x.shard, weight if x.shard == shard else x.weight)
                               for x in self.leaves))

    def shard_of(self, key: Column) -> Column:
        """The shard (int) that ``key`` descends to, as one expression without a lookup."""

        def descend(leaves: list[Leaf], depth: int) -> Column:
            if depth == 3:
                return F.lit(leaves[0].shard)
            children: dict[str, list[Leaf]] = {}
            for x in leaves:
                if x.weight > 0:
                    children.setdefault((x.region, x.rack, str(x.shard))[depth], []).append(x)
            if len(children) == 1:
                return descend(*children.values(), depth + 1)
            draws = []
            for i, below in enumerate(children.values()):
                x = below[0]
                path = "/".join((x.region, x.rack, str(x.shard))[:depth + 1])
                u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11) + 1) / F.lit(float(1 << 53))
                draws.append(F.struct((-F.ln(u) / F.lit(sum(y.weight for y in below))).alias("draw"), F.lit(i).alias("i")))
            won = F.least(*draws)["i"]
            out = None
            for i, below in enumerate(children.values()):
                out = (F.when if out is None else out.when)(won == i, descend(below, depth + 1))
            return out

        if not any(x.weight > 0 for x in self.leaves):
            raise ValueError("a tree needs a leaf of positive weight")
        return descend(list(self.leaves), 0).cast("int")


def gapless_slots(df: DataFrame, part: str, order: list[str], slot: str = "slot", rows_per_task: int = 32768) -> DataFrame:
    """Number the rows of each ``part`` from 0 without a gap, without sorting a part in one task.

    ``df`` must be a staged table. Rows fall into hash buckets of about
    ``rows_per_task`` rows, get a row number inside (part, bucket), and the
    bucket's offset, a running sum over the (part, bucket) counts.
    """
    buckets = max(1, df.count() // rows_per_task)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = spread.groupBy(part, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(part, "_bucket").orderBy(*order)) - 1
    return (spread.withColumn("_at", inside).join(offsets, [part, "_bucket"])
            .withColumn(slot, (F.col("_at") + F.col("_offset")).cast("long")).drop("_bucket", "_n", "_at", "_offset"))


def assign_shards(docs: DataFrame, tree: ShardTree, grown: ShardTree | None = None) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) on a shard of ``tree``; the law is ``key``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. doc_id and
    the tree alone decide the shard. A null text has size 1 and the checksum of
    the empty text; null doc_ids share one shard; repeated rows get slots of
    their own. An empty table gives no rows.
    """
    text = text_or_empty()
    placed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                         F.lit("key").alias("law"), tree.shard_of(F.col("doc_id")).alias("shard"),
                         (grown or tree.grown()).shard_of(F.col("doc_id")).alias("grown_shard"))
    return gapless_slots(stage(placed, "shards"), "shard", ["doc_id", "text_crc32", "size"])
