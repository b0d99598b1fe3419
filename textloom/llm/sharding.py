"""Placement of rows on shards by a hierarchical weighted hash tree.

Native: DataFrame functions only.

The tree has regions, racks and shards; a node weighs what its shards weigh.
A row descends it: at each level every child draws ``-ln(u) / weight`` with u a
hash of (key, child) in (0, 1), and the smallest draw wins, so a child is chosen
in proportion to its weight.  A child's draw depends on that child alone;
changing a weight changes no comparison between other children, and rows move
only into or out of the subtrees whose weights change.  :func:`tree` fills rack by
rack and region by region, so that with 24 shards two regions are full and shard
24 opens a region of its own: rows move only into it (law ``key``).

Only the key (and the tree) decides the shard.  Slots number the rows of a shard
from 0 without gaps.  They are counted in two steps, per (shard, block) and then
over the blocks, whose number is a parameter, so no task holds a whole shard.

Defined results: a null key hashes as its own value; a null text has no bytes and
CRC 0; repeated rows get the same shard and different slots; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (region, rack, shard, weight)
Leaf = tuple[int, int, int, float]


def tree(shards: int, per_rack: int = 4, racks_per_region: int = 3, weights: Sequence[float] | None = None) -> list[Leaf]:
    """A tree of ``shards`` leaves, filled in order."""
    weights = weights or [1.0] * shards
    return [(s // (per_rack * racks_per_region), s // per_rack, s, float(weights[s])) for s in range(shards)]


def _draw(key: Column, label: str, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(label)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / F.lit(weight)


def _choose(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """The child of smallest draw; equal draws go to the smaller number."""
    live = [c for c in children if c[2] > 0]
    if len(live) == 1:
        return F.lit(live[0][1])
    draws = [F.struct(_draw(key, label, weight).alias("d"), F.lit(number).alias("n")) for label, number, weight in live]
    return F.least(*draws)["n"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a row with this key."""
    regions: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in leaves:
        if leaf[3] > 0:
            regions.setdefault(leaf[0], {}).setdefault(leaf[1], []).append(leaf)
    if not regions:
        raise ValueError("a tree needs a shard of positive weight")
    weigh = lambda racks: sum(x[3] for r in racks.values() for x in r)
    region = _choose(key, [(f"region/{r}", r, weigh(racks)) for r, racks in regions.items()])
    out = None
    for r, racks in regions.items():
        rack = _choose(key, [(f"rack/{r}/{k}", k, sum(x[3] for x in own)) for k, own in racks.items()])
        inner = None
        for k, own in racks.items():
            shard = _choose(key, [(f"shard/{r}/{k}/{x[2]}", x[2], x[3]) for x in own])
            inner = shard if inner is None else F.when(rack == k, shard).otherwise(inner)
        out = inner if out is None else F.when(region == r, inner).otherwise(out)
    return out.cast("int")


def shard_rows(
    docs: DataFrame,
    leaves: list[Leaf],
    grown: list[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int = 512,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with ``grown``, the shard under that tree."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, leaves).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int").alias("_block"),
    )
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # At most shards * blocks rows, both of them parameters.
    local = F.row_number().over(W.partitionBy("shard", "_block").orderBy(id_col, "text_crc32", "size"))
    numbered = rows.withColumn("_nth", local)
    joined = numbered.join(F.broadcast(starts), ["shard", "_block"])
    return joined.select(
        id_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"), "grown_shard"
    )
