"""Sharding (10): a weighted hash tree of regions, racks and shards.

A row descends from the root: at each node every child draws -ln(u) / weight with u a hash of the key and the child's
name, and the smallest draw wins, so a child gets rows in proportion to its weight. A changed weight changes that
child's draw alone: rows move into it or out of it and nowhere else at that level. A whole new subtree therefore takes
rows only into itself.

All of it is built-in expressions: a row's shard needs no shuffle, and slots are numbered from counts per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


#: Rows that are numbered in one piece, about.
ROWS = 250_000


@dataclass(frozen=True)
class Node:
    """name: unique among all nodes, kept for life. A leaf has a shard number, an inner node children."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())


def tree(shards: int, base: int = 16, per_rack: int = 4, racks_per_region: int = 2) -> Node:
    """Up to base shards fill racks and regions evenly; each one more is a region of its own, so that growing by one
    shard changes the weights of no older subtree. A node weighs as much as the shards below it."""
    first = min(shards, base)
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(first):
        rack = s // per_rack
        regions.setdefault(rack // racks_per_region, {}).setdefault(rack, []).append(Node(f"shard{s}", 1.0, s))
    tops = [
        Node(f"region{r}", float(sum(map(len, racks.values()))), None, tuple(Node(f"rack{k}", float(len(leaves)), None, tuple(leaves)) for k, leaves in racks.items()))
        for r, racks in regions.items()
    ]
    tops += [Node(f"region+{s}", 1.0, None, (Node(f"rack+{s}", 1.0, None, (Node(f"shard{s}", 1.0, s),)),)) for s in range(first, shards)]
    return Node("root", float(shards), None, tuple(tops))


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def _draw(key: Column, node: Node) -> Column:
    # 52 bits and a half, over 2^52: never 0 or 1
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(node.weight)


def shard_of(key: Column, node: Node) -> Column:
    """The shard that key descends to; children with a weight of 0 get nothing. A null key is one key like any other."""
    if node.shard is not None:
        return F.lit(node.shard)
    open_ = [c for c in node.children if c.weight > 0]
    if len(open_) == 1:
        return shard_of(key, open_[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(open_)]))["i"]
    out = F.when(F.lit(False), F.lit(0))
    for i, c in enumerate(open_):
        out = out.when(best == i, shard_of(key, c))
    return out


def assign(df: DataFrame, key: str, root: Node, grown: Node | None = None, buckets: int | None = None) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and grown_shard (null without a grown tree).

    Slots follow (bucket, key) in a shard, the bucket being a hash of all columns, so that rows of one key, or without
    one, are dealt to many; rows of one key follow another hash. A shard's rows are numbered in `buckets` pieces at once,
    by default as many as give a piece ROWS rows or so: counts by piece (a row for each ROWS rows, hence broadcast) give
    each its start. An empty table gives an empty result; other columns pass through, so the names added must not be among them.
    """
    clash = {"shard", "slot", "grown_shard", "_bucket", "_start"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are names that assign() adds; rename them first")
    k, every = F.col(key), [F.col(c) for c in df.columns]
    if buckets is None:
        buckets = max(16, -(-df.count() // (ROWS * max(1, len(leaves(root))))))
    placed = df.withColumns({
        "shard": shard_of(k, root).cast("int"),
        "grown_shard": (shard_of(k, grown) if grown is not None else F.lit(None)).cast("int"),
        "_bucket": F.pmod(F.xxhash64(F.lit("bucket"), *every), F.lit(buckets)).cast("int"),
    })
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, F.xxhash64(*every))
    numbered = placed.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return numbered.join(F.broadcast(starts), ["shard", "_bucket"]).withColumn("slot", F.col("slot") + F.col("_start")).drop("_bucket", "_start")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the key law. A null text has size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign(rows, "doc_id", tree(16), tree(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
