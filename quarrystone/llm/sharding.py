"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A key descends region, rack and shard; at each level the child with the smallest draw wins. A shard draws
-ln(u) / weight, u a uniform hash of key and shard; a rack or region draws the least draw of its children over its
own weight. As the least of exponential draws is one with the sum of their rates, a subtree gets keys in proportion
to the weights in it, and its draw changes for no key unless a weight inside changes: when a subtree's weight
changes, keys move only out of or into it, and when a shard is added, keys move into that shard only (law `key`).
The tree follows from the number of shards alone: one shard more is one leaf more.

Defined cases: a null key is one more key value; equal keys go to one shard, and repeated rows of one key and text
get slots one after the other, which of them which is not told apart; a null text has no bytes; a text of any
length counts with all its bytes; an empty table gives an empty result. `place_documents` looks at doc_id and text
only, whatever else there is; `shard_by_key` and `number_in_shard` keep all columns, so columns named as those
that they add, or `_bucket`, `_rank`, `_shard`, `_b`, `_n` and `_start` in `number_in_shard`, raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Shards of a rack and racks of a region.
RACK_SHARDS, REGION_RACKS = 5, 2
#: Rows of a shard that one task numbers, and the most buckets that a shard is dealt into for that.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 8192
OWN_COLUMNS = ("_bucket", "_rank", "_shard", "_b", "_n", "_start")


@dataclass(frozen=True)
class Node:
    """A subtree: its name, a weight of its own, and children or a shard's number."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    weight: float = 1.0


def build_tree(n_shards: int, weights: dict[str, float] | None = None) -> Node:
    """Shards s0, s1, ... in racks k0, k1, ... in regions r0, r1, ...; weights by these names, 1 where none is given."""
    own = weights or {}
    level = [Node(f"s{s}", shard=s, weight=own.get(f"s{s}", 1.0)) for s in range(n_shards)]
    for sign, width in (("k", RACK_SHARDS), ("r", REGION_RACKS)):
        level = [
            Node(f"{sign}{i // width}", tuple(level[i : i + width]), weight=own.get(f"{sign}{i // width}", 1.0)) for i in range(0, len(level), width)
        ]
    return Node("root", tuple(level))


def draw(key: Column, node: Node) -> Column:
    """(d, shard): the node's draw, and the shard in it that the key falls into."""
    if not node.children:
        # u in (0, 1] from 52 bits of a hash of the shard's name and the key.
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 12)
        d = -F.log((bits + F.lit(1)) * F.lit(2.0**-52)) / F.lit(float(node.weight))
        return F.struct(d.alias("d"), F.lit(node.shard).alias("shard"))
    below = [draw(key, c) for c in node.children]
    least = F.least(*below) if len(below) > 1 else below[0]
    return least if node.weight == 1.0 else F.struct((least["d"] / F.lit(float(node.weight))).alias("d"), least["shard"].alias("shard"))


def shard_by_key(df: DataFrame, key: str, tree: Node, name: str) -> DataFrame:
    """df with one more column: the shard that the key falls into."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return df.withColumn(name, draw(F.col(key), tree)["shard"].cast("int"))


def number_in_shard(df: DataFrame, shard: str, by: list[str], name: str, buckets: int) -> DataFrame:
    """df with a number in its shard, gapless from 0, without sorting a whole shard in one task.

    Each shard is dealt into buckets by a hash of `by`; a bucket's first number is the count of the buckets
    before it. The counts are at most shards x MOST_BUCKETS rows, whatever the input, so they are broadcast.
    """
    if {name, *OWN_COLUMNS} & {*df.columns}:
        raise ValueError(f"there is a column {name} or one of {OWN_COLUMNS}")
    buckets = min(buckets, MOST_BUCKETS)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = df.groupBy(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*by))
    return (
        df.withColumn("_rank", rank)
        .join(F.broadcast(starts), (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop(*OWN_COLUMNS)
    )


def place_documents(docs: DataFrame, n_shards: int = 40, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every document.

    Without a number of buckets, a shard has one for each BUCKET_ROWS of its share of the rows, 64 at least.
    """
    if buckets is None:
        buckets = max(64, docs.count() // (n_shards * BUCKET_ROWS))
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_by_key(sized, "doc_id", build_tree(n_shards), "shard")
    placed = shard_by_key(placed, "doc_id", build_tree(n_shards + 1), "grown_shard")
    out = number_in_shard(placed, "shard", ["doc_id", "text_crc32", "size"], "slot", buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
