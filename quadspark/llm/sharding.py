"""Sharding: a hierarchical weighted hash tree over regions, racks and shards."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered


@dataclass(frozen=True)
class Node:
    """A leaf (a shard with its number) or an inner node; the weight of an inner node is the sum below it."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight

    def shards(self) -> list[int]:
        return [self.shard] if not self.children else [s for c in self.children for s in c.shards()]


def topology(shards: int = 16, per_rack: int = 2, racks: int = 2) -> Node:
    """Shards 0 to n - 1 in racks of `per_rack`, racks in regions of `racks`."""
    rack = [Node(f"rack{i}", tuple(Node(f"shard{s}", shard=s) for s in range(i * per_rack, min(shards, (i + 1) * per_rack)))) for i in range(-(-shards // per_rack))]
    return Node("root", tuple(Node(f"region{i}", tuple(rack[i * racks : (i + 1) * racks])) for i in range(-(-len(rack) // racks))))


def grown(tree: Node) -> Node:
    """One more shard, as a region and rack of its own: no other subtree's weight changes, so rows move only into it."""
    s = max(tree.shards()) + 1
    region = Node(f"region+{s}", (Node(f"rack+{s}", (Node(f"shard{s}", shard=s),)),))
    return replace(tree, children=(*tree.children, region))


def place(key: Column, tree: Node) -> Column:
    """Shard of a key: from the root down, the child with the least weighted draw -ln(u) / weight.

    u is a hash of key and child alone; a child's draw moves only with its own weight, which confines movement to the
    subtrees whose weights change.  A null key has a place of its own kind (the hash of null), the same for all of them.
    """
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(key, tree.children[0])
    draws = []
    for i, c in enumerate(tree.children):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(c.name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(c.weight))).alias("d"), F.lit(i).alias("i")))
    pick = F.array_min(F.array(*draws))["i"]
    out = place(key, tree.children[-1])
    for i in reversed(range(len(tree.children) - 1)):
        out = F.when(pick == i, place(key, tree.children[i])).otherwise(out)
    return out


def _key(df: DataFrame, id_col: str) -> Column:
    """The id as it is hashed: integers of any width by their value."""
    return F.col(id_col).cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.col(id_col)


def shard_documents(docs: DataFrame, tree: Node, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """Deals documents to the shards of a tree.

    Returns id, size (UTF-8 bytes plus 1; 1 for a null text), text_crc32 (0 for a null or empty text), law (`key`), shard, slot
    (gapless from 0 in each shard) and grown_shard (with one more shard).  Repeated ids share a shard and get slots of
    their own; rows with a null id go to one shard.  An integer id has the same shard whatever its type's width.  Other columns of the input are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = out.withColumns({"law": F.lit("key"), "shard": place(_key(out, "doc_id"), tree).cast("int"), "grown_shard": place(_key(out, "doc_id"), grown(tree)).cast("int")})
    out = numbered(out, ["shard"], ["doc_id", "text_crc32", "size"], "slot", F.struct("doc_id", "text_crc32"), buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Node, path: str, id_col: str = "doc_id") -> None:
    """Writes whole documents as Parquet with one folder for each shard; each task writes its part of every shard."""
    docs.withColumn("shard", place(_key(docs, id_col), tree).cast("int")).write.partitionBy("shard").parquet(path)
