"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Only DataFrame functions run on the rows.  At each level every child of the node reached so far draws
-ln(u) / weight, with u a hash of the key and the child's name in (0, 1), and the smallest draw wins.  That chooses
children in proportion to their weights, and a draw depends on nothing but the key, the child's name and weight:

* a changed weight changes draws of that child only, so keys move only between it and its siblings, inside the
  subtree whose weights change;
* a new child wins keys only for itself.  ``grown`` therefore adds a shard as a region of its own: keys move
  into the new shard and nowhere else (law ``key``: doc_id and the shards decide).

Defined results: a null doc_id is a key of its own.  A null text has no bytes and the CRC 0.  Repeated rows and ties
share a shard and get slots of their own.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, utf8_crc32

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
REGIONS, RACKS, PER_RACK = 2, 2, 2


def tree_of(shards: int) -> Tree:
    """The tree of a number of shards: two regions of two racks of two; each further shard is grown."""
    base = REGIONS * RACKS * PER_RACK
    out: Tree = {}
    for s in range(min(shards, base)):
        region, rack = s // (RACKS * PER_RACK), s // PER_RACK % RACKS
        out.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    for _ in range(base, shards):
        out = grown(out)
    return out


def grown(tree: Tree, weight: float | None = None) -> Tree:
    """The tree with one more shard, in a region of its own, of the mean weight by default."""
    leaves = {s: w for racks in tree.values() for shards in racks.values() for s, w in shards.items()}
    new = max(leaves, default=-1) + 1
    share = weight if weight is not None else sum(leaves.values()) / len(leaves) if leaves else 1.0
    return {**tree, f"region-of-{new}": {"rack": {new: share}}}


def _levels(tree: Tree) -> Iterator[dict[str, list[tuple[str, float]]]]:
    """For each level: parent's path -> (child's path, weight); a node weighs what its shards weigh."""
    yield {"": [(r, sum(w for rack in racks.values() for w in rack.values())) for r, racks in tree.items()]}
    yield {r: [(f"{r}/{k}", sum(rack.values())) for k, rack in racks.items()] for r, racks in tree.items()}
    yield {f"{r}/{k}": [(f"{r}/{k}/{s}", w) for s, w in rack.items()] for r, racks in tree.items() for k, rack in racks.items()}


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: three weighted draws among the children of the node reached."""
    node = F.lit("")
    for level in _levels(tree):
        children = F.create_map(*(x for parent, below in level.items() for x in (
            F.lit(parent), F.array(*(F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in below if w > 0)))))

        def draw(child: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

        node = F.array_min(F.transform(F.element_at(children, node), draw))["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def sharded(docs: DataFrame, shards: int = 8, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row."""
    tree = tree or tree_of(shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), utf8_crc32(text).alias("text_crc32"),
                       F.lit("key").alias("law"), shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"))
    return (numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7, and where they were with one more."""
    return sharded(table(spark, sf_dir, "documents"))
