"""Hierarchical weighted hash tree: documents descend region, rack and shard levels by weighted hash draws.

At each inner node every child draws ``-weight / ln(u)`` with ``u`` a hash of (key, path of the child) in
(0, 1); the largest draw wins, so a child is chosen in proportion to its weight. A draw depends on the key,
the child's path and its weight only. Raising one child's weight therefore moves keys only into that child,
and siblings' subtrees keep all their keys: movement is confined to the subtrees whose weights change.

A shard added as a subtree of its own takes rows from everywhere and only into itself (law ``key``).

Nulls and edges: a null key is hashed as null, so such rows share a shard; a null text has size 1 and
crc32 0; of a very long text only its size and crc32 are moved; repeated rows get the same shard and a slot each; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]

#: Rows of one bucket when slots are dealt, and the bound on the buckets of a shard.
SLOT_ROWS, SLOT_BUCKETS = 64, 65_536


def balanced_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Equal weights: shards in racks of per_rack, racks in regions of `racks`."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region and rack of its own."""
    return {**tree, f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    return F.lit(-weight) / F.log((bits.cast("double") + 0.5) / float(1 << 53))


def descend(key: Column, tree: Tree, path: str = "") -> Column:
    """struct<shard, path> of the leaf that `key` reaches in `tree`."""
    children = [(name, child) for name, child in tree.items() if _weight(child) > 0]
    if not children:
        raise ValueError("a node of the tree has no child of positive weight")

    def leaf(name, child) -> Column:
        here = f"{path}/{name}"
        if isinstance(child, dict):
            return descend(key, child, here)
        return F.struct(F.lit(int(name)).alias("shard"), F.lit(here).alias("path"))

    if len(children) == 1:
        return leaf(*children[0])
    draws = [F.struct(_draw(key, f"{path}/{n}", _weight(c)).alias("draw"), F.lit(i).alias("child")) for i, (n, c) in enumerate(children)]
    won = F.greatest(*draws)["child"]
    return reduce(lambda chosen, i: chosen.when(won == i, leaf(*children[i])), range(1, len(children)), F.when(won == 0, leaf(*children[0])))


def assign_shards(docs: DataFrame, tree: Tree, new_shard: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its size, crc32, shard and place in the shard now, and its shard in the grown tree.

    Slots are dealt without sorting a shard in one task: rows are numbered inside buckets of a shard and the bucket's
    offset is added. The law fixes a row's shard, not its slot, so buckets are drawn by the row's number, not its key:
    rows of one key, null included, are spread like all others. Only the key, size and crc32 are written and shuffled,
    never the text; the rows are read once, and their numbers are fixed by the table they are written to.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    now, later = descend(F.col(key), tree), descend(F.col(key), grown(tree, new_shard))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content).alias("text_crc32"),
        now["shard"].alias("shard"),
        F.substring_index(now["path"], "/", 3).alias("place"),
        later["shard"].alias("grown_shard"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = cut(rows, "shard-rows")
    buckets = min(SLOT_BUCKETS, rows.count() // SLOT_ROWS + 1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # At most SLOT_BUCKETS rows a shard, whatever the input.
    offsets = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    numbered = rows.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("number")) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inside")).alias("slot"), "grown_shard", "place"
    )
