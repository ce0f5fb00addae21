"""Connected components of an edge list, by alternating stars.

Edges hang ever more directly on the smallest node of their component (the large-star and small-star steps of
Kiveris et al., 2014); their number never grows. A node's smallest neighbour is a grouped minimum that is combined
before the shuffle, and it is joined back by an equi-join that adaptive execution can split, so a node with very
many neighbours is no single task. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(nodes: DataFrame, smaller: bool) -> DataFrame:
    """One star step over (u, v) rows."""
    both = nodes.where("v < u") if smaller else nodes.unionByName(nodes.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if smaller:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60, cut=cut) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge, from columns a and b. `cut` writes a round's table."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    before = mark(now)
    for _ in range(rounds):
        now = cut(_star(_star(now, smaller=False), smaller=True), "edges")
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct().toDF("node", "root"))
        before = after
    raise RuntimeError(f"components: not settled after {rounds} rounds")
