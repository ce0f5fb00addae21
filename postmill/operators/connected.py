"""Connected sets of a list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root_form (the smallest node that it is connected with) of every node of the edges (a, b), which go both ways.

    Each round a node takes the least label of its neighbours, then the label of its label, so labels cover twice the way each
    time. A round is one aggregate and two joins over narrow rows, written to the shared folder; it ends when none changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, "a").select("a", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumped = least.join(labels.select(F.col("a").alias("label"), F.col("label").alias("on")), "label", "left")
        now = stored(jumped.select("a", "was", F.least("label", F.coalesce("on", "label")).alias("label")), "labels")
        if not now.where("label <> was").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("label").alias("root_form"))
        labels = now.select("a", "label")
    raise RuntimeError(f"labels have not settled after {rounds} rounds")
