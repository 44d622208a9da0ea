"""Connected components of one large undirected graph.

Every vertex takes the smallest label among its neighbours, with it goes the tree of
vertices that shared its label, and labels take the label of their label (pointer
jumping), until nothing changes; labels only fall, and trees merge each round. Labels
are aggregated with partial minima, so neither a hub nor a tree is ever collected. Each round is written into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import shuffled, written


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``vertex, component`` for every end of ``edges`` (``src``, ``dst``); the component is its smallest vertex.

    Null ends are ignored, repeated edges and self-loops do no harm, no edges give
    no rows. Labels compare as Spark compares the type of the ends.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    both = written(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = written(both.groupBy("src").agg(F.min("dst").alias("n")).select(F.col("src").alias("vertex"), F.least("src", "n").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(shuffled(labels.select(F.col("vertex").alias("dst"), F.col("component").alias("theirs"))), "dst")
            .groupBy(F.col("src").alias("vertex"))
            .agg(F.min("theirs").alias("theirs"))
        )
        seen = labels.join(shuffled(near), "vertex").select("vertex", "component", F.least("component", "theirs").alias("theirs"))
        # a whole tree moves where any of its vertices sees a smaller label; labels that are their own root and see
        # none need no lookup, so the vertices of a giant component meet no hot key once it is one
        moved = seen.where("theirs < component").select("component", F.col("theirs").alias("root"))
        jumps = labels.where("vertex <> component").select(F.col("vertex").alias("component"), F.col("component").alias("root"))
        roots = moved.unionByName(jumps).groupBy("component").agg(F.min("root").alias("root"))
        hooked = written(seen.join(shuffled(roots), "component", "left").select("vertex", F.col("component").alias("old"), F.least("theirs", "root").alias("component")), "labels")
        labels = hooked.select("vertex", "component")
        if hooked.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
