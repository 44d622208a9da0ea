"""Layered layout of components too large for one task, as iterated joins.

The steps are those of ``layout.layered``, each over all large components at once and
written to the shared folder: ranks by peeling sources (longest paths; where only
cycles are left, the nodes that lead most among their neighbours become sources, so a
graph without cycles keeps every direction), tightening towards short edges, orders by
barycentres of the neighbouring ranks, and positions by running sums. Other than there,
all ranks of a sweep are ordered at the same time, edges over several ranks pull
directly, and each rank is centred instead of being swept to medians. Peeling takes as
many rounds as the longest path has nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.model import CanvasOptions
from weftwork.session import written

KEY = ["graph_id", "component"]
#: Passes of tightening and of ordering; the last of these goes by the ranks before.
TIGHTEN, SWEEPS = 4, 9


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each within ``keys`` in ``order``.

    Sorted by range, so that a group of any size is spread over tasks; the sums of a
    group's parts are added up by group, at most one row a partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(rows.withColumn("_v", value.cast("bigint")).repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return inner.join(sums, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_v", "_part", "_before", "_in")


def peeled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``KEY, id, rank``, edges ``KEY, a, b`` that all lead to a later rank)."""
    left = written(edges.select(*KEY, "a", "b").distinct(), "peel")
    n, heads, kept, k = left.count(), [], [], 0
    while n:
        to = left.select(*KEY, F.col("b").alias("a")).distinct()
        flagged = written(left.join(to.withColumn("in", F.lit(True)), [*KEY, "a"], "left").withColumn("in", F.col("in").isNotNull()), "peel")
        after = flagged.where("in").count()
        if after == n:
            left = written(_opened(left), "peel")
            n = left.count()
            continue
        k += 1
        # edges whose source has its rank: their heads stand at least one rank on
        gone = flagged.where("not in")
        kept.append(gone.select(*KEY, "a", "b"))
        heads.append(gone.select(*KEY, F.col("b").alias("id"), F.lit(k).alias("rank")))
        left, n = flagged.where("in").select(*KEY, "a", "b"), after
        if len(heads) == 20:
            heads, kept = [written(_all(heads), "heads")], [written(_all(kept), "kept")]
    none = nodes.select(*KEY, "id", F.lit(0).alias("rank"))
    ranked = _all([none, *heads]).groupBy(*KEY, "id").agg(F.max("rank").alias("rank"))
    return written(ranked, "ranks"), written(_all(kept), "directed") if kept else left


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _opened(edges: DataFrame) -> DataFrame:
    """``edges``, those turned round that lead to a node with more edges out than in, relative to all its neighbours.

    No two such nodes are neighbours, and each component that is left has one.
    """
    ends = edges.select(*KEY, F.col("a").alias("id"), F.lit(1).alias("d")).unionByName(edges.select(*KEY, F.col("b").alias("id"), F.lit(-1).alias("d")))
    weight = ends.groupBy(*KEY, "id").agg(F.struct(F.sum("d").alias("d"), F.col("id").alias("by")).alias("w"))
    both = edges.select(*KEY, F.col("a").alias("id"), F.col("b").alias("o")).unionByName(edges.select(*KEY, F.col("b").alias("id"), F.col("a").alias("o")))
    near = both.join(weight.select(*KEY, F.col("id").alias("o"), F.col("w").alias("ow")), [*KEY, "o"]).groupBy(*KEY, "id").agg(F.max("ow").alias("ow"))
    first = weight.join(near, [*KEY, "id"]).where("w > ow").select(*KEY, F.col("id").alias("b"), F.lit(True).alias("turn"))
    turned = edges.join(first, [*KEY, "b"], "left")
    return turned.select(*KEY, F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def tightened(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranks moved towards the side with more edges: in one pass all onwards, in the next all back, so no edge turns."""
    for k in range(TIGHTEN):
        end, other, best = ("a", "b", F.min) if k % 2 == 0 else ("b", "a", F.max)
        theirs = edges.join(ranked.select(*KEY, F.col("id").alias(other), "rank"), [*KEY, other])
        pull = theirs.groupBy(*KEY, F.col(end).alias("id")).agg(best("rank").alias("goal"), F.count("*").alias("n"))
        against = edges.groupBy(*KEY, F.col(other).alias("id")).agg(F.count("*").alias("m"))
        moved = F.col("n") > F.coalesce("m", F.lit(0))
        goal = F.col("goal") + (-1 if end == "a" else 1)
        ranked = written(ranked.join(pull, [*KEY, "id"], "left").join(against, [*KEY, "id"], "left").select(*KEY, "id", F.when(moved, goal).otherwise(F.col("rank")).cast("int").alias("rank")), "tight")
    return ranked


def ordered(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """``KEY, id, rank, nth``: the order within each rank."""
    layer = [*KEY, "rank"]
    sizes = written(ranked.groupBy(*layer).agg(F.count("*").alias("size")), "sizes")
    at = written(running(ranked, layer, ["id"], F.lit(1), "nth"), "order")
    for k in range(SWEEPS):
        end, other = ("b", "a") if k % 2 == 0 else ("a", "b")
        place = at.join(sizes, layer).select(*KEY, "id", ((F.col("nth") + 0.5) / F.col("size")).alias("at"))
        near = edges.join(place.withColumnRenamed("id", other), [*KEY, other]).groupBy(*KEY, F.col(end).alias("id")).agg(F.round(F.avg("at"), 9).alias("pull"))
        goals = place.join(near, [*KEY, "id"], "left").select(*KEY, "id", F.coalesce("pull", "at").alias("goal"))
        at = written(running(at.withColumnRenamed("nth", "old").join(goals, [*KEY, "id"]), layer, ["goal", "old"], F.lit(1), "nth").select(*layer, "id", "nth"), "order")
    return at


def wide_layered(boxes: DataFrame, edges: DataFrame, options: CanvasOptions) -> DataFrame:
    """``KEY, id, x, y, c_width, c_height`` of components; ``boxes``: ``KEY, id, width, height``, ``edges``: ``KEY, a, b``."""
    across = options.rankdir in ("LR", "RL")
    depth, span = ("width", "height") if across else ("height", "width")
    ranked, directed = peeled(boxes, edges)
    ranked = ranked if options.ranker == "longest-path" else tightened(ranked, directed)
    at = ordered(ranked, directed).join(boxes, [*KEY, "id"])
    layer = [*KEY, "rank"]
    at = written(running(at, layer, ["nth"], F.col(span) + options.nodesep, "along"), "along")
    layers = at.groupBy(*layer).agg(F.max(depth).alias("deepest"), (F.sum(F.col(span) + options.nodesep) - options.nodesep).alias("long"))
    layers = written(running(layers, KEY, ["rank"], F.col("deepest") + options.ranksep, "start"), "layers")
    whole = layers.groupBy(*KEY).agg(F.max(F.col("start") + F.col("deepest")).alias("total"), F.max("long").alias("longest"))
    done = at.join(layers, layer).join(whole, KEY)
    start = F.col("start") if options.rankdir in ("LR", "TB") else F.col("total") - F.col("start") - F.col("deepest")
    main = (start + F.floor((F.col("deepest") - F.col(depth)) / 2)).cast("int")
    cross = (F.col("along") + F.floor((F.col("longest") - F.col("long")) / 2)).cast("int")
    x, y, w, h = (main, cross, "total", "longest") if across else (cross, main, "longest", "total")
    return done.select(*KEY, "id", x.alias("x"), y.alias("y"), F.col(w).cast("int").alias("c_width"), F.col(h).cast("int").alias("c_height"))
