"""References to records that do not exist.

An end of an edge is good if a node row of the same graph with exactly that id had
arrived when the edge row arrived and was not deleted by then. Everything else that
is neither null nor blank dangles.

The keys ``(graph_id, id)`` are dictionary-encoded: a hash picks a key range, the
rank within the range is the code. For each range, container of 32,768 codes and
period one bitmap holds the keys referred to and one the keys whose parent surely
covers the period's references (a row never deleted that came before the first of
them). Reference AND-NOT parent leaves few bits; these are decoded to keys, and the
edge rows behind them are checked exactly against the node rows. Bitmaps are as many
as ranges x periods, whatever the number of rows; hot keys are reduced to one row a
period before the shuffle by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.functions.text import has_text

#: Codes a container holds; the size of Spark's bitmaps.
CONTAINER = 32_768


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(refs: pd.Series, parents: pd.Series) -> pd.Series:
    def positions(a: bytes, b: bytes) -> np.ndarray:
        left = np.frombuffer(a, np.uint8) & ~np.frombuffer(b, np.uint8)
        return np.flatnonzero(np.unpackbits(left, bitorder="little")).astype(np.int32)

    return pd.Series([positions(a, b) for a, b in zip(refs, parents, strict=True)])


def edge_ends(edges: DataFrame) -> DataFrame:
    """One row for each end that is neither null nor blank: ``edge_key, ref_end, graph_id, ref, at``."""
    ends = F.array(*(F.struct(F.lit(c).alias("ref_end"), F.col(c).alias("ref")) for c in ("source", "target")))
    return (
        edges.select("edge_key", "graph_id", F.col("arrived_at").alias("at"), F.explode(ends).alias("end"))
        .select("edge_key", "end.ref_end", "graph_id", "end.ref", "at")
        .where(has_text(F.col("ref")))
    )


def suspect_keys(nodes: DataFrame, ends: DataFrame, period: str = "month", ranges: int | None = None) -> DataFrame:
    """Keys and periods whose references no undeleted row surely covers: ``graph_id, ref, period``.

    Without ``ranges`` there are as many as keep a range within a container of codes for
    the number of node rows, so that no task sorts more than that, whatever the size.
    """
    ranges = ranges or max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // (CONTAINER // 2)))
    uses = ends.groupBy("graph_id", "ref", F.date_trunc(period, "at").alias("period")).agg(F.min("at").alias("first_at"))
    births = (
        nodes.where("graph_id is not null and id is not null and arrived_at is not null and deleted_at is null")
        .groupBy("graph_id", F.col("id").alias("ref"))
        .agg(F.min("arrived_at").alias("birth"))
    )
    both = uses.withColumn("birth", F.lit(None).cast(births.schema["birth"].dataType)).unionByName(births, allowMissingColumns=True)
    keys = (
        both.groupBy("graph_id", "ref")
        .agg(
            F.min("birth").alias("birth"),
            F.collect_list(F.when(F.col("period").isNotNull(), F.struct("period", "first_at"))).alias("uses"),
        )
        .where(F.size("uses") > 0)
        .withColumn("range", F.pmod(F.xxhash64("graph_id", "ref"), F.lit(ranges)).cast("int"))
        .withColumn("code", F.row_number().over(Window.partitionBy("range").orderBy("graph_id", "ref")))
    )
    used = keys.select("range", "code", "birth", F.explode("uses").alias("u"))
    place = F.bitmap_bit_position(F.col("code").cast("bigint"))
    maps = used.groupBy("range", F.bitmap_bucket_number(F.col("code").cast("bigint")).alias("container"), F.col("u.period").alias("period")).agg(
        F.bitmap_construct_agg(place).alias("refs"),
        F.bitmap_construct_agg(F.when(F.col("birth") <= F.col("u.first_at"), place)).alias("parents"),
    )
    left = maps.select("range", "container", "period", F.explode(_and_not("refs", "parents")).alias("place")).select(
        "range", "period", ((F.col("container") - 1) * CONTAINER + F.col("place") + 1).cast("int").alias("code")
    )
    return left.join(keys.select("range", "code", "graph_id", "ref"), ["range", "code"]).select("graph_id", "ref", "period")


def dangling_ends(nodes: DataFrame, edges: DataFrame, period: str = "month", ranges: int | None = None) -> DataFrame:
    """Edge ends without a living parent: ``edge_key, ref_end, graph_id, ref, at``.

    Null and blank ends are no references. An edge without graph or arrival time
    can have no parent, so its ends dangle; a node row without graph, id or arrival
    time is no parent. Repeated rows and repeated ids do no harm; other columns are
    not read, whatever their names.
    """
    nodes = nodes.select("graph_id", "id", "arrived_at", "deleted_at")
    ends = edge_ends(edges)
    known = ends.where("graph_id is not null and at is not null")
    suspects = suspect_keys(nodes, known, period, ranges)
    rows = known.withColumn("period", F.date_trunc(period, "at")).join(suspects, ["graph_id", "ref", "period"], "left_semi").drop("period")
    parents = nodes.select(F.col("graph_id").alias("p_graph"), F.col("id").alias("p_id"), F.col("arrived_at").alias("p_from"), F.col("deleted_at").alias("p_to"))
    alive = (
        (F.col("graph_id") == F.col("p_graph"))
        & (F.col("ref") == F.col("p_id"))
        & (F.col("p_from") <= F.col("at"))
        & (F.col("p_to").isNull() | (F.col("p_to") > F.col("at")))
    )
    columns = ["edge_key", "ref_end", "graph_id", "ref", "at"]
    return rows.join(parents, alive, "left_anti").select(columns).unionByName(ends.where("graph_id is null or at is null").select(columns))


def dangling_report(nodes: DataFrame, edges: DataFrame, period: str = "month") -> DataFrame:
    """References and dangling references by table, end and period of arrival.

    ``table_name, ref_end, period, n_refs, n_dangling``; an unknown arrival time is
    the period ``unknown``.
    """
    name = F.coalesce(F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd"), F.lit("unknown")).alias("period")
    total = edge_ends(edges).groupBy("ref_end", name).agg(F.count("*").alias("n_refs"))
    bad = dangling_ends(nodes, edges, period).groupBy("ref_end", name).agg(F.count("*").alias("n_dangling"))
    return total.join(bad, ["ref_end", "period"], "left").select(
        F.lit("edges").alias("table_name"), "ref_end", "period", "n_refs", F.coalesce("n_dangling", F.lit(0).cast("bigint")).alias("n_dangling")
    )
