"""Validation of graphs: nested (one row a graph) and flat (node and edge tables).

Findings keep the order: errors of nodes by position, then of edges; warnings by
edge, source before target before removal. Ids are unique within a graph only.

Fixed values, here and in the flat form: the names of findings (``missing_node_id``,
``missing_edge_id``, ``duplicate_id``, ``invalid_edge_source``, ``invalid_edge_target``,
``removed_edge``) and the wording of their messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.variants import field, is_string, items, js_string
from weftwork.model import EDGE, ERROR, NODE, WARNING


def _map(name: str, value: Column) -> Column:
    return F.create_map(F.lit(name), value)


def _error(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), message.alias("message"), F.lit(None).cast("map<string,string>").alias("details")).cast(ERROR)


def _warning(kind: str, message: Column, edge_id: Column, details: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), message.alias("message"), edge_id.alias("edge_id"), details.alias("details")).cast(WARNING)


def _named(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def _shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("undefined"))


def _with(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; within a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def _id_errors(rows: Column, what: str, dump) -> Column:
    """One error for each item without id and each repeat of an id, in order.

    Ids that are all different, as most are, cost one pass with a hash set.
    """

    def found(ids, repeats):
        def find(row, i):
            missing = F.array(_error(f"missing_{what}_id", F.concat(F.lit(f"{what.capitalize()} missing id: "), dump(row))))
            # sizes are Column arithmetic: array_position is 1-based and gives the first place
            repeat = F.array(_error("duplicate_id", F.concat(F.lit(f"Duplicate {what} id: "), row["id"])))
            none = F.array().cast(f"array<{ERROR.simpleString()}>")
            unnamed = F.when(~_named(row["id"]), missing)
            return unnamed.when(F.array_position(ids, row["id"]) <= i, repeat).otherwise(none) if repeats else unnamed.otherwise(none)

        return F.flatten(F.transform(rows, find))

    return _with(F.transform(rows, lambda r: r["id"]), lambda ids: F.when(F.size(F.array_distinct(ids)) == F.size(ids), found(ids, False)).otherwise(found(ids, True)))


def validate_column(graph: Column) -> Column:
    """``valid, errors, warnings, graph`` of a graph struct; null for a null graph.

    Null lists count as empty. Ends without a node are found by a hash set of the ids;
    edges are compared with those, so the cost grows with edges times dangling ends,
    and where ids repeat with the square of the items. Graphs of many thousand nodes
    belong to the ``flat_*`` functions.
    """
    nodes = F.filter(F.coalesce(graph["nodes"], F.array()), lambda n: n.isNotNull())
    edges = F.filter(F.coalesce(graph["edges"], F.array()), lambda e: e.isNotNull())
    kept = F.filter(nodes, lambda n: _named(n["id"]))
    candidates = F.filter(edges, lambda e: _named(e["id"]))
    ends = F.concat(F.transform(candidates, lambda e: e["source"]), F.transform(candidates, lambda e: e["target"]))
    dangling = F.array_except(ends, F.transform(kept, lambda n: n["id"]))

    def present(lost, end):
        return end.isNotNull() & ~F.coalesce(F.array_contains(lost, end), F.lit(False))

    def warn(lost, e):
        label = F.concat(F.lit("Edge "), e["id"])
        found = F.array(
            *(
                F.when(
                    ~present(lost, e[end]),
                    _warning(f"invalid_edge_{end}", F.concat(label, F.lit(f" references non-existent {end}: "), _shown(e[end])), e["id"], _map(end, e[end])),
                )
                for end in ("source", "target")
            ),
            F.when(
                ~present(lost, e["source"]) | ~present(lost, e["target"]),
                _warning("removed_edge", F.concat(F.lit("Removed invalid edge: "), e["id"]), e["id"], F.lit(None).cast("map<string,string>")),
            ),
        )
        return F.filter(found, lambda w: w.isNotNull())

    errors = F.concat(_id_errors(nodes, "node", F.to_json), _id_errors(edges, "edge", F.to_json))

    def judged(lost):
        good = F.filter(candidates, lambda e: present(lost, e["source"]) & present(lost, e["target"]))
        warnings = F.when(F.size(lost) == 0, F.array().cast(f"array<{WARNING.simpleString()}>")).otherwise(F.flatten(F.transform(candidates, lambda e: warn(lost, e))))
        return F.struct(good.alias("good"), warnings.alias("warnings"))

    def result(errors, edges):
        return F.struct(
            (F.size(errors) == 0).alias("valid"),
            errors.alias("errors"),
            edges["warnings"].alias("warnings"),
            F.struct(kept.alias("nodes"), edges["good"].alias("edges")).alias("graph"),
        )

    return F.when(graph.isNotNull(), _with(F.struct(errors.alias("e"), _with(dangling, judged).alias("j")), lambda x: result(x["e"], x["j"])))


def validate_graphs(df: DataFrame, graph: str = "graph") -> DataFrame:
    """``df`` with ``validation`` (see ``validate_column``)."""
    return df.withColumn("validation", validate_column(F.col(graph)))


def _repeats(rows: DataFrame, key: str) -> DataFrame:
    """With ``repeat``: null without an id, else whether an earlier row of the graph has the id, by position, ties by key.

    The first row of an id comes from an aggregate with partial minima; the rows are
    joined to it and never gather in a window, however often an id occurs.
    """
    place = F.struct(F.col("pos"), F.col(key))
    named = rows.where(_named(F.col("id")))
    first = named.groupBy(F.col("graph_id").alias("__g"), F.col("id").alias("__id")).agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    on = rows["graph_id"].eqNullSafe(first["__g"]) & (rows["id"] == first["__id"])
    repeat = F.when(_named(F.col("id")), F.coalesce(place > F.col("__first"), F.lit(False)))
    return rows.join(first, on, "left").withColumn("repeat", repeat).drop("__g", "__id", "__first", "__n")


def flat_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, phase, pos, row_key, type, message``: phase 0 are nodes, 1 edges.

    Rows of equal position are ordered by their key; rows equal in both are one row.
    Nulls in other columns are left out of a message's JSON.
    """
    parts = []
    for phase, what, rows, key, columns in (
        (0, "node", nodes, "node_key", ("id", "label", "type")),
        (1, "edge", edges, "edge_key", ("id", "source", "target", "type", "label")),
    ):
        rows = _repeats(rows.select("graph_id", "pos", key, *columns), key)
        found = F.when(F.col("repeat").isNull(), f"missing_{what}_id").when(F.col("repeat"), "duplicate_id")
        message = F.when(F.col("repeat").isNull(), F.concat(F.lit(f"{what.capitalize()} missing id: "), F.to_json(F.struct(*columns)))).otherwise(
            F.concat(F.lit(f"Duplicate {what} id: "), F.col("id"))
        )
        parts.append(rows.select("graph_id", F.lit(phase).alias("phase"), "pos", F.col(key).alias("row_key"), found.alias("type"), message.alias("message")).where("type is not null"))
    return parts[0].unionByName(parts[1])


def flagged_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that have an id, with ``source_ok`` and ``target_ok``.

    Both lookups go against the distinct ids, so that no edge is multiplied.
    """
    known = nodes.where(_named(F.col("id"))).select("graph_id", F.col("id").alias("__id")).distinct()
    out = edges.select("graph_id", "pos", "edge_key", "id", "source", "target", "type", "label").where(_named(F.col("id")))
    for end in ("source", "target"):
        ids = known.select("graph_id", F.col("__id").alias(end), F.lit(True).alias(f"{end}_ok"))
        out = out.join(ids, ["graph_id", end], "left").withColumn(f"{end}_ok", F.coalesce(f"{end}_ok", F.lit(False)))
    return out


def flat_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, pos, row_key, ord, type, message, edge_id``: ord 0 source, 1 target, 2 removal."""
    flagged = flagged_edges(nodes, edges)
    rows = F.array(
        *(
            F.when(
                ~F.col(f"{end}_ok"),
                F.struct(
                    F.lit(k).alias("ord"),
                    F.lit(f"invalid_edge_{end}").alias("type"),
                    F.concat(F.lit("Edge "), F.col("id"), F.lit(f" references non-existent {end}: "), _shown(F.col(end))).alias("message"),
                ),
            )
            for k, end in enumerate(("source", "target"))
        ),
        F.when(
            ~(F.col("source_ok") & F.col("target_ok")),
            F.struct(F.lit(2).alias("ord"), F.lit("removed_edge").alias("type"), F.concat(F.lit("Removed invalid edge: "), F.col("id")).alias("message")),
        ),
    )
    return flagged.select("graph_id", "pos", F.col("edge_key").alias("row_key"), "id", F.explode(rows).alias("w")).where("w is not null").select(
        "graph_id", "pos", "row_key", "w.ord", "w.type", "w.message", F.col("id").alias("edge_id")
    )


def flat_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that have an id, repeats included."""
    return nodes.where(_named(F.col("id")))


def flat_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that have an id and whose ends both exist, repeats included."""
    return flagged_edges(nodes, edges).where("source_ok and target_ok").drop("source_ok", "target_ok")


def flat_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, n_nodes, n_edges, n_errors, n_warnings, valid`` for every graph of either table."""

    def counted(rows, name):
        return rows.groupBy("graph_id").agg(F.count("*").alias(name))

    # counts are joined null-safely, since rows may lack their graph
    out = nodes.select("graph_id").union(edges.select("graph_id")).distinct()
    parts = {
        "n_nodes": flat_nodes(nodes),
        "n_edges": flat_edges(nodes, edges),
        "n_errors": flat_errors(nodes, edges),
        "n_warnings": flat_warnings(nodes, edges),
    }
    for name, rows in parts.items():
        part = counted(rows, name).withColumnRenamed("graph_id", "__g")
        out = out.join(part, out["graph_id"].eqNullSafe(part["__g"]), "left").drop("__g")
    return out.fillna(0, list(parts)).withColumn("valid", F.col("n_errors") == 0)


#: Marks an id that was no string in raw JSON, so that 1 and "1" stay different.
_TYPED = "\x00"


def raw_graph_column(v: Column) -> Column:
    """A graph of strings from unnormalised JSON; ids that are no strings carry a mark.

    False, 0, '' and null are no ids. Items that are no objects count as items
    without id. Lists that are no lists are empty.
    """

    def key(value):
        falsy = F.to_json(value).isin("false", "0", "-0", "0.0", '""')
        return F.when(is_string(value), F.try_variant_get(value, "$", "string")).when(falsy, "").otherwise(F.concat(F.lit(_TYPED), js_string(value, 1)))

    def item(x, ids, others, target):
        made = F.struct(*(key(field(x, n)).alias(n) for n in ids), *(js_string(field(x, n), 0).alias(n) for n in others), field(x, "metadata").alias("metadata"))
        return made.cast(target)

    nodes = F.transform(items(v, "nodes"), lambda x: item(x, ("id",), ("label", "type"), NODE))
    edges = F.transform(items(v, "edges"), lambda x: item(x, ("id", "source", "target"), ("type", "label"), EDGE))
    return F.when(v.isNotNull(), F.struct(nodes.alias("nodes"), edges.alias("edges")))


def validate_raw(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``report`` (``valid, errors, warnings, n_nodes, n_edges``) of unnormalised JSON in a VARIANT column.

    The marks are removed from messages. A value that is null has no report.
    """
    # columns of their own: the reading and the check each use their input many times
    checked = df.withColumn("__graph", raw_graph_column(F.col(value))).withColumn("__v", validate_column(F.col("__graph")))

    def clean(findings):
        return F.transform(findings, lambda f: F.struct(f["type"].alias("type"), F.replace(f["message"], F.lit(_TYPED), F.lit("")).alias("message")))

    v = F.col("__v")
    report = F.struct(
        v["valid"].alias("valid"), clean(v["errors"]).alias("errors"), clean(v["warnings"]).alias("warnings"),
        F.size(v["graph"]["nodes"]).alias("n_nodes"), F.size(v["graph"]["edges"]).alias("n_edges"),
    )
    return checked.withColumn("report", F.when(v.isNotNull(), report)).drop("__graph", "__v")
