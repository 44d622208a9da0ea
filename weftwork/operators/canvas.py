"""Positioned canvas documents from node and edge tables.

Sanitising keeps the first node of an id and the first valid edge of an id, as
aggregates with partial minima rather than windows, so that repeated ids cannot
gather in a task. Components are found over all graphs at once; each small component
is laid out by itself, large ones by iterated joins; shelves are packed by a fold that
streams over a graph's components in order and holds only the cursor.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import humanize, js_trim, js_words, optional_text, utf16_length
from weftwork.model import CanvasOptions
from weftwork.operators.components import connected_components
from weftwork.operators.layout import layered
from weftwork.operators.wide_layout import wide_layered
from weftwork.session import written

#: Colours.
NODE_COLORS = {
    "concept": "#15803d", "date": "#ca8a04", "event": "#2563eb", "location": "#0891b2",
    "organization": "#0f766e", "other": "#475569", "person": "#dc2626", "product": "#7c3aed",
}
EDGE_COLOR = "#64748b"


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """``graph_id, pos, id, label, type``: trimmed, blank ids left out, the first row of an id."""
    first = F.min(F.struct("pos", "node_key", optional_text(F.col("label")).alias("label"), optional_text(F.col("type")).alias("type")))
    named = nodes.withColumn("id", optional_text(F.col("id"))).where("id is not null")
    return named.groupBy("graph_id", "id").agg(first.alias("n")).select(
        "graph_id", "n.pos", "id", F.coalesce("n.label", "id").alias("label"), F.coalesce("n.type", F.lit("other")).alias("type")
    )


def clean_edges(clean: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, pos, id, source, target, type, label``: both ends known, then the first row of an id."""
    ids = [F.col(c) for c in ("id", "source", "target")]
    named = edges.select("graph_id", "pos", "edge_key", *(optional_text(c).alias(n) for c, n in zip(ids, ("id", "source", "target"), strict=True)),
                         optional_text(F.col("type")).alias("type"), optional_text(F.col("label")).alias("label"))
    named = named.where("id is not null and source is not null and target is not null")
    for end in ("source", "target"):
        named = named.join(clean.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_semi")
    first = named.groupBy("graph_id", "id").agg(F.min(F.struct("pos", "edge_key", "source", "target", "type", "label")).alias("e"))
    kind = F.coalesce("e.type", F.lit("related_to"))
    return first.select("graph_id", "e.pos", "id", "e.source", "e.target", kind.alias("type"), F.coalesce("e.label", humanize(kind)).alias("label"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def wrapped_lines(text: Column, room: Column) -> Column:
    """Lines a text takes at ``room`` characters, words longer than that running on."""
    lengths = F.transform(js_words(text), utf16_length)
    start = F.struct(F.lit(1).alias("lines"), F.lit(0).alias("cur"))

    def over(n):
        rest = n % room
        return F.when(rest == 0, room).otherwise(rest).cast("int")

    def step(s, n):
        fits = s["cur"] + 1 + n <= room
        new = s["lines"] + 1 + F.floor(F.greatest(F.lit(0), n - 1) / room)
        lines = F.when(s["cur"] == 0, s["lines"] + F.floor(n / room)).when(fits, s["lines"]).otherwise(new)
        cur = F.when(s["cur"] == 0, over(n)).when(fits, s["cur"] + 1 + n).otherwise(over(n))
        return F.struct(lines.cast("int").alias("lines"), cur.cast("int").alias("cur"))

    return F.aggregate(lengths, start, step)["lines"]


def measured(clean: DataFrame) -> DataFrame:
    """``clean`` with ``width, height, text, color``."""
    long = clamp(220 + 4 * F.greatest(F.lit(0), F.least(utf16_length(F.col("label")) - 12, F.lit(32))), 220, 360).cast("int")
    colors = F.create_map(*(F.lit(x) for pair in NODE_COLORS.items() for x in pair))
    out = clean.withColumn("width", long)
    room = {n: F.greatest(F.lit(16), F.floor((F.col("width") - 48) / n)).cast("int") for n in (8, 9)}
    kind = F.concat(F.lit("Type: "), F.col("type"))
    height = clamp(92 + 30 * wrapped_lines(F.col("label"), room[8]) + 22 * wrapped_lines(kind, room[9]), 110, 220).cast("int")
    return out.select("*", height.alias("height"), F.concat(F.lit("# "), F.col("label"), F.lit("\n\n"), kind).alias("text"),
                      F.coalesce(colors[F.col("type")], F.lit(NODE_COLORS["other"])).alias("color"))


def edge_label(kind: Column, label: Column) -> Column:
    """The relation in words where the label is blank, the label where it says the same, else the raw type."""

    def plain(c):
        return F.array_join(js_words(F.lower(c)), " ")

    told, words = js_trim(label), humanize(kind)
    return F.when(F.coalesce(told == "", F.lit(True)), words).when(plain(told) == plain(words), told).otherwise(kind)


def edge_sides(same: Column, dx: Column, dy: Column) -> Column:
    """``from_side, to_side`` by the distance of the centres."""

    def sides(a, b):
        return F.struct(F.lit(a).alias("from_side"), F.lit(b).alias("to_side"))

    level = F.abs(dx) >= F.abs(dy)
    return (
        F.when(same, sides("right", "top"))
        .when(level & (dx >= 0), sides("right", "left"))
        .when(level, sides("left", "right"))
        .when(dy >= 0, sides("bottom", "top"))
        .otherwise(sides("top", "bottom"))
    )


def with_components(clean: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, id, component, anchor``: the component is its smallest id in byte order, the anchor its first by locale."""
    links = edges.where("source <> target").select(F.struct("graph_id", F.col("source").alias("id")).alias("src"), F.struct("graph_id", F.col("target").alias("id")).alias("dst"))
    found = connected_components(links).select("vertex.graph_id", "vertex.id", F.col("component.id").alias("component"))
    named = clean.select("graph_id", "id").join(found, ["graph_id", "id"], "left").withColumn("component", F.coalesce("component", "id"))
    anchors = named.groupBy("graph_id", "component").agg(F.min_by("id", F.struct(F.collate("id", "UNICODE"), "id")).alias("anchor"))
    return named.join(anchors, ["graph_id", "component"])


_PLACED = "graph_id bigint, component string, id string, x int, y int, c_width int, c_height int"


def laid_out(boxes: DataFrame, edges: DataFrame, options: CanvasOptions = CanvasOptions()) -> DataFrame:
    """``graph_id, component, id, x, y, c_width, c_height`` within each component.

    ``boxes``: ``graph_id, component, id, width, height``. One box lies at the origin
    without leaving the JVM; up to ``layout_limit`` boxes are layered in one task, more
    by distributed passes.
    """
    key = ["graph_id", "component"]
    sizes = boxes.groupBy(*key).agg(F.count("*").alias("n"))
    boxes = written(boxes.join(sizes, key), "boxes")
    single = boxes.where("n = 1").select(*key, "id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("c_width"), F.col("height").alias("c_height"))

    some = boxes.where((F.col("n") > 1) & (F.col("n") <= options.layout_limit))
    inner = edges.where("source <> target").join(some.select("graph_id", "component", F.col("id").alias("source")), ["graph_id", "source"])
    none = F.lit(None).cast("string")
    rows = some.select(*key, F.lit(0).alias("edge"), F.col("id").alias("by"), F.col("id").alias("a"), none.alias("b"), "width", "height").unionByName(
        inner.select(*key, F.lit(1).alias("edge"), F.col("id").alias("by"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(0).alias("width"), F.lit(0).alias("height"))
    )
    # one component after the other streams through a task, its nodes before its edges, both by locale
    rows = rows.repartition(*key).sortWithinPartitions(*key, "edge", F.collate("by", "UNICODE"), "by")

    def place(batches):
        def each():
            for batch in batches:
                yield from zip(*(batch[c].tolist() for c in ("graph_id", "component", "edge", "a", "b", "width", "height")), strict=True)

        done = []
        for (graph, component), items in groupby(each(), key=lambda r: r[:2]):
            nodes, links = [], []
            for _, _, edge, a, b, w, h in items:
                (links if edge else nodes).append((a, b) if edge else (a, w, h))
            corners, width, height = layered(nodes, links, options)
            done += [(graph, component, i, x, y, width, height) for i, (x, y) in corners.items()]
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        yield pd.DataFrame(done, columns=names)

    names = [c.split()[0] for c in _PLACED.split(", ")]
    layered_rows = rows.mapInPandas(place, _PLACED)

    out = single.unionByName(layered_rows)
    many = boxes.where(F.col("n") > options.layout_limit).select(*key, "id", "width", "height")
    if many.isEmpty():
        return out
    linked = edges.where("source <> target").join(many.select(*key, F.col("id").alias("source")), ["graph_id", "source"])
    return out.unionByName(wide_layered(many, linked.select(*key, F.col("source").alias("a"), F.col("target").alias("b")), options))


def packed(components: DataFrame, options: CanvasOptions = CanvasOptions()) -> DataFrame:
    """``graph_id, component, left, top`` of components (``graph_id, component, anchor, width, height``) on shelves.

    Larger areas come first, then smaller anchors. The fold keeps only a cursor, so a
    graph of any number of components streams through its task.
    """
    area = F.col("width").cast("bigint") * F.col("height")
    totals = components.groupBy("graph_id").agg(F.sum(area).alias("total"))
    target = F.greatest(F.lit(1400), F.ceil(F.sqrt(F.when(F.col("total") == 0, 1).otherwise(F.col("total"))) * 1.4) + 2 * options.padding).cast("bigint")
    rows = components.join(totals, "graph_id").select("graph_id", "component", "anchor", "width", "height", area.alias("area"), target.alias("target"))
    rows = rows.repartition("graph_id").sortWithinPartitions("graph_id", F.desc("area"), F.collate("anchor", "UNICODE"), "anchor", "component")
    pad, gap = options.padding, options.component_gap

    def shelve(batches):
        graph, x, y, row = None, pad, pad, 0
        for batch in batches:
            out = []
            for g, c, w, h, goal in zip(batch["graph_id"], batch["component"], batch["width"], batch["height"], batch["target"], strict=True):
                if g != graph:
                    graph, x, y, row = g, pad, pad, 0
                if x > pad and x + w > goal:
                    x, y, row = pad, y + row + gap, 0
                out.append((g, c, x, y))
                x, row = x + w + gap, max(row, h)
            yield pd.DataFrame(out, columns=["graph_id", "component", "left", "top"])

    return rows.select("graph_id", "component", "width", "height", "target").mapInPandas(shelve, "graph_id bigint, component string, left bigint, top bigint")


def canvas(nodes: DataFrame, edges: DataFrame, options: CanvasOptions = CanvasOptions()) -> tuple[DataFrame, DataFrame]:
    """(canvas nodes, canvas edges) of all graphs, as rows.

    Nodes: ``graph_id, pos, id, x, y, width, height, text, color``. Edges:
    ``graph_id, pos, id, from_node, from_side, to_node, to_side, label, color``.
    Rows without a graph are left out.
    """
    clean = written(clean_nodes(nodes.where("graph_id is not null")), "canvas-nodes")
    links = written(clean_edges(clean, edges), "canvas-edges")
    boxes = measured(clean)
    comps = with_components(clean, links)
    parts = written(laid_out(boxes.select("graph_id", "id", "width", "height").join(comps.drop("anchor"), ["graph_id", "id"]), links, options), "layout")
    sizes = parts.groupBy("graph_id", "component").agg(F.first("c_width").alias("width"), F.first("c_height").alias("height"))
    shelves = packed(sizes.join(comps.select("graph_id", "component", "anchor").distinct(), ["graph_id", "component"]), options)
    placed = parts.join(shelves, ["graph_id", "component"]).select("graph_id", "id", (F.col("x") + F.col("left")).alias("x"), (F.col("y") + F.col("top")).alias("y"))
    done = written(boxes.join(placed, ["graph_id", "id"], "left").fillna(0, ["x", "y"]).select("graph_id", "pos", "id", "x", "y", "width", "height", "text", "color"), "canvas")

    def centre(end):
        return done.select("graph_id", F.col("id").alias(end), (F.col("x") + F.col("width") / 2).alias(f"{end}_x"), (F.col("y") + F.col("height") / 2).alias(f"{end}_y"))

    ended = links.join(centre("source"), ["graph_id", "source"]).join(centre("target"), ["graph_id", "target"])
    sides = edge_sides(F.col("source") == F.col("target"), F.col("target_x") - F.col("source_x"), F.col("target_y") - F.col("source_y"))
    return done, ended.withColumn("s", sides).select(
        "graph_id", "pos", "id", F.col("source").alias("from_node"), "s.from_side", F.col("target").alias("to_node"), "s.to_side",
        edge_label(F.col("type"), F.col("label")).alias("label"), F.lit(EDGE_COLOR).alias("color"),
    )


#: Fields of a document's items, with their columns.
FIELDS = {
    "nodes": {"id": "id", "type": None, "x": "x", "y": "y", "width": "width", "height": "height", "text": "text", "color": "color"},
    "edges": {"id": "id", "fromNode": "from_node", "fromSide": "from_side", "toNode": "to_node", "toSide": "to_side", "label": "label", "color": "color"},
}


def items(rows: DataFrame, name: str) -> DataFrame:
    """``graph_id, pos, id, item``: each row of a canvas as an item of a document; ``name`` is ``nodes`` or ``edges``."""
    return rows.select("graph_id", "pos", "id", F.struct(*((F.col(c) if c else F.lit("text")).alias(f) for f, c in FIELDS[name].items())).alias("item"))


def documents(nodes: DataFrame, edges: DataFrame, part_items: int = 5000) -> DataFrame:
    """``graph_id, part, n_parts, document``: canvas JSON of each graph.

    A graph of more than ``part_items`` nodes or edges comes in several documents,
    each with a share of the nodes and edges, so that no group grows without bound;
    together the parts hold every item.
    """
    counts = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).unionByName(edges.groupBy("graph_id").agg(F.count("*").alias("n")))
    parts = counts.groupBy("graph_id").agg(F.ceil(F.max("n") / part_items).cast("int").alias("n_parts"))

    def arrays(rows, name):
        rows = items(rows, name).join(parts, "graph_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int"))
        return rows.groupBy("graph_id", "n_parts", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "item"))), lambda r: r["item"]).alias(name))

    n, e = arrays(nodes, "nodes"), arrays(edges, "edges")
    both = n.join(e, ["graph_id", "n_parts", "part"], "full")
    empty = F.array()
    shown = F.struct(F.coalesce("nodes", empty.cast(n.schema["nodes"].dataType)).alias("nodes"), F.coalesce("edges", empty.cast(e.schema["edges"].dataType)).alias("edges"))
    return both.select("graph_id", "part", "n_parts", F.to_json(shown).alias("document"))
