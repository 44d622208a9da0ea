import json

import random

import pytest
from pyspark.sql import functions as F

from weftwork.model import CanvasOptions
from weftwork.operators import canvas as cv
from weftwork.operators.components import connected_components
from weftwork.operators.layout import layered

NODES = "node_key bigint, graph_id bigint, pos int, id string, label string, type string, width string"
EDGES = "edge_key bigint, graph_id bigint, pos int, id string, source string, target string, type string, label string, x int"


def tables(spark, nodes, edges):
    n = spark.createDataFrame([(k, g, k, i, label, kind, "w") for k, (g, i, label, kind) in enumerate(nodes)], NODES)
    e = spark.createDataFrame([(k, g, k, i, s, t, kind, label, 0) for k, (g, i, s, t, kind, label) in enumerate(edges)], EDGES)
    return n, e


@pytest.mark.parametrize(
    "label,kind,width,height",
    [
        ("Alice", "person", 220, 144),
        ("Cupertino, California", "location", 256, 144),
        ("A" * 37, "concept", 320, 174),
        ("A" * 60, "concept", 348, 174),
        ("International Business Machines Corporation of New York", "organization", 348, 174),
        ("x", "a very long custom entity type name indeed yes", 220, 188),
        (" ".join(["word"] * 60), "event", 348, 220),
        ("A" * 21, "other", 256, 144),
        ("😀" * 13, "other", 276, 144),
    ],
)
def test_measures(spark, label, kind, width, height):
    df = spark.createDataFrame([(label, kind)], "label string, type string")
    row = cv.measured(df).first()
    assert (row.width, row.height) == (width, height)
    assert row.text == f"# {label}\n\nType: {kind}"


def test_edge_labels(spark):
    cases = [("works_for", "works for", "works for"), ("works_for", "Works  For", "Works  For"), ("works_for", "employed by", "works_for"), ("works_for", " ", "works for"), ("works_for", None, "works for")]
    df = spark.createDataFrame(cases, "type string, label string, want string")
    assert all(r.got == r.want for r in df.select("want", cv.edge_label(F.col("type"), F.col("label")).alias("got")).collect())


def test_edge_sides(spark):
    cases = [(True, 5, 5, "right", "top"), (False, 10, 10, "right", "left"), (False, 0, 0, "right", "left"), (False, -10, 10, "left", "right"), (False, 5, 10, "bottom", "top"), (False, 5, -10, "top", "bottom")]
    df = spark.createDataFrame(cases, "same boolean, dx int, dy int, a string, b string")
    for r in df.select("a", "b", cv.edge_sides(F.col("same"), F.col("dx"), F.col("dy")).alias("s")).collect():
        assert (r.s.from_side, r.s.to_side) == (r.a, r.b)


def test_sanitise(spark):
    nodes, edges = tables(
        spark,
        [(1, " a ", None, " "), (1, "a", "second", "x"), (1, "b", "B", "person"), (1, " ", "no", "no"), (2, "a", "other graph", "x"), (None, "a", "n", "n")],
        [(1, "e", "a", "gone", "t", None), (1, "e", "a", "b", " ", None), (1, "e", "b", "a", "t", "later"), (1, "f", " b", "b ", "is_a", None), (2, "e", "a", "b", "t", None)],
    )
    clean = cv.clean_nodes(nodes)
    assert {(r.graph_id, r.id, r.label, r.type) for r in clean.collect()} == {(1, "a", "a", "other"), (1, "b", "B", "person"), (2, "a", "other graph", "x"), (None, "a", "n", "n")}
    got = {(r.graph_id, r.id, r.source, r.target, r.type, r.label) for r in cv.clean_edges(clean, edges).collect()}
    assert got == {(1, "e", "a", "b", "related_to", "related to"), (1, "f", "b", "b", "is_a", "is a")}


def test_packing(spark):
    boxes = spark.createDataFrame([(1, f"c{k}", f"c{k}", 220, 144) for k in range(6)], "graph_id bigint, component string, anchor string, width int, height int")
    got = {r.component: (r.left, r.top) for r in cv.packed(boxes).collect()}
    assert [got[f"c{k}"] for k in range(6)] == [(120, 120), (580, 120), (1040, 120), (120, 504), (580, 504), (1040, 504)]
    assert cv.packed(boxes.limit(0)).count() == 0


def overlap(a, b):
    return a.x < b.x + b.width and b.x < a.x + a.width and a.y < b.y + b.height and b.y < a.y + a.height


def test_canvas_invariants(spark):
    rng = random.Random(5)
    nodes = [(g, f"n{k}", "N" * (k + 1), "person") for g in (1, 2, 3) for k in range(12)]
    edges = [(g, f"e{k}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", "t", None) for g in (1, 2, 3) for k in range(9)]
    done, links = cv.canvas(*tables(spark, nodes, edges), CanvasOptions(layout_limit=5))
    rows = done.collect()
    assert len(rows) == 36 and links.count() == 27
    for g in (1, 2, 3):
        mine = [r for r in rows if r.graph_id == g]
        assert not any(overlap(a, b) for i, a in enumerate(mine) for b in mine[:i])
    docs = cv.documents(done, links, part_items=5).collect()
    assert {d.n_parts for d in docs} == {3}
    assert sum(d.document.count('"type":"text"') for d in docs) == 36


def test_chain_runs_right_or_down():
    nodes = [("a", 220, 144), ("b", 220, 144), ("c", 220, 144)]
    edges = [("a", "b"), ("b", "c")]
    right, width, _ = layered(nodes, edges, CanvasOptions())
    assert right["a"][0] + 220 <= right["b"][0] and right["b"][0] + 220 <= right["c"][0] and width == 3 * 220 + 2 * 160
    down, _, _ = layered(nodes, edges, CanvasOptions(rankdir="TB"))
    assert down["a"][1] + 144 <= down["b"][1] and down["b"][1] + 144 <= down["c"][1]
    back, _, _ = layered(nodes, edges, CanvasOptions(rankdir="RL"))
    assert back["c"][0] < back["b"][0] < back["a"][0]


def test_random_layouts_do_not_overlap():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(2, 14)
        nodes = [(f"v{i}", rng.randrange(220, 349, 4), rng.randrange(144, 221)) for i in range(n)]
        edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(rng.randrange(1, 2 * n))]
        place, width, height = layered(nodes, edges, CanvasOptions())
        assert place == layered(nodes, edges, CanvasOptions())[0]
        boxes = [(*place[i], w, h) for i, w, h in nodes]
        assert all(x >= 0 and y >= 0 and x + w <= width and y + h <= height for x, y, w, h in boxes)
        for i, (x, y, w, h) in enumerate(boxes):
            assert not any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in boxes[:i])


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(2)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)] + [("hub", f"h{i}") for i in range(80)] + [("s", "s"), (None, "x"), ("p000", "p001")]
    rng.shuffle(edges)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(got[f"p{i:03}"] == "p000" for i in range(151)) and all(got[f"h{i}"] == "h0" for i in range(80))
    assert got["s"] == "s" and "x" not in got
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_edges_decide_in_large_components(spark):
    # root to forty nodes, each to one of forty others, whose ids are in another order; a loop at one end
    pairs = [(f"a{k:02}", f"b{k * 17 % 40:02}") for k in range(40)]
    edges = [("z", a) for a, _ in pairs] + pairs + [("b00", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")]
    ids = sorted({v for e in edges for v in e})
    boxes = spark.createDataFrame([(1, "a00", v, 220 + len(v), 144 + k % 3) for k, v in enumerate(ids)], "graph_id bigint, component string, id string, width int, height int")
    links = spark.createDataFrame([(1, f"e{k}", a, b) for k, (a, b) in enumerate(edges)], "graph_id bigint, id string, source string, target string")
    rows = cv.laid_out(boxes, links, CanvasOptions(layout_limit=10)).join(boxes, ["graph_id", "component", "id"]).collect()
    at = {r.id: r for r in rows}
    assert len(rows) == len(ids) and len({(r.c_width, r.c_height) for r in rows}) == 1
    assert not any(overlap(a, b) for i, a in enumerate(rows) for b in rows[:i])
    assert all(r.x >= 0 and r.y >= 0 and r.x + r.width <= r.c_width and r.y + r.height <= r.c_height for r in rows)
    assert sum(at[a].x + at[a].width > at[b].x for a, b in edges) == 1
    across = sorted(pairs, key=lambda p: at[p[0]].y)
    assert across == sorted(pairs, key=lambda p: at[p[1]].y)


def test_layout_options_are_read():
    from weftwork.operators.layout import layered, walked

    order = list("abcdefg")
    nodes = [(v, 220, 110 + 10 * k) for k, v in enumerate(order)]
    edges = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("c", "e"), ("e", "a"), ("f", "e"), ("g", "d"), ("f", "g")]
    seen = {}
    for align in ("UL", "UR", "DL", "DR", ""):
        corners, width, height = layered(nodes, edges, CanvasOptions(align=align))
        seen[align] = tuple(sorted(corners.items()))
        assert min(x for x, _ in corners.values()) >= 0 and min(y for _, y in corners.values()) >= 0
        assert all(x + 220 <= width for x, _ in corners.values()) and height >= 170
    assert len(set(seen.values())) > 1
    long = layered(nodes, [("a", "b"), ("b", "e"), ("f", "e")], CanvasOptions(ranker="longest-path"))[0]
    tight = layered(nodes, [("a", "b"), ("b", "e"), ("f", "e")], CanvasOptions())[0]
    assert long["f"][0] == long["a"][0] and tight["f"][0] == tight["b"][0]
    turned = walked(order, edges)
    assert ("a", "e") in turned and ("e", "a") not in turned
    assert layered(nodes, edges, CanvasOptions(acyclicer="dfs"))[0]


def test_documents_hold_everything(spark):
    nodes = spark.createDataFrame([(1, k, k, f"n{k}", None, None) for k in range(120)], "graph_id bigint, node_key bigint, pos int, id string, label string, type string")
    edges = spark.createDataFrame(
        [(1, k, k, f"e{k}", f"n{k}", f"n{k + 1}", None, None) for k in range(119)],
        "graph_id bigint, edge_key bigint, pos int, id string, source string, target string, type string, label string",
    )
    parts = [json.loads(r.document) for r in cv.documents(*cv.canvas(nodes, edges), part_items=50).collect()]
    assert len(parts) == 3
    assert {i["id"] for p in parts for i in p["nodes"]} == {f"n{k}" for k in range(120)} and sum(len(p["edges"]) for p in parts) == 119
