import random

import pytest
from pyspark.sql import functions as F

from weftwork.model import GRAPH
from weftwork.operators.validate import flat_edges, flat_errors, flat_nodes, flat_summary, flat_warnings, validate_graphs, validate_raw


def graph(nodes, edges):
    return ([(i, "", "", None) for i in nodes], [(i, s, t, "", "", None) for i, s, t in edges])


CASES = [
    (graph(["a", "b"], [("e", "a", "b")]), True, [], [], 2, 1),
    (graph([], []), True, [], [], 0, 0),
    (graph(["a", None, ""], []), False, ["missing_node_id"] * 2, [], 1, 0),
    (graph(["a"], [(None, "a", "a"), ("", "x", "y")]), False, ["missing_edge_id"] * 2, [], 1, 0),
    (graph(["a", "a", "a"], []), False, ["duplicate_id"] * 2, [], 3, 0),
    (graph(["a"], [("e", "a", "x")]), True, [], ["invalid_edge_target", "removed_edge"], 1, 0),
    (graph(["a"], [("e", "x", "y")]), True, [], ["invalid_edge_source", "invalid_edge_target", "removed_edge"], 1, 0),
    (graph(["a"], [("e", "a", "a")]), True, [], [], 1, 1),
    (graph(["a"], [("e", "x", "a"), ("e", "a", "a")]), False, ["duplicate_id"], ["invalid_edge_source", "removed_edge"], 1, 1),
    (graph(["a"], [("e", None, "a")]), True, [], ["invalid_edge_source", "removed_edge"], 1, 0),
]


def frame(spark, graphs):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return spark.createDataFrame(list(enumerate(graphs)), StructType([StructField("k", IntegerType()), StructField("graph", GRAPH)]))


def test_nested_cases(spark):
    rows = validate_graphs(frame(spark, [c[0] for c in CASES])).orderBy("k").collect()
    for row, (_, valid, errors, warnings, n_nodes, n_edges) in zip(rows, CASES, strict=True):
        v = row.validation
        assert (v.valid, [e.type for e in v.errors], [w.type for w in v.warnings], len(v.graph.nodes), len(v.graph.edges)) == (valid, errors, warnings, n_nodes, n_edges)


def test_null_graph(spark):
    assert validate_graphs(frame(spark, [None])).first().validation is None


NODES = "node_key bigint, graph_id bigint, pos int, id string, label string, type string, nth int"
EDGES = "edge_key bigint, graph_id bigint, pos int, id string, source string, target string, type string, label string, source_ok string"


def test_flat_agrees_with_nested(spark):
    rng = random.Random(3)
    pick = lambda: rng.choice(["a", "b", "c", "d", "", None])
    graphs = [graph([pick() for _ in range(rng.randrange(6))], [(pick(), pick(), pick()) for _ in range(rng.randrange(6))]) for _ in range(60)]
    nested = {r.k: r.validation for r in validate_graphs(frame(spark, graphs)).collect()}
    nodes = spark.createDataFrame([(g * 100 + p, g, p, n[0], "", "", 9) for g, (ns, _) in enumerate(graphs) for p, n in enumerate(ns)], NODES)
    edges = spark.createDataFrame([(g * 100 + p, g, p, *e[:3], "", "", "no") for g, (_, es) in enumerate(graphs) for p, e in enumerate(es)], EDGES)
    errors, warnings = flat_errors(nodes, edges).orderBy("graph_id", "phase", "pos").collect(), flat_warnings(nodes, edges).orderBy("graph_id", "pos", "ord").collect()
    kept = flat_edges(nodes, edges).orderBy("graph_id", "pos").collect()
    ids = flat_nodes(nodes).orderBy("graph_id", "pos").collect()
    for g, v in nested.items():
        assert [e.type for e in errors if e.graph_id == g] == [e.type for e in v.errors]
        assert [(w.type, w.message, w.edge_id) for w in warnings if w.graph_id == g] == [(w.type, w.message, w.edge_id) for w in v.warnings]
        assert [e.id for e in kept if e.graph_id == g] == [e.id for e in v.graph.edges]
        assert [n.id for n in ids if n.graph_id == g] == [n.id for n in v.graph.nodes]
    for row in flat_summary(nodes, edges).collect():
        assert row.valid == nested[row.graph_id].valid and row.n_errors == len(nested[row.graph_id].errors)


def test_graphs_share_ids(spark):
    nodes = spark.createDataFrame([(1, 1, 0, "a", "", "", 0), (2, 2, 0, "a", "", "", 0)], NODES)
    assert flat_errors(nodes, spark.createDataFrame([], EDGES)).count() == 0


def test_null_graph_ids_are_counted(spark):
    nodes = spark.createDataFrame([(1, None, 0, "a", "", "", 0), (2, None, None, "a", "", "", 0)], NODES)
    row = flat_summary(nodes, spark.createDataFrame([], EDGES)).first()
    assert (row.graph_id, row.n_nodes, row.n_errors, row.valid) == (None, 2, 1, False)


@pytest.mark.parametrize(
    "raw,errors,warnings,n_edges",
    [
        ('{"nodes": [{"id": 1}], "edges": [{"id": "e", "source": "1", "target": 1}]}', [], ["invalid_edge_source", "removed_edge"], 0),
        ('{"nodes": [{"id": 1}], "edges": [{"id": "e", "source": 1, "target": 1}]}', [], [], 1),
        ('{"nodes": [{"id": 0}, {"id": false}, {"id": ""}, {}, null]}', ["missing_node_id"] * 5, [], 0),
        ('{"nodes": 3}', [], [], 0),
    ],
)
def test_raw_front_door(spark, raw, errors, warnings, n_edges):
    df = spark.createDataFrame([(raw,)], "raw string").select(F.try_parse_json("raw").alias("value"))
    r = validate_raw(df, "value").first().report
    assert ([e.type for e in r.errors], [w.type for w in r.warnings], r.n_edges) == (errors, warnings, n_edges)
    assert not any("\x00" in w.message for w in r.warnings)
