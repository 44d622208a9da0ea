import random
from collections import Counter, defaultdict

import pytest

from weftwork.llm import terms
from weftwork.session import fresh_folder

NODES = "graph_id bigint, type string, label string, n int, term string, bucket int"
EDGES = "graph_id bigint, type string, n int, field_name string"


def brute(nodes, edges):
    occurrences, records = Counter(), defaultdict(set)
    for g, kind, label, *_ in nodes:
        for field, term in [("node_type", kind)] + [("node_label", t) for t in (label.lower().split(" ") if label is not None else [])]:
            if term is not None and term.strip():
                occurrences[field, term] += 1
                records[field, term] |= {g} - {None}
    for g, kind, *_ in edges:
        if kind is not None and kind.strip():
            occurrences["edge_type", kind] += 1
            records["edge_type", kind] |= {g} - {None}
    return {k: (n, len(records[k])) for k, n in occurrences.items()}


def made(rng, n):
    word = lambda: rng.choice(["a", "B", "b", "", " ", "x y", "X  z", " ", None, "q" * 3000])
    graph = lambda: rng.choice([None, 1, 1, 1, *range(2, 25)])
    return [(graph(), word(), word(), 1, "t", 0) for _ in range(n)], [(graph(), word(), 1, "f") for _ in range(n)]


def counted(state):
    return {(r.field_name, r.term): (r.occurrences, r.records) for r in terms.counts(state).collect() if r.field_name in terms.TABLES}


def test_one_delta(spark):
    nodes, edges = made(random.Random(1), 300)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    state = terms.TermCounts.fresh(spark, 8).merge(terms.delta(terms.node_terms(n), terms.edge_terms(e))).state()
    want = brute(nodes, edges)
    assert counted(state) == want
    total = {"edge_type": len({x[0] for x in edges} - {None}), "node_type": len({x[0] for x in nodes} - {None})}
    total["node_label"] = total["node_type"]
    marks = {(r.field_name, r.term, r.mark) for r in terms.marks(terms.counts(state)).collect()}
    assert marks == {(f, t, "rare" if r == 1 else "common") for (f, t), (_, r) in want.items() if r == 1 or r * 10 > total[f]}


def test_increments_equal_recount(spark):
    rng = random.Random(2)
    nodes, edges = made(rng, 200)
    counts = terms.TermCounts.fresh(spark, 8)
    frames = lambda ns, es: (spark.createDataFrame(ns, NODES), spark.createDataFrame(es, EDGES))
    n, e = frames(nodes[:120], edges[:120])
    counts.merge(terms.delta(terms.node_terms(n), terms.edge_terms(e)))
    before = dict(counts.holds)
    n, e = frames(nodes[120:], edges[120:])
    gone, _ = frames(nodes[:40], edges[:1])
    counts.merge(terms.delta(terms.node_terms(n), terms.edge_terms(e), terms.node_terms(gone, sign=-1)))
    want = {k: v for k, v in brute(nodes[40:], edges).items()}
    assert counted(counts.state()) == want
    one, _ = frames([(3, "only", None, 1, "t", 0)], edges[:1])
    held = dict(counts.holds)
    counts.merge(terms.delta(terms.node_terms(one)))
    assert sum(counts.holds[b] != held.get(b) for b in counts.holds) <= 2 and before
    again = terms.TermCounts.open(spark, counts.path)
    assert (again.version, again.buckets, again.holds) == (counts.version, 8, counts.holds) and counted(again.state()) == counted(counts.state())
    again.vacuum()
    assert counted(terms.TermCounts.open(spark, counts.path).state()) == counted(counts.state())
    back, _ = frames([(3, "only", None, 1, "t", 0)], edges[:1])
    counts.merge(terms.delta(terms.node_terms(back, sign=-1)))
    assert counted(counts.state()) == want


def test_open_and_buckets(spark):
    with pytest.raises(FileNotFoundError):
        terms.TermCounts.open(spark, fresh_folder(spark, "none"))
    n, e = spark.createDataFrame([(1, "a", "b", 1, "t", 0)], NODES), spark.createDataFrame([], EDGES)
    counts = terms.TermCounts.fresh(spark).merge(terms.delta(terms.node_terms(n), terms.edge_terms(e)))
    assert counts.buckets == 16 and terms.TermCounts.open(spark, counts.path).holds == counts.holds


def test_empty(spark):
    n, e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    state = terms.TermCounts.fresh(spark, 4).merge(terms.delta(terms.node_terms(n), terms.edge_terms(e))).state()
    assert terms.counts(state).count() == 0 and terms.marks(terms.counts(state)).count() == 0
