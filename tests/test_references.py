import random
from datetime import datetime, timedelta

from weftwork.operators.references import dangling_ends, dangling_report

NODES = "graph_id bigint, id string, arrived_at timestamp_ntz, deleted_at timestamp_ntz, ref string, at string, period string"
EDGES = "edge_key bigint, graph_id bigint, source string, target string, arrived_at timestamp_ntz, range int, code int"
T0 = datetime(2024, 1, 1)


def brute(nodes, edges):
    out = set()
    for k, g, s, t, at, *_ in edges:
        for end, ref in (("source", s), ("target", t)):
            if ref is None or not ref.strip():
                continue
            if not any(n[0] == g and n[0] is not None and n[1] == ref and n[2] and at and n[2] <= at and (n[3] is None or n[3] > at) for n in nodes):
                out.add((k, end))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    day = lambda: rng.choice([None] + [T0 + timedelta(days=rng.randrange(400), hours=rng.randrange(24))] * 9)
    ids = ["a", "A", " a", "b", "01", "1", "c", None, "", "  "]
    nodes = [(rng.choice([1, 1, 1, 2, None]), rng.choice(ids), day(), rng.choice([None, None, day()]), "x", "y", "z") for _ in range(150)]
    edges = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(ids), rng.choice(ids), day(), 0, 0) for k in range(600)]
    edges += edges[:5]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    for ranges, period in ((None, "month"), (1, "year"), (7, "day")):
        got = {(r.edge_key, r.ref_end) for r in dangling_ends(n, e, period, ranges).collect()}
        assert got == brute(nodes, edges)
    report = dangling_report(n, e).collect()
    assert sum(r.n_dangling for r in report) == dangling_ends(n, e).count()
    assert any(r.period == "unknown" for r in report)


def test_empty_tables(spark):
    none_n, none_e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    one = spark.createDataFrame([(1, 1, "a", None, T0, 0, 0)], EDGES)
    assert dangling_ends(none_n, none_e).count() == 0
    assert [(r.edge_key, r.ref_end) for r in dangling_ends(none_n, one).collect()] == [(1, "source")]


def test_many_keys_need_several_containers(spark):
    n = spark.range(70_000).selectExpr("1L as graph_id", "cast(id as string) as id", "timestamp_ntz'2024-01-01' as arrived_at", "cast(null as timestamp_ntz) as deleted_at")
    e = spark.range(70_050).selectExpr("id as edge_key", "1L as graph_id", "cast(id as string) as source", "cast(null as string) as target", "timestamp_ntz'2024-02-01' as arrived_at")
    got = sorted(r.edge_key for r in dangling_ends(n, e, ranges=1).collect())
    assert got == list(range(70_000, 70_050))
