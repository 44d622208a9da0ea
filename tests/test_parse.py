import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.operators.parse import parse_replies
from weftwork.operators.repair import balanced, looks_truncated, parse_failure, repaired_text, with_repaired

CASES = [
    ('{"nodes": [{"id": "a", "label": "A", "type": "person"}], "edges": [{"id": "e", "source": "a", "target": "a", "type": "owns", "label": "has"}]}', "ok", ["a"], [("e", "owns", "has")]),
    ('```json\n{"nodes": [{"id": "a"}]}\n```', "ok", ["a"], []),
    ('```\n{"nodes": [{"id": "a"}]}\n```', "ok", ["a"], []),
    ('{"nodes": [{"id": "a",},], "edges": [],}', "ok", ["a"], []),
    ('Here: {"nodes": [{"id": "a"}]} and more', "ok", ["a"], []),
    ('{"nodes": [{"id": 1}, {"id": 1.50}, {"id": 1e21}, {"id": false}, {"id": []}, {"id": [1, null]}, {"id": {}}]}', "ok", ["1", "1.5", "1e+21", "false", "1,", "[object Object]"], []),
    ('{"edges": [{"id": 1, "source": 2, "target": 3, "type": "a_b", "label": 9}]}', "ok", [], [("1", "a_b", "a b")]),
    ('{"edges": [{"id": "e", "source": "a", "target": "b"}]}', "ok", [], [("e", "related_to", "related to")]),
    ('{"edges": [{"id": "e", "source": "a"}, {"source": "a", "target": "b"}, 5, null]}', "ok", [], []),
    ('{"nodes": 5}', "ok", [], []),
    ("[]", "ok", [], []),
    ("null", "parse_error", None, None),
    ('"text"', "parse_error", None, None),
    ("no json here", "parse_error", None, None),
    ('[Note] {"nodes": []}', "parse_error", None, None),
    ("{'nodes': []}", "parse_error", None, None),
    ('{"nodes": [{"id": NaN}]}', "parse_error", None, None),
    ("", "parse_error", None, None),
    (None, "parse_error", None, None),
    ('{"nodes": [{"id": "x,}"}]}', "ok", ["x}"], []),
    ('{"nodes": [{"id": "a"}], "nodes": [{"id": "b"}]}', "ok", ["b"], []),
    ('﻿ {"nodes": [{"id": "  "}]}', "ok", ["  "], []),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, c[0], "x", "y") for k, c in enumerate(CASES)], "k int, raw string, status string, graph string")
    rows = parse_replies(df).orderBy("k").collect()
    assert len(rows) == len(CASES)
    for row, (raw, status, nodes, edges) in zip(rows, CASES, strict=True):
        assert row.status == status, raw
        if status == "ok":
            assert [n.id for n in row.graph.nodes] == nodes, raw
            assert [(e.id, e.type, e.label) for e in row.graph.edges] == edges, raw
        else:
            assert row.graph is None and row.error


def test_metadata_keeps_objects_and_arrays(spark):
    raw = '{"nodes": [{"id": "a", "metadata": {"b": [1]}}, {"id": "b", "metadata": [1]}, {"id": "c", "metadata": 3}, {"id": "d", "metadata": null}]}'
    nodes = parse_replies(spark.createDataFrame([(raw,)], "raw string")).first().graph.nodes
    assert [n.metadata.toJson() if n.metadata else None for n in nodes] == ['{"b":[1]}', "[1]", None, None]


def test_empty_table(spark):
    assert parse_replies(spark.createDataFrame([], "raw string")).count() == 0


def test_long_text(spark):
    raw = "x" * 200_000 + json.dumps({"nodes": [{"id": str(i)} for i in range(5000)]})
    assert len(parse_replies(spark.createDataFrame([(raw,)], "raw string")).first().graph.nodes) == 5000


@pytest.mark.parametrize(
    "raw,cut", [('{"a": 1', True), ('{"a": "x', True), ("[1]", False), ("text {", False), ('{"a": "}"}', False), ('{"a": "\\"', True), ("  [", True)]
)
def test_truncated(raw, cut):
    assert looks_truncated(raw) is cut


def test_balanced_quirks():
    assert balanced('a [1} b') == "[1}"
    never_closed = 'x \\{ {"a": "}"} y'
    assert balanced(never_closed) == never_closed
    assert balanced("none") == "none"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}[]",: \\\nab1', max_size=40))
def test_balanced_agrees_with_a_plain_scan(text):
    starts = [i for i, c in enumerate(text) if c in "{["]
    expected = text
    if starts:
        depth, quoted, escaped = 0, False, False
        for i in range(starts[0], len(text)):
            c = text[i]
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                depth += 1
            elif not quoted and c in "}]":
                depth -= 1
                if depth == 0:
                    expected = text[starts[0] : i + 1]
                    break
    assert balanced(text) == expected


def test_columns_and_python_agree(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        body = json.dumps({"nodes": [{"id": rng.choice(["a", 1, "x,}", None])} for _ in range(rng.randrange(3))]})
        body = rng.choice([body, body[:-2], body.replace("]", ",]"), "```json\n" + body + "\n```", "see: " + body + " end", body.replace('"', "'"), "[]", "null", " "])
        texts.append(body)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, raw string")
    fixed = {r.k: r.t for r in with_repaired(df, "raw", "t").collect()}
    status = {r.k: r.status for r in parse_replies(df).collect()}
    for k, text in enumerate(texts):
        assert fixed[k] == repaired_text(text) or (fixed[k].startswith(repaired_text(text))), text
        assert (status[k] == "ok") == (parse_failure(text) is None), text
