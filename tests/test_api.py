import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

import weftwork
from weftwork import ExtractionError, Extractor, ExtractorConfig, ProviderConfig, ProviderError, ReplyParseError, SchemaSpec, create_extractor
from weftwork.operators.extract import extract as extract_rows
from weftwork.sources.providers import HttpProvider, Reply, RuleProvider

CONFIG = ExtractorConfig(ProviderConfig("rule"), schema=SchemaSpec(("thing",), max_nodes=2), max_retries=0)


class Fixed:
    """Answers always the same, or raises; remembers the prompts it saw in this process."""

    def __init__(self, content):
        self.content = content

    def complete(self, key, prompt, attempt):
        if isinstance(self.content, Exception):
            raise self.content
        return Reply(self.content.replace("PROMPT", json.dumps(prompt)[1:-1]), "stop", 1, 2)


def fixed(content):
    return lambda spec, temperature: Fixed(content)


def test_root_exports():
    assert all(getattr(weftwork, name) is not None for name in weftwork.__all__)
    with pytest.raises(AttributeError):
        weftwork.nothing_of_this_name


def test_extract_and_precedence(spark):
    extractor = create_extractor(CONFIG, make=lambda spec, temperature: RuleProvider())
    found = extractor.extract("Alice met Bob and Carl.")
    assert [n["label"] for n in found.graph["nodes"]] == ["Alice", "Bob"] and found.warnings == [] and found.usage["prompt_tokens"] > 0
    assert len(extractor.extract("Alice met Bob and Carl.", schema=SchemaSpec()).graph["nodes"]) == 3
    asked = Extractor(CONFIG, make=fixed('{"nodes": [{"id": "1", "label": "PROMPT"}]}'))
    assert "ENTITY TYPES: thing\n" in asked.extract("x").graph["nodes"][0]["label"]
    assert "ENTITY TYPES: call\n" in asked.extract("x", schema=SchemaSpec(("call",))).graph["nodes"][0]["label"]
    heat = Extractor(CONFIG, make=lambda spec, temperature: Fixed(json.dumps({"nodes": [{"id": str(temperature)}]})))
    assert heat.extract("x", temperature=0.0).graph["nodes"][0]["id"] == "0.0"


def test_typed_errors(spark):
    with pytest.raises(ExtractionError, match="cannot be empty"):
        Extractor(CONFIG).extract(" \n")
    with pytest.raises(ProviderError, match="down"):
        Extractor(CONFIG, make=fixed(ProviderError("down"))).extract("x")
    with pytest.raises(ReplyParseError, match="finish_reason: stop") as caught:
        Extractor(CONFIG, make=fixed("no graph")).extract("x")
    assert caught.value.raw == "no graph"


def test_single_values(spark):
    assert weftwork.parse_graph('```json\n{"nodes": [{"id": 1}]}\n```')["nodes"][0]["id"] == "1"
    with pytest.raises(ReplyParseError):
        weftwork.parse_graph("5")
    assert weftwork.validate({"nodes": [{"id": "a"}, {"id": "a"}]})["errors"][0]["type"] == "duplicate_id"
    assert "TEXT:\nhello\n" in weftwork.build_prompt("hello")


@pytest.mark.parametrize(
    "graph",
    [
        {"nodes": [{"id": 1}, {"id": "1"}, {"id": True}, {"id": {}}, {"id": 0}, {}, 7], "edges": [{"id": "a", "source": 1, "target": True}, {"id": "b", "source": 2, "target": 1}, {"id": "c", "source": 1.0, "target": "1"}, {"source": 1, "target": 1}]},
        {"nodes": [{"id": "x", "metadata": {"k": 1}}, {"id": "x"}], "edges": [{"id": "e", "source": "x", "target": "x"}, {"id": "f", "source": "x", "target": None}]},
        {"nodes": None}, [], {},
    ],
)
def test_validated_graph_has_as_many_items_as_the_report(spark, graph):
    report = weftwork.validate(graph)
    assert (len(report["graph"]["nodes"]), len(report["graph"]["edges"])) == (report["n_nodes"], report["n_edges"])
    assert all(n in graph["nodes"] for n in report["graph"]["nodes"])


@pytest.mark.parametrize("raw", ['{"nodes": [{"id": "a"}]}', '{"nodes": [{"id": "\\ud800"}]}', "[" * 1100 + "]" * 1100, '{"a": 1e999}', "no graph"])
def test_status_is_the_parsers(spark, raw):
    """A reply that the call loop takes and the parser refuses is a parse error, never an ok without a graph."""
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    row = extract_rows(docs, lambda: Fixed(raw)).first()
    assert (row.status == "ok") == (row.validation is not None) and (row.status == "ok" or row.error)


def test_calls_in_flight_give_the_same(spark):
    docs = spark.createDataFrame([(k, f"Alice{k} met Bob and Carl") for k in range(30)], "doc_id bigint, text string")
    one, four = (sorted((r.doc_id, r.status, r.raw) for r in extract_rows(docs, RuleProvider, in_flight=n).collect()) for n in (1, 4))
    assert one == four


ANSWERS = {
    "good": {"choices": [{"message": {"content": "{}"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}},
    "list": [1, 2],
    "odd": {"choices": [{"message": "text"}]},
    "odder": {"choices": {"a": 1}},
    "blank": {"choices": [{"message": {"content": " "}}]},
}


class Service(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    connections = set()

    def do_POST(self):
        Service.connections.add(self.client_address)
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        told = asked["messages"][0]["content"]
        body = b"key sk-secret-1" if told == "error" else json.dumps(ANSWERS[told]).encode()
        self.send_response(500 if told == "error" else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield HttpProvider(ProviderConfig("own", "m", f"http://127.0.0.1:{server.server_port}/v1", stop=("x",), response_format="json_schema"))
    server.shutdown()


def test_http(service):
    Service.connections.clear()
    assert service.complete(1, "good", 0) == service.complete(1, "good", 1) == Reply("{}", "stop", 3, 4)
    assert len(Service.connections) == 1
    for told in ("list", "odd", "odder", "blank", "error"):
        with pytest.raises(ProviderError) as caught:
            service.complete(1, told, 0)
        assert "sk-secret" not in str(caught.value)
