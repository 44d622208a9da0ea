import pytest
from pyspark.sql import functions as F

from weftwork.model import ENTITY_TYPES, ExtractorConfig, ProviderConfig, ProviderError, SchemaSpec, effective_schema
from weftwork.operators.extract import annotated, extract, input_status, masked, replay, response_content
from weftwork.operators.prompt import prompt_column, response_format, schema_column
from weftwork.sources.providers import Reply, RuleProvider, api_key, base_url, call, http_provider, mask_secrets, positive_int, reply_content, resolve_provider, stop_sequences


def prompt(spark, spec, text="T"):
    return spark.range(1).select(prompt_column(F.lit(text), schema_column(spec)).alias("p")).first().p


@pytest.mark.parametrize(
    "spec,between,after",
    [
        (SchemaSpec(), "\n\n\n\n", "\n\n\n\nJSON:"),
        (SchemaSpec(instructions="I"), "\n\nADDITIONAL INSTRUCTIONS:\nI\n\n\n", "\n\n\n\nJSON:"),
        (SchemaSpec(max_nodes=5), "\n\n\nOUTPUT LIMITS:\n- max nodes: 5\n\n", "8. Return at most 5 nodes\n\n\n9. If limits"),
        (SchemaSpec(max_edges=7), "\n\n\nOUTPUT LIMITS:\n- max edges: 7\n\n", "\n\n8. Return at most 7 edges\n\n9. If limits"),
        (SchemaSpec(max_nodes=5, max_edges=7), "\n\n\nOUTPUT LIMITS:\n- max nodes: 5\n- max edges: 7\n\n", "8. Return at most 5 nodes\n\n9. Return at most 7 edges\n\n10. If limits"),
        (SchemaSpec(max_nodes=0), "\n\n\n\n", "\n\n\n\nJSON:"),
    ],
)
def test_prompt_layout(spark, spec, between, after):
    text = prompt(spark, spec)
    relations = text.split("RELATIONSHIP TYPES: ")[1]
    assert relations.split("related_to", 1)[1].startswith(between + "OUTPUT FORMAT:")
    assert after in text.split("7. ")[1].split("\n", 1)[1] or text.split("7. ")[1].split("\n", 1)[1].startswith(after)
    assert "ENTITY TYPES: " + ", ".join(ENTITY_TYPES) in text


@pytest.mark.parametrize(
    "phrase",
    ["TEXT:\nT", "ENTITY TYPES: person", "RELATIONSHIP TYPES: works_for", "Output ONLY valid JSON", '"nodes":', '"edges":', '"id": "node_1"', '"source": "node_1"',
     "no markdown code blocks", "Deduplicate entities", "sequential IDs", "lowercase_with_underscores", "OUTPUT LIMITS:", "- max nodes: 12", "- max edges: 18",
     "Return at most 12 nodes", "Return at most 18 edges", "keep only the most salient entities and relationships", "ADDITIONAL INSTRUCTIONS:\nFocus."],
)
def test_prompt_phrases(spark, phrase):
    assert phrase in prompt(spark, SchemaSpec(instructions="Focus.", max_nodes=12, max_edges=18))


def test_prompt_without_instructions(spark):
    assert "ADDITIONAL INSTRUCTIONS" not in prompt(spark, SchemaSpec()) and "OUTPUT LIMITS" not in prompt(spark, SchemaSpec())
    assert "ENTITY TYPES: person, company, product" in prompt(spark, SchemaSpec(("person", "company", "product")))
    assert "RELATIONSHIP TYPES: works_for, owns" in prompt(spark, SchemaSpec(None, ("works_for", "owns")))


def test_empty_lists_stay_empty_and_text_is_raw(spark):
    text = prompt(spark, SchemaSpec((), ()), text='  "x"\n{y} ')
    assert "ENTITY TYPES: \n\nRELATIONSHIP TYPES: \n" in text and 'TEXT:\n  "x"\n{y} \n\nENTITY' in text
    assert prompt(spark, SchemaSpec(), None) is None


def test_schema_precedence():
    configured = SchemaSpec(max_nodes=3)
    assert effective_schema(SchemaSpec(("x",)), configured) == SchemaSpec(("x",)).resolved()
    assert effective_schema(None, configured).max_nodes == 3 and effective_schema(None, None).entity_types == ENTITY_TYPES
    assert configured.limited(None, 4) == SchemaSpec(max_nodes=3, max_edges=4) and configured.limited(5).max_nodes == 5


def test_response_format():
    schema = response_format("json_schema", SchemaSpec(max_nodes=5, max_edges=7))["json_schema"]["schema"]
    assert schema["properties"]["nodes"]["maxItems"] == 5 and schema["properties"]["edges"]["maxItems"] == 7
    assert "maxItems" not in response_format("json_schema", SchemaSpec())["json_schema"]["schema"]["properties"]["nodes"]
    assert response_format("json_object", SchemaSpec()) == {"type": "json_object"}


def test_schema_file():
    spec = SchemaSpec.from_json({"entityTypes": ["a", 1], "relationTypes": "x", "instructions": 3, "maxNodes": 4, "maxEdges": "5"})
    assert spec == SchemaSpec(("a", 1), None, None, 4, None)


def test_settings():
    env = {"WEFTWORK_PROVIDER": "ollama", "WEFTWORK_STOP": " a, ,b ", "WEFTWORK_MODEL": "m"}
    config = resolve_provider({"model": "n"}, env)
    assert (config.type, config.model, config.stop) == ("ollama", "n", ("a", "b"))
    assert base_url(config).endswith(":11434/v1") and api_key(config, {}) == ""
    assert api_key(ProviderConfig("openai"), {"OPENAI_API_KEY": "k"}) == "k"
    with pytest.raises(ValueError):
        base_url(ProviderConfig("elsewhere"))
    with pytest.raises(ValueError):
        stop_sequences(list("abcde"), None)
    with pytest.raises(ValueError):
        resolve_provider({"response_format": "xml"}, {})
    assert positive_int("12abc", "n") == 12 and positive_int("1.9", "n") == 1 and positive_int(None, "n") is None
    for bad in ("0", "-3", "x"):
        with pytest.raises(ValueError):
            positive_int(bad, "n")
    assert http_provider(ExtractorConfig(ProviderConfig(), temperature=0.0, max_tokens=9), SchemaSpec()).temperature == 0.0


def test_content_and_masks(spark):
    assert reply_content({"content": " ", "reasoning_content": " r "}) == " r "
    assert reply_content(None) is None
    assert mask_secrets("key sk-ab_c-9!") == "key sk-***!"
    row = spark.range(1).select(
        response_content(F.lit(" "), F.lit(None).cast("string"), F.lit("x ")).alias("c"),
        masked(F.lit("a sk-a-b_c d")).alias("m"),
        annotated(F.lit("E"), F.lit("stop")).alias("a"),
        annotated(F.lit("E"), F.lit(None).cast("string")).alias("b"),
        input_status(F.lit(" ﻿")).alias("i"),
    ).first()
    assert tuple(row) == ("x ", "a sk-*** d", "E (finish_reason: stop)", "E", "input_error")


class Scripted:
    def __init__(self, *replies):
        self.replies, self.calls = replies, 0

    def complete(self, key, prompt, attempt):
        self.calls += 1
        reply = self.replies[min(attempt, len(self.replies) - 1)]
        if isinstance(reply, Exception):
            raise reply
        return reply


CUT, GOOD = '{"nodes": [', '{"nodes": []}'
RETRIES = [
    ([Reply(CUT, "stop")], "parse_error", 1),
    ([Reply(CUT + "1", "length"), Reply(CUT + "2", "length"), Reply(CUT + "3", "length")], "parse_error", 3),
    ([Reply("bad", "x"), Reply("bad", "x")], "parse_error", 2),
    ([Reply("bad"), Reply(GOOD, "stop", 3, 4)], "ok", 2),
    ([Reply(GOOD)], "ok", 1),
]


@pytest.mark.parametrize("replies,status,calls", [*RETRIES, ([ProviderError("Empty response from LLM")], "provider_error", 1)])
def test_retry_loop(replies, status, calls):
    provider = Scripted(*replies)
    outcome = call(provider, 1, "p")
    assert (outcome.status, provider.calls, outcome.attempts) == (status, calls, calls)
    if replies[0] == Reply(CUT, "stop"):
        assert "(finish_reason: stop)" in outcome.error


def test_replay_agrees_with_loop(spark):
    rows = [(g, a, r.content, r.finish_reason, r.prompt_tokens, r.completion_tokens) for g, (replies, _, _) in enumerate(RETRIES) for a, r in enumerate(replies)]
    rows += [(9, 0, None, None, None, None), (9, 1, GOOD, None, 1, 1), (3, 1, GOOD, "stop", 3, 4)]
    df = spark.createDataFrame(rows, "graph_id bigint, attempt int, raw string, finish_reason string, prompt_tokens bigint, completion_tokens bigint")
    out = {r.graph_id: r for r in replay(df).collect()}
    for g, (_, status, calls) in enumerate(RETRIES):
        assert (out[g].status, out[g].attempts) == (status, calls)
    assert out[9].status == "provider_error" and out[9].attempts == 1
    assert (out[3].prompt_tokens, out[3].completion_tokens) == (3, 4)


def test_extract_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Alice met Bob.", " \n", None, "Carl saw Dora and Carl", "Eve", "Finn met Gus", "Hal met Ida", "x"])], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in extract(docs, RuleProvider).collect()}
    assert len(rows) == 8 and rows[1].status == rows[2].status == "input_error"
    assert [n.label for n in rows[0].validation.graph.nodes] == ["Alice", "Bob"]
    assert rows[6].attempts == 2 and rows[6].status == "ok"
    assert not rows[5].validation.valid


def test_rule_provider_takes_all_names_unless_asked(spark):
    names = ["N" + chr(97 + k // 26) + chr(97 + k % 26) + "o" for k in range(60)]
    docs = spark.createDataFrame([(0, " ".join(names) + "\nOUTPUT LIMITS:\n- max nodes: 2\n")], "doc_id bigint, text string")

    def graph(*spec):
        return extract(docs, RuleProvider, *spec).first().validation.graph

    whole = graph()
    assert [n.label for n in whole.nodes] == names and len(whole.edges) == 59
    few = graph(SchemaSpec(max_nodes=7, max_edges=40))
    assert [n.label for n in few.nodes] == names[:7] and len(few.edges) == 6
