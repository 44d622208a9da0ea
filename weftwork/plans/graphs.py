"""Queries of the graph pipeline over the test tables, with independent SQL.

Replies to parse are built from the node and edge tables (a block of fifty positions
of a graph makes one reply, with a defect by hash), so that SQL can state what must
come out of them without reading JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.model import SchemaSpec
from weftwork.operators import canvas as cv
from weftwork.operators import validate as va
from weftwork.operators.extract import extract, input_status, masked, replay, response_content
from weftwork.operators.parse import parse_replies
from weftwork.operators.repair import truncated_column
from weftwork.operators.prompt import prompt_column, prompts, schema_column
from weftwork.session import fresh_folder
from weftwork.sources.providers import RuleProvider
from weftwork.sources.tables import table
from weftwork.streaming.extract import deduplicated, flat_result, stream_extract, stream_folder, stream_table

BLOCK = 50


# --- prompts --------------------------------------------------------------------------


def _prompt_query(spec):
    def run(spark, folder):
        rows = table(spark, folder, "requests").where("text is not null")
        return rows.select("request_id", F.md5(prompt_column(F.col("text"), schema_column(spec))).alias("prompt_md5"))

    return run


def prompt_requests(spark, folder):
    made = prompts(table(spark, folder, "requests"), table(spark, folder, "graph_schemas"))
    return made.where("prompt is not null").select("request_id", F.md5("prompt").alias("prompt_md5"))


def empty_input_status(spark, folder):
    return table(spark, folder, "requests").groupBy(input_status(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


# --- replies --------------------------------------------------------------------------


def _blocks(rows, key, columns, name):
    """Arrays of JSON objects by graph and block, in order."""
    block = F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")
    item = F.struct("pos", key, F.struct(*columns).alias("v"))
    return rows.where("graph_id is not null and pos is not null").groupBy("graph_id", block).agg(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["v"]).alias(name))


def _built(spark, folder):
    """``graph_id, block, raw``: replies built from the tables."""
    nodes = _blocks(table(spark, folder, "nodes"), "node_key", ["id", "label", "type"], "nodes")
    edges = _blocks(table(spark, folder, "edges"), "edge_key", ["id", "source", "target", "type", "label"], "edges")
    both = nodes.join(edges, ["graph_id", "block"], "full")
    body = F.to_json(F.struct("nodes", "edges"))
    defect = F.pmod(F.col("graph_id") + F.col("block"), F.lit(5))
    raw = (
        F.when(defect == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(defect == 2, F.concat(F.lit("Here is the graph:\n"), body, F.lit("\nAnything else?")))
        .when(defect == 3, F.regexp_replace(body, r"\]\}$", ",\n]}"))
        .when(defect == 4, F.concat(F.lit("  \n"), body, F.lit("\n")))
        .otherwise(body)
    )
    return both.where(F.col("nodes").isNotNull() | F.col("edges").isNotNull()).select("graph_id", "block", raw.alias("raw"))


def _parsed(spark, folder, name, columns):
    parsed = parse_replies(_built(spark, folder))
    return parsed.select("graph_id", "block", F.posexplode(f"graph.{name}").alias("k", "v")).select("graph_id", "block", F.col("k").cast("bigint").alias("k"), *(f"v.{c}" for c in columns))


def parse_nodes(spark, folder):
    return _parsed(spark, folder, "nodes", ["id", "label", "type"])


def parse_edges(spark, folder):
    return _parsed(spark, folder, "edges", ["id", "source", "target", "type", "label"])


_REPLY = ["graph_id", "attempt", "received_at"]


def parse_table_replies(spark, folder):
    parsed = parse_replies(table(spark, folder, "replies"))
    sizes = [F.coalesce(F.size(f"graph.{n}"), F.lit(0)).cast("bigint").alias(f"n_{n}") for n in ("nodes", "edges")]
    return parsed.select(*_REPLY, "status", *sizes)


def _reply_items(spark, folder, name, columns):
    parsed = parse_replies(table(spark, folder, "replies"))
    return parsed.select(*_REPLY, F.posexplode(f"graph.{name}").alias("k", "v")).select(*_REPLY, F.col("k").cast("bigint").alias("k"), *(f"v.{c}" for c in columns))


def parse_reply_nodes(spark, folder):
    return _reply_items(spark, folder, "nodes", ["id", "label", "type"])


def parse_reply_edges(spark, folder):
    return _reply_items(spark, folder, "edges", ["id", "source", "target", "type", "label"])


def broken_replies(spark, folder):
    """Replies that begin with JSON which never closes."""
    rows = table(spark, folder, "replies").where("raw is not null")
    return rows.select(*_REPLY, truncated_column(F.col("raw")).alias("breaks_off"))


def validate_built(spark, folder):
    """Nested validation of the built replies."""
    checked = va.validate_graphs(parse_replies(_built(spark, folder)))
    v = F.col("validation")
    sizes = {"n_nodes": v["graph"]["nodes"], "n_edges": v["graph"]["edges"], "n_errors": v["errors"], "n_warnings": v["warnings"]}
    return checked.select("graph_id", "block", *(F.size(c).cast("bigint").alias(n) for n, c in sizes.items()), v["valid"].alias("valid"))


def validate_replies(spark, folder):
    """Nested validation of the real replies."""
    checked = va.validate_graphs(parse_replies(table(spark, folder, "replies"))).where("status = 'ok'")
    v = F.col("validation")
    sizes = {"n_nodes": v["graph"]["nodes"], "n_edges": v["graph"]["edges"], "n_errors": v["errors"], "n_warnings": v["warnings"]}
    return checked.select(*_REPLY, *(F.size(c).cast("bigint").alias(n) for n, c in sizes.items()), v["valid"].alias("valid"))


# --- flat validation ------------------------------------------------------------------


def _two(spark, folder):
    return table(spark, folder, "nodes"), table(spark, folder, "edges")


def validate_errors(spark, folder):
    return va.flat_errors(*_two(spark, folder))


def validate_warnings(spark, folder):
    return va.flat_warnings(*_two(spark, folder))


def validate_nodes(spark, folder):
    return va.flat_nodes(table(spark, folder, "nodes")).select("node_key", "id")


def validate_edges(spark, folder):
    return va.flat_edges(*_two(spark, folder)).select("edge_key", "id", "source", "target")


def validate_summary(spark, folder):
    return va.flat_summary(*_two(spark, folder))


# --- attempts -------------------------------------------------------------------------


def retry_outcome(spark, folder):
    return replay(table(spark, folder, "replies")).select("graph_id", "status", "attempts", "error")


def usage_totals(spark, folder):
    out = replay(table(spark, folder, "replies"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def response_text(spark, folder):
    """Content where the reply had stopped, else the reply as the reasoning beside it."""
    stopped = F.col("finish_reason") == "stop"
    rows = table(spark, folder, "replies")
    content = response_content(F.when(stopped, F.col("raw")), F.when(~stopped, F.col("raw")), F.when(stopped.isNull(), F.col("raw")))
    return rows.select(*_REPLY, F.md5(content).alias("content_md5"))


def mask_secrets(spark, folder):
    """A key in front of and behind each whole text."""
    key = F.concat(F.lit("sk-aB9_x-"), F.col("doc_id").cast("string"))
    message = F.concat(F.lit("LLM request failed: "), key, F.lit(" "), F.col("text"), F.lit(" "), key, F.lit("."))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(masked(message)).alias("message_md5"))


# --- canvas ---------------------------------------------------------------------------


def canvas_nodes(spark, folder):
    return cv.clean_nodes(table(spark, folder, "nodes"))


def canvas_edges(spark, folder):
    nodes, edges = _two(spark, folder)
    return cv.clean_edges(cv.clean_nodes(nodes), edges)


def canvas_measure(spark, folder):
    return cv.measured(cv.clean_nodes(table(spark, folder, "nodes"))).select("graph_id", "id", "width", "height", F.md5("text").alias("text_md5"), "color")


def canvas_edge_labels(spark, folder):
    rows = table(spark, folder, "edges").where("type is not null")
    return rows.select("edge_key", cv.edge_label(F.col("type"), F.col("label")).alias("label"))


def canvas_edge_sides(spark, folder):
    """Sides by the differences of the ends' measured widths and heights."""
    nodes, edges = _two(spark, folder)
    clean = cv.clean_nodes(nodes)
    links, boxes = cv.clean_edges(clean, edges), cv.measured(clean)
    for end in ("source", "target"):
        links = links.join(boxes.select("graph_id", F.col("id").alias(end), F.col("width").alias(f"{end}_w"), F.col("height").alias(f"{end}_h")), ["graph_id", end])
    sides = cv.edge_sides(F.col("source") == F.col("target"), F.col("target_w") - F.col("source_w"), F.col("target_h") - F.col("source_h"))
    return links.withColumn("s", sides).select("graph_id", "id", "s.from_side", "s.to_side")


def graph_components(spark, folder):
    nodes, edges = _two(spark, folder)
    clean = cv.clean_nodes(nodes.where("graph_id is not null"))
    return cv.with_components(clean, cv.clean_edges(clean, edges)).select("graph_id", "id", "component")


def component_anchor(spark, folder):
    nodes, edges = _two(spark, folder)
    clean = cv.clean_nodes(nodes.where("graph_id is not null"))
    return cv.with_components(clean, cv.clean_edges(clean, edges)).select("graph_id", "component", "anchor").distinct()


def canvas_pack(spark, folder):
    """All components of all graphs, each a stack of its measured boxes."""
    nodes, edges = _two(spark, folder)
    clean = cv.clean_nodes(nodes.where("graph_id is not null"))
    named = cv.with_components(clean, cv.clean_edges(clean, edges)).select("graph_id", "id", "component")
    boxes = cv.measured(clean).select("graph_id", "id", "width", "height").join(named, ["graph_id", "id"])
    stacks = boxes.groupBy("graph_id", "component").agg(F.max("width").alias("width"), F.sum("height").cast("int").alias("height"))
    return cv.packed(stacks.withColumn("anchor", F.md5("component")))


def canvas_positions(spark, folder):
    return cv.canvas(*_two(spark, folder))[0].drop("text")


def canvas_links(spark, folder):
    return cv.canvas(*_two(spark, folder))[1]


def canvas_boxes(spark, folder):
    """Size and colour of every placed node, and whether it lies within the padding."""
    done = cv.canvas(*_two(spark, folder))[0]
    return done.select("graph_id", "id", "width", "height", "color", ((F.col("x") >= 120) & (F.col("y") >= 120)).alias("inside"))


def canvas_link_ends(spark, folder):
    return cv.canvas(*_two(spark, folder))[1].drop("from_side", "to_side")


def canvas_document_sizes(spark, folder):
    """Items of each graph over all parts of its document."""
    docs = cv.documents(*cv.canvas(*_two(spark, folder)), part_items=100)
    v = F.parse_json("document")
    sizes = [F.sum(F.size(F.variant_get(v, f"$.{n}", "array<variant>"))).alias(f"n_{n}") for n in ("nodes", "edges")]
    return docs.groupBy("graph_id").agg(*sizes)


def canvas_documents(spark, folder):
    return cv.documents(*cv.canvas(*_two(spark, folder)))


# --- whole pipeline -------------------------------------------------------------------


def extract_documents(spark, folder):
    return flat_result(extract(table(spark, folder, "documents").select("doc_id", "text"), RuleProvider))


def extract_stream(spark, folder):
    out = fresh_folder(spark, "stream")
    stream_extract(stream_folder(spark, folder, "documents", ["doc_id", "text"]), f"{out}/rows", f"{out}/log", RuleProvider).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def stream_first_ids(spark, folder):
    """Ids of nodes as a stream sees them, each once, with state across batches."""
    out = fresh_folder(spark, "stream")
    seen = deduplicated(stream_folder(spark, folder, "nodes", ["graph_id", "id"]).where("id is not null"), ["graph_id", "id"])
    stream_table(seen, f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{out}/rows")


QUERIES = {
    f.__name__: f
    for f in (
        prompt_requests, empty_input_status, parse_nodes, parse_edges, parse_table_replies, parse_reply_nodes, parse_reply_edges, broken_replies, validate_built, validate_replies,
        validate_errors, validate_warnings, validate_nodes, validate_edges, validate_summary, retry_outcome, usage_totals, response_text, mask_secrets,
        canvas_nodes, canvas_edges, canvas_measure, canvas_edge_labels, canvas_edge_sides, graph_components, component_anchor, canvas_pack,
        canvas_positions, canvas_links, canvas_documents, canvas_boxes, canvas_link_ends, canvas_document_sizes, extract_documents, extract_stream, stream_first_ids,
    )
} | {
    "prompt_default": _prompt_query(SchemaSpec()),
    "prompt_limits": _prompt_query(SchemaSpec(max_nodes=25, max_edges=40)),
    "prompt_custom_schema": _prompt_query(SchemaSpec(("part", "maker"), (), "Use full names.", None, 7)),
}

# --- SQL ------------------------------------------------------------------------------

#: ECMAScript white space in RE2 notation.
WS = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(c):
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _opt(c):
    return f"nullif({_trim(c)}, '')"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


#: The prompt's end as it must be, written out here so that the SQL shares nothing with the operator.
_ASKED = """

OUTPUT FORMAT:
Return ONLY valid JSON with this exact structure:
{
  "nodes": [
    {"id": "node_1", "label": "Entity Name", "type": "entity_type"}
  ],
  "edges": [
    {"id": "edge_1", "source": "node_1", "target": "node_2", "type": "relation_type", "label": "human readable"}
  ]
}

RULES:
1. Output ONLY valid JSON: one object, no markdown code blocks, nothing in front of it or behind it
2. Within nodes and within edges no ID may occur twice; use sequential IDs as in the structure above
3. An edge counts only if both its ends are IDs of nodes in the same answer
4. Deduplicate entities: short forms and other spellings of a name belong to the node that is there already
5. Take relation types from the list above where one fits, else make one up, in lowercase_with_underscores
6. Take labels from the text, in its own language, and state nothing that the text does not say
7. If the text names no entity at all, return both lists empty
"""


def _prompt_sql(entity, relation, told, nodes, edges):
    """SQL text of a prompt, from SQL expressions of the schema's parts."""
    n, e = f"coalesce({nodes}, 0) <> 0", f"coalesce({edges}, 0) <> 0"
    return f"""md5(concat('Extract all entities and relationships from the following text as a JSON knowledge graph.', chr(10), chr(10), 'TEXT:', chr(10), text,
      chr(10), chr(10), 'ENTITY TYPES: ', {entity}, chr(10), chr(10), 'RELATIONSHIP TYPES: ', {relation}, chr(10),
      CASE WHEN coalesce({told}, '') <> '' THEN concat(chr(10), 'ADDITIONAL INSTRUCTIONS:', chr(10), {told}) ELSE '' END, chr(10),
      CASE WHEN {n} OR {e} THEN concat(chr(10), 'OUTPUT LIMITS:', chr(10), CASE WHEN {n} THEN concat('- max nodes: ', {nodes}) ELSE '' END,
        CASE WHEN {n} AND {e} THEN chr(10) ELSE '' END, CASE WHEN {e} THEN concat('- max edges: ', {edges}) ELSE '' END) ELSE '' END,
      {_quoted(_ASKED)},
      CASE WHEN {n} THEN concat('8. Return at most ', {nodes}, ' nodes') ELSE '' END, chr(10),
      CASE WHEN {e} THEN concat(chr(10), CASE WHEN {n} THEN '9' ELSE '8' END, '. Return at most ', {edges}, ' edges') ELSE '' END, chr(10),
      CASE WHEN {n} OR {e} THEN concat(chr(10), CASE WHEN {n} AND {e} THEN '10' ELSE '9' END, '. If limits are reached, keep only the most salient entities and relationships') ELSE '' END,
      chr(10), chr(10), 'JSON:'))"""


_E = "'person, organization, location, date, product, event, concept, other'"
_R = "'works_for, founded, acquired, located_in, born_in, died_in, married_to, subsidiary_of, created, member_of, produced_by, part_of, owns, related_to'"


_COMMA = r"regexp_replace({}, ',(" + WS + r"*[}}\]])', '\1', 'g')"


def _uncomma(c):
    return _COMMA.replace("{}", c).replace("}}", "}")


_BUILT = f"""
  n AS (SELECT graph_id, pos // {BLOCK} AS block, pos, node_key, {_uncomma("id")} AS id, {_uncomma("coalesce(label, '')")} AS label, {_uncomma("coalesce(type, 'other')")} AS type
    FROM nodes WHERE graph_id IS NOT NULL AND pos IS NOT NULL),
  e AS (SELECT graph_id, pos // {BLOCK} AS block, pos, edge_key, {_uncomma("id")} AS id, {_uncomma("source")} AS source, {_uncomma("target")} AS target,
      {_uncomma("coalesce(type, 'related_to')")} AS type, {_uncomma("coalesce(label, replace(coalesce(type, 'related_to'), '_', ' '))")} AS label
    FROM edges WHERE graph_id IS NOT NULL AND pos IS NOT NULL),
  pn AS (SELECT * FROM n WHERE id <> ''),
  pe AS (SELECT * FROM e WHERE id <> '' AND source <> '' AND target <> '')"""

def _dump(*columns):
    """JSON of a row's columns that are not null."""
    parts = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN concat('"{c}":', to_json({c})) END""" for c in columns)
    return f"concat('{{', concat_ws(',', {parts}), '}}')"


_FLAT = """
  known AS (SELECT DISTINCT graph_id, id FROM nodes WHERE id <> ''),
  flagged AS (SELECT e.*, s.id IS NOT NULL AS source_ok, t.id IS NOT NULL AS target_ok FROM (SELECT * FROM edges WHERE id <> '') e
    LEFT JOIN known s ON s.graph_id = e.graph_id AND s.id = e.source LEFT JOIN known t ON t.graph_id = e.graph_id AND t.id = e.target),
  errors AS (
    SELECT graph_id, 0 AS phase, pos, node_key AS row_key, id, row_number() OVER (PARTITION BY graph_id, id ORDER BY pos, node_key) AS nth, """ + _dump("id", "label", "type") + """ AS dump FROM nodes
    UNION ALL SELECT graph_id, 1, pos, edge_key, id, row_number() OVER (PARTITION BY graph_id, id ORDER BY pos, edge_key), """ + _dump("id", "source", "target", "type", "label") + """ FROM edges),
  found AS (SELECT graph_id, phase, pos, row_key, CASE WHEN coalesce(id, '') = '' THEN CASE phase WHEN 0 THEN 'missing_node_id' ELSE 'missing_edge_id' END ELSE 'duplicate_id' END AS type,
      CASE WHEN id <> '' THEN concat('Duplicate ', CASE phase WHEN 0 THEN 'node' ELSE 'edge' END, ' id: ', id) ELSE concat(CASE phase WHEN 0 THEN 'Node' ELSE 'Edge' END, ' missing id: ', dump) END AS message
    FROM errors WHERE coalesce(id, '') = '' OR nth > 1),
  warned AS (
    SELECT graph_id, pos, edge_key AS row_key, 0 AS ord, 'invalid_edge_source' AS type, concat('Edge ', id, ' references non-existent source: ', coalesce(source, 'undefined')) AS message, id AS edge_id FROM flagged WHERE NOT source_ok
    UNION ALL SELECT graph_id, pos, edge_key, 1, 'invalid_edge_target', concat('Edge ', id, ' references non-existent target: ', coalesce(target, 'undefined')), id FROM flagged WHERE NOT target_ok
    UNION ALL SELECT graph_id, pos, edge_key, 2, 'removed_edge', concat('Removed invalid edge: ', id), id FROM flagged WHERE NOT (source_ok AND target_ok))"""

_CLEAN = f"""
  cn0 AS (SELECT graph_id, pos, node_key, {_opt("id")} AS id, {_opt("label")} AS label, {_opt("type")} AS type FROM nodes),
  cn AS (SELECT graph_id, pos, id, coalesce(label, id) AS label, coalesce(type, 'other') AS type FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY pos, node_key) AS nth FROM cn0 WHERE id IS NOT NULL) WHERE nth = 1),
  ce0 AS (SELECT graph_id, pos, edge_key, {_opt("id")} AS id, {_opt("source")} AS source, {_opt("target")} AS target, {_opt("type")} AS type, {_opt("label")} AS label FROM edges),
  ce AS (SELECT graph_id, pos, id, source, target, coalesce(type, 'related_to') AS type, coalesce(label, replace(coalesce(type, 'related_to'), '_', ' ')) AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY pos, edge_key) AS nth FROM ce0
    WHERE id IS NOT NULL AND EXISTS (SELECT 1 FROM cn WHERE cn.graph_id = ce0.graph_id AND cn.id = ce0.source)
      AND EXISTS (SELECT 1 FROM cn WHERE cn.graph_id = ce0.graph_id AND cn.id = ce0.target)) WHERE nth = 1)"""

#: UTF-16 length: two units beyond the basic plane.
_LEN = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _lines(text, room):
    words = f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"
    cells = f"list_transform({words}, lambda w: {{'l': {_LEN.format('w')}::INT, 'c': -1}})"
    over = f"CASE WHEN x.l % {room} = 0 THEN {room} ELSE x.l % {room} END"
    step = (
        f"{{'l': (CASE WHEN s.c = 0 THEN s.l + x.l // {room} WHEN s.c + 1 + x.l <= {room} THEN s.l ELSE s.l + 1 + greatest(0, x.l - 1) // {room} END)::INT, "
        f"'c': (CASE WHEN s.c = 0 THEN {over} WHEN s.c + 1 + x.l <= {room} THEN s.c + 1 + x.l ELSE {over} END)::INT}}"
    )
    return f"list_reduce(list_prepend({{'l': 1, 'c': 0}}, {cells}), lambda s, x: {step}).l"


_COLOR = """CASE type WHEN 'person' THEN '#dc2626' WHEN 'organization' THEN '#0f766e' WHEN 'location' THEN '#0891b2' WHEN 'date' THEN '#ca8a04'
    WHEN 'product' THEN '#7c3aed' WHEN 'event' THEN '#2563eb' WHEN 'concept' THEN '#15803d' ELSE '#475569' END"""
#: A reply from raw to strict JSON: ``r0`` numbers the rows, ``cut`` is the first balanced bracket expression, ``v`` what parses.
_TOKEN = r'(?s)"(?:[^"\\]|\\.)*"?|\\.|[{}\[\]]|[^"\\{}\[\]]+'
_WHOLE = r'(?s)"(?:[^"\\]|\\.)*"'


def _depth(tok):
    return f"CASE WHEN {tok} IN ('{{', '[') THEN 1 WHEN {tok} IN ('}}', ']') THEN -1 ELSE 0 END"


_REPAIRED = rf"""
  r0 AS (SELECT *, row_number() OVER () AS rid, {_trim("raw")} AS trimmed FROM replies),
  r1 AS (SELECT rid, trimmed, CASE WHEN starts_with(trimmed, '```') AND ends_with(trimmed, '```')
      THEN coalesce(nullif({_trim("regexp_extract(trimmed, '(?s)^```(?:json)?" + WS + "*(.*?)" + WS + "*```$', 1)")}, ''), trimmed) ELSE trimmed END AS plain FROM r0),
  r2 AS (SELECT rid, trimmed, plain, regexp_extract(plain, '(?s)[{{\[].*') AS tail FROM r1),
  toks AS (SELECT rid, unnest(l) AS tok, unnest(range(len(l))) AS i FROM (SELECT rid, regexp_extract_all(tail, '{_TOKEN}') AS l FROM r2 WHERE tail <> '')),
  deep AS (SELECT rid, tok, i, sum({_depth("tok")}) OVER (PARTITION BY rid ORDER BY i) AS depth, sum(length(tok)) OVER (PARTITION BY rid ORDER BY i) AS upto FROM toks),
  ends AS (SELECT rid, min(upto) AS upto FROM deep WHERE depth = 0 GROUP BY rid),
  r3 AS (SELECT r2.rid, trimmed, {_uncomma("CASE WHEN ends.upto IS NOT NULL THEN left(tail, ends.upto::BIGINT) ELSE plain END")} AS text FROM r2 LEFT JOIN ends USING (rid)),
  alltoks AS (SELECT rid, unnest(l) AS tok, unnest(range(len(l))) AS i FROM (SELECT rid, regexp_extract_all(trimmed, '{_TOKEN}') AS l FROM r1 WHERE trimmed[1] IN ('{{', '['))),
  broken AS (SELECT rid, sum({_depth("tok")}) > 0 OR bool_or(tok[1] = '"' AND NOT regexp_full_match(tok, '{_WHOLE}')) AS breaks_off FROM alltoks GROUP BY rid),
  r AS (SELECT r0.* EXCLUDE (rid, trimmed), r0.rid, r3.text, coalesce(breaks_off, false) AS breaks_off, json_valid(r3.text) AS valid, CASE WHEN json_valid(r3.text) THEN r3.text::JSON END AS v
    FROM r0 LEFT JOIN r3 USING (rid) LEFT JOIN broken USING (rid)),
  p AS (SELECT *, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN 'ok' ELSE 'parse_error' END AS status,
    CASE WHEN v IS NULL THEN 'Failed to parse JSON' WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN 'Response is not a JSON object' END AS error FROM r)"""


def _js(x, name):
    """A field as ECMAScript writes it."""
    f = f"json_extract({x}, '$.{name}')"
    number = f"CASE WHEN {f}::DOUBLE = floor({f}::DOUBLE) THEN {f}::DOUBLE::BIGINT::VARCHAR ELSE {f}::DOUBLE::VARCHAR END"
    return (
        f"CASE json_type({f}) WHEN 'VARCHAR' THEN json_extract_string({x}, '$.{name}') WHEN 'DOUBLE' THEN {number} WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN '[object Object]' "
        f"WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract_string({f}, '$[*]'), lambda y: coalesce(y, '')), ',') ELSE {f}::VARCHAR END"
    )


def _string(x, name):
    return f"CASE json_type(json_extract({x}, '$.{name}')) WHEN 'VARCHAR' THEN json_extract_string({x}, '$.{name}') END"


_ITEMS = f"""{_REPAIRED},
  ni AS (SELECT rid, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT rid, json_extract(v, '$.nodes[*]') AS l FROM p WHERE json_type(json_extract(v, '$.nodes')) = 'ARRAY')),
  ei AS (SELECT rid, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT rid, json_extract(v, '$.edges[*]') AS l FROM p WHERE json_type(json_extract(v, '$.edges')) = 'ARRAY')),
  rn AS (SELECT rid, i, {_js("x", "id")} AS id, coalesce({_js("x", "label")}, '') AS label, coalesce({_string("x", "type")}, 'other') AS type FROM ni WHERE json_type(x) = 'OBJECT'),
  re0 AS (SELECT rid, i, {_js("x", "id")} AS id, {_js("x", "source")} AS source, {_js("x", "target")} AS target, coalesce({_string("x", "type")}, 'related_to') AS type,
      {_string("x", "label")} AS said FROM ei WHERE json_type(x) = 'OBJECT'),
  gn AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS k FROM rn WHERE id <> ''),
  ge AS (SELECT *, coalesce(said, replace(type, '_', ' ')) AS label, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS k FROM re0 WHERE id <> '' AND source <> '' AND target <> '')"""

_RETRY = f"""{_REPAIRED},
  a AS (SELECT * FROM p WHERE graph_id IS NOT NULL AND attempt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY graph_id, attempt
    ORDER BY raw NULLS FIRST, finish_reason NULLS FIRST, prompt_tokens NULLS FIRST, completion_tokens NULLS FIRST) = 1),
  b AS (SELECT *, coalesce({_trim("raw")}, '') = '' AS empty, row_number() OVER w AS nth, coalesce(raw = lag(raw) OVER w, false) AS again FROM a WINDOW w AS (PARTITION BY graph_id ORDER BY attempt)),
  c AS (SELECT *, empty OR status = 'ok' OR again OR coalesce(finish_reason = 'stop' AND breaks_off, false) AS stops FROM b),
  d AS (SELECT *, coalesce(sum(stops::INT) OVER (PARTITION BY graph_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM c WHERE nth <= 3),
  f AS (SELECT *, max(nth) OVER (PARTITION BY graph_id) AS attempts FROM d WHERE over = 0 QUALIFY nth = max(nth) OVER (PARTITION BY graph_id)),
  o AS (SELECT graph_id, CASE WHEN empty THEN 'provider_error' ELSE status END AS status, attempts,
      CASE WHEN empty THEN 'Empty response from LLM' WHEN status <> 'ok' THEN concat(error, CASE WHEN coalesce(finish_reason, '') <> '' THEN concat(' (finish_reason: ', finish_reason, ')') ELSE '' END) END AS error,
      CASE WHEN NOT empty AND status = 'ok' THEN prompt_tokens END AS prompt_tokens, CASE WHEN NOT empty AND status = 'ok' THEN completion_tokens END AS completion_tokens FROM f)"""

#: The offline provider: words of a line that are one capital and small letters, the defect by id.
_EXTRACTED = f"""
  d AS (SELECT doc_id, text, doc_id % 8 AS defect FROM documents WHERE coalesce({_trim("text")}, '') <> ''),
  ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)),
  wd AS (SELECT doc_id, k, list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}')) AS l FROM ln),
  nm AS (SELECT doc_id, k, unnest(l) AS name, unnest(range(len(l))) AS i FROM wd),
  pr AS (SELECT doc_id, name, lag(name) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM nm),
  c AS (SELECT d.doc_id, defect, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM d LEFT JOIN (
    SELECT doc_id, count(DISTINCT name) AS n, count(*) FILTER (before IS NOT NULL AND before <> name) AS e FROM pr GROUP BY 1) USING (doc_id)),
  x AS (SELECT doc_id, 'ok' AS status, n + (defect = 5 AND n > 0)::INT AS n_nodes, e AS n_edges, (defect = 5 AND n > 0)::BIGINT AS n_errors,
      (CASE WHEN defect = 4 THEN CASE WHEN n > 0 THEN 2 ELSE 3 END ELSE 0 END)::BIGINT AS n_warnings, NOT (defect = 5 AND n > 0) AS valid FROM c
    UNION ALL SELECT doc_id, 'input_error', 0, 0, 0, 0, false FROM documents WHERE coalesce({_trim("text")}, '') = '')"""

_BOXES = f"""
  w AS (SELECT *, greatest(220, least(360, 220 + 4 * greatest(0, least({_LEN.format("label")} - 12, 32))))::INT AS width FROM cn),
  rooms AS (SELECT *, greatest(16, (width - 48) // 8)::INT AS r8, greatest(16, (width - 48) // 9)::INT AS r9 FROM w),
  boxes AS (SELECT graph_id, id, width, greatest(110, least(220, 92 + 30 * {_lines("label", "r8")} + 22 * {_lines("concat('Type: ', type)", "r9")}))::INT AS height,
    md5(concat('# ', label, chr(10), chr(10), 'Type: ', type)) AS text_md5, {_COLOR} AS color FROM rooms)"""
_MEASURED = f"{_CLEAN}, {_BOXES}"
_REACH = f"""{_CLEAN},
  vertices AS (SELECT * FROM cn WHERE graph_id IS NOT NULL),
  links AS (SELECT DISTINCT graph_id, source AS a, target AS b FROM ce UNION SELECT DISTINCT graph_id, target, source FROM ce),
  reach AS (SELECT graph_id, id AS a, id AS b FROM vertices UNION SELECT r.graph_id, r.a, l.b FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.a = r.b)"""

ORACLE = {
    "prompt_default": f"SELECT request_id, {_prompt_sql(_E, _R, 'NULL::VARCHAR', 'NULL::INT', 'NULL::INT')} AS prompt_md5 FROM requests WHERE text IS NOT NULL",
    "prompt_limits": f"SELECT request_id, {_prompt_sql(_E, _R, 'NULL::VARCHAR', '25', '40')} AS prompt_md5 FROM requests WHERE text IS NOT NULL",
    "prompt_custom_schema": f"""SELECT request_id, {_prompt_sql("'part, maker'", "''", "'Use full names.'", "NULL::INT", "7")} AS prompt_md5 FROM requests WHERE text IS NOT NULL""",
    "prompt_requests": f"""SELECT request_id, {_prompt_sql(f"coalesce(array_to_string(entity_types, ', '), CASE WHEN entity_types IS NULL THEN {_E} ELSE '' END)",
        f"coalesce(array_to_string(relation_types, ', '), CASE WHEN relation_types IS NULL THEN {_R} ELSE '' END)", "instructions", "max_nodes", "max_edges")} AS prompt_md5
        FROM requests LEFT JOIN graph_schemas USING (schema_id) WHERE text IS NOT NULL""",
    "empty_input_status": f"SELECT CASE WHEN coalesce({_trim('text')}, '') <> '' THEN 'ok' ELSE 'input_error' END AS status, count(*) AS n FROM requests GROUP BY 1",
    "parse_nodes": f"WITH {_BUILT} SELECT graph_id, block::BIGINT AS block, row_number() OVER (PARTITION BY graph_id, block ORDER BY pos, node_key) - 1 AS k, id, label, type FROM pn",
    "parse_edges": f"WITH {_BUILT} SELECT graph_id, block::BIGINT AS block, row_number() OVER (PARTITION BY graph_id, block ORDER BY pos, edge_key) - 1 AS k, id, source, target, type, label FROM pe",
    "parse_table_replies": f"""WITH {_ITEMS}, n AS (SELECT rid, count(*) AS c FROM gn GROUP BY 1), e AS (SELECT rid, count(*) AS c FROM ge GROUP BY 1)
  SELECT graph_id, attempt, received_at, status, coalesce(n.c, 0) AS n_nodes, coalesce(e.c, 0) AS n_edges FROM p LEFT JOIN n USING (rid) LEFT JOIN e USING (rid)""",
    "parse_reply_nodes": f"WITH {_ITEMS} SELECT graph_id, attempt, received_at, k, id, label, gn.type FROM gn JOIN p USING (rid)",
    "parse_reply_edges": f"WITH {_ITEMS} SELECT graph_id, attempt, received_at, k, id, source, target, ge.type, label FROM ge JOIN p USING (rid)",
    "validate_replies": f"""WITH {_ITEMS},
  n AS (SELECT rid, count(*) AS c, count(*) - count(DISTINCT id) AS dup FROM gn GROUP BY 1),
  known_ends AS (SELECT rid, EXISTS (SELECT 1 FROM gn WHERE gn.rid = ge.rid AND gn.id = ge.source) AS s, EXISTS (SELECT 1 FROM gn WHERE gn.rid = ge.rid AND gn.id = ge.target) AS t, id FROM ge),
  e AS (SELECT rid, count(*) FILTER (s AND t) AS c, count(*) - count(DISTINCT id) AS dup, sum((NOT s)::INT + (NOT t)::INT + (NOT (s AND t))::INT) AS w FROM known_ends GROUP BY 1)
  SELECT graph_id, attempt, received_at, coalesce(n.c, 0) AS n_nodes, coalesce(e.c, 0) AS n_edges, (coalesce(n.dup, 0) + coalesce(e.dup, 0))::BIGINT AS n_errors,
    coalesce(w, 0)::BIGINT AS n_warnings, coalesce(n.dup, 0) + coalesce(e.dup, 0) = 0 AS valid FROM p LEFT JOIN n USING (rid) LEFT JOIN e USING (rid) WHERE status = 'ok'""",
    "broken_replies": f"WITH {_REPAIRED} SELECT graph_id, attempt, received_at, breaks_off FROM p WHERE raw IS NOT NULL",
    "extract_documents": f"WITH {_EXTRACTED} SELECT * FROM x",
    "stream_first_ids": "SELECT DISTINCT graph_id, id FROM nodes WHERE id IS NOT NULL",
    "extract_stream": f"WITH {_EXTRACTED} SELECT * FROM x",
    "validate_built": f"""WITH {_BUILT},
  keys AS (SELECT DISTINCT graph_id, block FROM n UNION SELECT DISTINCT graph_id, block FROM e),
  good AS (SELECT pe.*, EXISTS (SELECT 1 FROM pn WHERE pn.graph_id = pe.graph_id AND pn.block = pe.block AND pn.id = pe.source) AS s,
      EXISTS (SELECT 1 FROM pn WHERE pn.graph_id = pe.graph_id AND pn.block = pe.block AND pn.id = pe.target) AS t FROM pe),
  a AS (SELECT graph_id, block, count(*) AS n_nodes, count(*) - count(DISTINCT id) AS dup FROM pn GROUP BY 1, 2),
  b AS (SELECT graph_id, block, count(*) FILTER (s AND t) AS n_edges, count(*) - count(DISTINCT id) AS dup, sum((NOT s)::INT + (NOT t)::INT + (NOT (s AND t))::INT) AS w FROM good GROUP BY 1, 2)
  SELECT graph_id, block::BIGINT AS block, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, (coalesce(a.dup, 0) + coalesce(b.dup, 0))::BIGINT AS n_errors,
    coalesce(w, 0)::BIGINT AS n_warnings, coalesce(a.dup, 0) + coalesce(b.dup, 0) = 0 AS valid
  FROM keys LEFT JOIN a USING (graph_id, block) LEFT JOIN b USING (graph_id, block)""",
    "validate_errors": f"WITH {_FLAT} SELECT * FROM found",
    "validate_warnings": f"WITH {_FLAT} SELECT * FROM warned",
    "validate_nodes": "SELECT node_key, id FROM nodes WHERE id <> ''",
    "validate_edges": f"WITH {_FLAT} SELECT edge_key, id, source, target FROM flagged WHERE source_ok AND target_ok",
    "validate_summary": f"""WITH {_FLAT},
  g AS (SELECT graph_id FROM nodes UNION SELECT graph_id FROM edges),
  c AS (SELECT g.graph_id, (SELECT count(*) FROM nodes n WHERE n.graph_id IS NOT DISTINCT FROM g.graph_id AND n.id <> '') AS n_nodes,
    (SELECT count(*) FROM flagged f WHERE f.graph_id IS NOT DISTINCT FROM g.graph_id AND source_ok AND target_ok) AS n_edges,
    (SELECT count(*) FROM found f WHERE f.graph_id IS NOT DISTINCT FROM g.graph_id) AS n_errors,
    (SELECT count(*) FROM warned w WHERE w.graph_id IS NOT DISTINCT FROM g.graph_id) AS n_warnings FROM g)
  SELECT *, n_errors = 0 AS valid FROM c""",
    "retry_outcome": f"WITH {_RETRY} SELECT graph_id, status, attempts, error FROM o",
    "usage_totals": f"""WITH {_RETRY} SELECT status, count(*) AS n, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens FROM o GROUP BY 1""",
    "response_text": f"SELECT graph_id, attempt, received_at, md5(CASE WHEN {_trim('raw')} <> '' THEN raw END) AS content_md5 FROM replies",
    "mask_secrets": """SELECT doc_id, md5(regexp_replace(concat('LLM request failed: sk-aB9_x-', doc_id, ' ', text, ' sk-aB9_x-', doc_id, '.'), 'sk-[A-Za-z0-9_-]+', 'sk-***', 'g')) AS message_md5
  FROM documents WHERE text IS NOT NULL""",
    "canvas_nodes": f"WITH {_CLEAN} SELECT graph_id, pos, id, label, type FROM cn",
    "canvas_edges": f"WITH {_CLEAN} SELECT graph_id, pos, id, source, target, type, label FROM ce",
    "canvas_measure": f"WITH {_MEASURED} SELECT graph_id, id, width, height, text_md5, color FROM boxes",
    "canvas_edge_labels": f"""WITH t AS (SELECT edge_key, type, {_trim("label")} AS told, replace(type, '_', ' ') AS words FROM edges WHERE type IS NOT NULL)
  SELECT edge_key, CASE WHEN coalesce(told, '') = '' THEN words
    WHEN array_to_string(list_filter(regexp_split_to_array(lower(told), '{WS}+'), lambda w: w <> ''), ' ') = array_to_string(list_filter(regexp_split_to_array(lower(words), '{WS}+'), lambda w: w <> ''), ' ') THEN told
    ELSE type END AS label FROM t""",
    "canvas_edge_sides": f"""WITH {_MEASURED}, d AS (SELECT ce.graph_id, ce.id, source = target AS same, t.width - s.width AS dx, t.height - s.height AS dy
    FROM ce JOIN boxes s ON s.graph_id = ce.graph_id AND s.id = ce.source JOIN boxes t ON t.graph_id = ce.graph_id AND t.id = ce.target)
  SELECT graph_id, id, CASE WHEN same THEN 'right' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'right' ELSE 'left' END WHEN dy >= 0 THEN 'bottom' ELSE 'top' END AS from_side,
    CASE WHEN same THEN 'top' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx >= 0 THEN 'left' ELSE 'right' END WHEN dy >= 0 THEN 'top' ELSE 'bottom' END AS to_side FROM d""",
    "graph_components": f"""WITH RECURSIVE {_REACH}
  SELECT graph_id, a AS id, min(b) AS component FROM reach GROUP BY graph_id, a""",
    "canvas_boxes": f"""WITH {_MEASURED} SELECT graph_id, id, width, height, color, true AS inside FROM boxes WHERE graph_id IS NOT NULL""",
    "canvas_link_ends": f"""WITH {_CLEAN} SELECT graph_id, pos, id, source AS from_node, target AS to_node, '#64748b' AS color,
    CASE WHEN array_to_string(list_filter(regexp_split_to_array(lower(label), '{WS}+'), lambda w: w <> ''), ' ') = array_to_string(list_filter(regexp_split_to_array(lower(replace(type, '_', ' ')), '{WS}+'), lambda w: w <> ''), ' ')
      THEN label ELSE type END AS label FROM ce WHERE graph_id IS NOT NULL""",
    "canvas_document_sizes": f"""WITH {_CLEAN}, n AS (SELECT graph_id, count(*) AS n_nodes FROM cn GROUP BY 1), e AS (SELECT graph_id, count(*) AS n_edges FROM ce GROUP BY 1)
  SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e USING (graph_id) WHERE graph_id IS NOT NULL""",
    "component_anchor": f"""WITH RECURSIVE {_REACH},
  named AS (SELECT graph_id, a AS id, min(b) AS component FROM reach GROUP BY graph_id, a)
  SELECT graph_id, component, id AS anchor FROM named QUALIFY row_number() OVER (PARTITION BY graph_id, component ORDER BY id COLLATE en, id) = 1""",
    "canvas_pack": f"""WITH RECURSIVE {_REACH}, {_BOXES},
  named AS (SELECT graph_id, a AS id, min(b) AS component FROM reach GROUP BY graph_id, a),
  s AS (SELECT graph_id, component, max(width) AS w, sum(height) AS h, md5(component) AS anchor FROM boxes JOIN named USING (graph_id, id) GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY w * h DESC, anchor) AS n,
    greatest(1400, ceil(sqrt(sum(w * h) OVER (PARTITION BY graph_id)) * 1.4) + 240) AS goal FROM s),
  p AS (SELECT graph_id, n, component, 120 AS x, 120 AS y, 120 + w + 240 AS nx, h AS row FROM t WHERE n = 1
    UNION ALL SELECT t.graph_id, t.n, t.component, CASE WHEN p.nx > 120 AND p.nx + t.w > goal THEN 120 ELSE p.nx END, CASE WHEN p.nx > 120 AND p.nx + t.w > goal THEN p.y + p.row + 240 ELSE p.y END,
      CASE WHEN p.nx > 120 AND p.nx + t.w > goal THEN 120 ELSE p.nx END + t.w + 240, CASE WHEN p.nx > 120 AND p.nx + t.w > goal THEN t.h ELSE greatest(p.row, t.h) END
    FROM p JOIN t ON t.graph_id = p.graph_id AND t.n = p.n + 1)
  SELECT graph_id, component, x::BIGINT AS "left", y::BIGINT AS top FROM p""",
}
