"""The library's front: a reusable extractor, and single values where a table is more than is asked for."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.model import MAX_RETRIES, ExtractionError, ExtractorConfig, ProviderError, ReplyParseError, SchemaSpec, effective_schema
from weftwork.operators import canvas as cv
from weftwork.operators.extract import extract as extract_rows
from weftwork.operators.parse import parse_replies
from weftwork.operators.prompt import prompt_column, schema_column
from weftwork.operators.validate import validate_raw
from weftwork.session import prepare
from weftwork.sources.providers import Provider, http_provider


@dataclass(frozen=True)
class ExtractionResult:
    """A graph with what was found wrong with it, the reply it came from and the tokens it took."""

    graph: dict[str, Any]
    warnings: list[dict[str, Any]]
    raw: str
    usage: dict[str, int] | None


class Extractor:
    """Extraction under one configuration, over a table of texts or of a single one.

    ``make`` builds the provider in the task that uses it, from the schema and
    temperature in force; without it the configured service is asked.
    """

    def __init__(self, config: ExtractorConfig, make: Callable[[SchemaSpec, float | None], Provider] | None = None, in_flight: int = 1):
        self.config, self.in_flight = config, in_flight
        self._make = make or (lambda spec, temperature: http_provider(config, spec, temperature))

    def transform(self, documents: DataFrame, schema: SchemaSpec | None = None, temperature: float | None = None) -> DataFrame:
        """``extract`` of ``doc_id, text``; a schema or temperature of the call goes before the configured one."""
        prepare(documents.sparkSession)
        spec, make = effective_schema(schema, self.config.schema), self._make
        retries = MAX_RETRIES if self.config.max_retries is None else self.config.max_retries
        return extract_rows(documents, lambda: make(spec, temperature), spec, retries, in_flight=self.in_flight)

    def extract(self, text: str, schema: SchemaSpec | None = None, temperature: float | None = None) -> ExtractionResult:
        """One text; what would be a status in a table is raised here."""
        found = self.transform(_session().createDataFrame([(0, text)], "doc_id bigint, text string"), schema, temperature)
        row = found.select("status", "error", "raw", "prompt_tokens", "completion_tokens", F.to_json("validation").alias("v")).first()
        if row.status == "input_error":
            raise ExtractionError(row.error)
        if row.status == "provider_error":
            raise ProviderError(row.error)
        if row.status != "ok":
            raise ReplyParseError(row.error, row.raw or "")
        found = json.loads(row.v)
        usage = {n: row[n] for n in ("prompt_tokens", "completion_tokens") if row[n] is not None}
        return ExtractionResult(found["graph"], found["warnings"], row.raw, usage or None)


def create_extractor(config: ExtractorConfig, **options) -> Extractor:
    """An extractor to keep for many extractions."""
    return Extractor(config, **options)


def extract(text: str, config: ExtractorConfig, **options) -> ExtractionResult:
    """One text under a configuration."""
    return Extractor(config, **options).extract(text)


def _session() -> SparkSession:
    return prepare(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())


def build_prompt(text: str, schema: SchemaSpec | None = None) -> str:
    """The prompt for one text."""
    return _session().range(1).select(prompt_column(F.lit(text), schema_column(effective_schema(schema, None))).alias("p")).first().p


def parse_graph(raw: str) -> dict[str, Any]:
    """The graph of one reply; a reply that holds none raises ``ReplyParseError``."""
    row = parse_replies(_session().createDataFrame([(raw,)], "raw string")).select("status", "error", F.to_json("graph").alias("g")).first()
    if row.status != "ok":
        raise ReplyParseError(row.error, raw)
    return json.loads(row.g)


def _identity(value: Any) -> Any:
    """What an id is compared by; None for what is no id. Ids of different kinds differ, lists and objects equal nothing."""
    if isinstance(value, (dict, list)):
        return object()
    if not value:
        return None
    return ("number", float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else (type(value), value)


def validate(graph: Any) -> dict[str, Any]:
    """``valid, errors, warnings, n_nodes, n_edges, graph`` of one graph as it stands, ids of any kind.

    The ``graph`` holds, as they were, the nodes with an id and the edges with an id and
    both ends among them.
    """
    value = _session().createDataFrame([(json.dumps(graph),)], "raw string").select(F.try_parse_json("raw").alias("value"))
    report = json.loads(validate_raw(value, "value").select(F.to_json("report").alias("r")).first().r)
    lists = {n: graph.get(n) if isinstance(graph, dict) else None for n in ("nodes", "edges")}
    nodes, edges = ([x for x in (v if isinstance(v, list) else []) if isinstance(x, dict) and _identity(x.get("id")) is not None] for v in lists.values())
    known = {_identity(n["id"]) for n in nodes}
    return report | {"graph": {"nodes": nodes, "edges": [e for e in edges if _identity(e.get("source")) in known and _identity(e.get("target")) in known]}}


def to_canvas(nodes: DataFrame, edges: DataFrame, options: cv.CanvasOptions | None = None) -> DataFrame:
    """``graph_id, part, n_parts, document``: positioned canvas documents of node and edge tables."""
    prepare(nodes.sparkSession)
    return cv.documents(*cv.canvas(nodes, edges, options or cv.CanvasOptions()))
