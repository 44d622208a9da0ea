"""Row types, vocabularies, options and errors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# The default vocabularies, in prompt order.
ENTITY_TYPES = ("person", "organization", "location", "date", "product", "event", "concept", "other")
RELATION_TYPES = (
    "works_for", "founded", "acquired", "located_in", "born_in", "died_in", "married_to",
    "subsidiary_of", "created", "member_of", "produced_by", "part_of", "owns", "related_to",
)

_S = T.StringType()
NODE = T.StructType([T.StructField(n, _S) for n in ("id", "label", "type")] + [T.StructField("metadata", T.VariantType())])
EDGE = T.StructType([T.StructField(n, _S) for n in ("id", "source", "target", "type", "label")] + [T.StructField("metadata", T.VariantType())])
GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
ERROR = T.StructType([T.StructField("type", _S), T.StructField("message", _S), T.StructField("details", T.MapType(_S, _S))])
WARNING = T.StructType([T.StructField("type", _S), T.StructField("message", _S), T.StructField("edge_id", _S), T.StructField("details", T.MapType(_S, _S))])
SCHEMA = T.StructType(
    [T.StructField("entity_types", T.ArrayType(_S)), T.StructField("relation_types", T.ArrayType(_S)), T.StructField("instructions", _S)]
    + [T.StructField(n, T.IntegerType()) for n in ("max_nodes", "max_edges")]
)


class ExtractionError(Exception):
    """Anything that ends the extraction of one text."""


class ReplyParseError(ExtractionError):
    """A reply that holds no graph; keeps the reply."""

    def __init__(self, message: str, raw: str):
        super().__init__(message)
        self.raw = raw


class ProviderError(ExtractionError):
    """A failed or empty call; keeps the original error."""

    def __init__(self, message: str, original: Exception | None = None):
        super().__init__(message)
        self.original = original


@dataclass(frozen=True)
class SchemaSpec:
    """What to extract. None means the default vocabulary; an empty list stays empty."""

    entity_types: tuple[str, ...] | None = None
    relation_types: tuple[str, ...] | None = None
    instructions: str | None = None
    max_nodes: int | None = None
    max_edges: int | None = None

    def resolved(self) -> SchemaSpec:
        return replace(
            self,
            entity_types=ENTITY_TYPES if self.entity_types is None else tuple(self.entity_types),
            relation_types=RELATION_TYPES if self.relation_types is None else tuple(self.relation_types),
        )

    def limited(self, max_nodes: int | None = None, max_edges: int | None = None) -> SchemaSpec:
        """With limits given elsewhere, such as on the command line, in front of its own, each for itself."""
        return replace(self, max_nodes=self.max_nodes if max_nodes is None else max_nodes, max_edges=self.max_edges if max_edges is None else max_edges)

    @classmethod
    def from_json(cls, data: dict) -> SchemaSpec:
        """From a schema file's object: fields of the wrong type are left out, list items are not checked."""

        def a_list(key):
            return tuple(data[key]) if isinstance(data.get(key), list) else None

        def a_number(key):
            value = data.get(key)
            return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None

        text = data.get("instructions")
        return cls(a_list("entityTypes"), a_list("relationTypes"), text if isinstance(text, str) else None, a_number("maxNodes"), a_number("maxEdges"))


@dataclass(frozen=True)
class ProviderConfig:
    type: str = "lmstudio"
    model: str = ""
    base_url: str | None = None
    api_key: str | None = None
    stop: tuple[str, ...] = ()
    response_format: str | None = None


@dataclass(frozen=True)
class ExtractorConfig:
    provider: ProviderConfig
    schema: SchemaSpec | None = None
    temperature: float | None = None
    max_tokens: int | None = None
    max_retries: int | None = None


def effective_schema(call: SchemaSpec | None, configured: SchemaSpec | None) -> SchemaSpec:
    """A schema of the call replaces the configured one as a whole; without either the defaults hold."""
    return (call or configured or SchemaSpec()).resolved()


#: Defaults of a call.
TEMPERATURE, MAX_TOKENS, MAX_RETRIES, TIMEOUT_S = 0.3, 2048, 2, 120


@dataclass(frozen=True)
class CanvasOptions:
    """Knobs of the canvas export; sizes in pixels.

    ``align`` names the side whose neighbours a layer is lined up with (U the one
    before, D the one behind) and which of two middle neighbours counts (L, R), '' for
    the middle of both. ``ranker`` ``longest-path`` leaves out the tightening of ranks;
    ``acyclicer`` ``greedy`` reverses few edges, anything else those that close a cycle
    in a depth-first walk.
    """

    padding: int = 120
    component_gap: int = 240
    rankdir: str = "LR"
    align: str = "UL"
    nodesep: int = 70
    edgesep: int = 40
    ranksep: int = 160
    ranker: str = "network-simplex"
    acyclicer: str = "greedy"
    #: Components with more nodes are layered by distributed passes instead of in one task.
    layout_limit: int = 5000
