"""Text to validated knowledge graphs on PySpark."""

__version__ = "0.2.0"

#: What the package gives at its root, by the module that holds it; imported when first asked for.
_EXPORTS = {
    "api": ("ExtractionResult", "Extractor", "build_prompt", "create_extractor", "extract", "parse_graph", "to_canvas", "validate"),
    "model": (
        "CanvasOptions", "EDGE", "ENTITY_TYPES", "ERROR", "ExtractionError", "ExtractorConfig", "GRAPH", "NODE", "ProviderConfig", "ProviderError",
        "RELATION_TYPES", "ReplyParseError", "SchemaSpec", "WARNING", "effective_schema",
    ),
    "operators.canvas": ("canvas", "documents"),
    "operators.parse": ("parse_replies",),
    "operators.prompt": ("prompts", "resolve_schema", "response_schema"),
    "operators.validate": ("flat_edges", "flat_errors", "flat_nodes", "flat_summary", "flat_warnings", "validate_graphs"),
    "session": ("prepare",),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}
__all__ = ["__version__", *sorted(_HOME)]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
