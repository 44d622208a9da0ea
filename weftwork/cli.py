"""Command line: ``extract`` (default), ``validate FILE``, ``canvas FILE``.

Exit codes: 0 done, 1 extraction failed, 2 invalid graph, 3 file, 4 configuration.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftwork import __version__
from weftwork.model import CanvasOptions, ExtractorConfig, SchemaSpec
from weftwork.operators import canvas as cv
from weftwork.operators.extract import extract
from weftwork.operators.validate import validate_raw
from weftwork.session import prepare
from weftwork.sources.files import dump, read_input, read_schema
from weftwork.sources.providers import RuleProvider, http_provider, positive_int, resolve_provider

OK, FAILED, INVALID, FILE, CONFIG = range(5)
USAGE = """usage: weftwork [extract options] | validate FILE [--pretty] | canvas FILE [-o FILE] [--pretty]
extract options: -i FILE, -o FILE, -s SCHEMA, -m MODEL, -p (pretty), --provider TYPE, --base-url URL,
  --api-key KEY, --stop TEXT (repeatable), --response-format json_object|json_schema, --max-nodes N, --max-edges N
"""
#: Flags with a value, and the names they set.
_VALUES = {
    "-i": "input", "--input": "input", "-o": "output", "--output": "output", "-s": "schema", "--schema": "schema", "-m": "model", "--model": "model",
    "--provider": "provider", "--base-url": "base_url", "--api-key": "api_key", "--response-format": "response_format", "--max-nodes": "max_nodes", "--max-edges": "max_edges",
}


def parse_args(argv: list[str]) -> dict:
    """Flags by name; unknown ones are ignored."""
    args: dict = {"stop": [], "pretty": False}
    rest = iter(argv)
    for word in rest:
        if word in ("-p", "--pretty"):
            args["pretty"] = True
        elif word == "--stop":
            args["stop"].append(next(rest, ""))
        elif word in _VALUES:
            args[_VALUES[word]] = next(rest, None)
        elif not word.startswith("-"):
            args.setdefault("files", []).append(word)
    return args


def _say(message: str) -> None:
    sys.stderr.write(message + "\n")


def _write(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)


def session() -> SparkSession:
    builder = SparkSession.builder.appName("weftwork").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    return prepare(builder.master("local[2]").getOrCreate() if "MASTER" not in os.environ else builder.getOrCreate())


def _graph_file(args: dict) -> str | None:
    path = (args.get("files") or [None])[0]
    if path is None or not Path(path).exists():
        _say(f"Graph file not found: {path}")
        return None
    text = Path(path).read_text(encoding="utf-8")
    try:
        json.loads(text)
    except ValueError:
        _say(f"Invalid JSON in graph file: {path}")
        return None
    return text


def run_validate(args: dict) -> int:
    """Report on standard output, always."""
    text = _graph_file(args)
    if text is None:
        return FILE
    df = session().createDataFrame([(text,)], "raw string").select(F.try_parse_json("raw").alias("value"))
    report = json.loads(validate_raw(df, "value").select(F.to_json("report").alias("r")).first().r)
    sys.stdout.write(dump(report, args["pretty"]))
    return OK if report.get("valid") else INVALID


def run_canvas(args: dict) -> int:
    text = _graph_file(args)
    if text is None:
        return FILE
    df = session().createDataFrame([(text,)], "raw string").select(F.try_parse_json("raw").alias("v"))

    def rows(name, fields, key):
        # only strings and numbers can be names here
        value = lambda f: F.when(F.regexp_extract(F.schema_of_variant(F.try_variant_get("x", f"$.{f}", "variant")), "^[A-Z]+", 0) != "BOOLEAN", F.try_variant_get("x", f"$.{f}", "string"))
        exploded = df.select(F.posexplode(F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "x"))
        return exploded.select(F.lit(0).cast("bigint").alias("graph_id"), "pos", F.col("pos").cast("bigint").alias(key), *(value(f).alias(f) for f in fields))

    nodes = rows("nodes", ("id", "label", "type"), "node_key")
    edges = rows("edges", ("id", "source", "target", "type", "label"), "edge_key")
    document = {
        name: [json.loads(r.item) for r in shown.orderBy("pos", "id").select(F.to_json("item").alias("item")).toLocalIterator()]
        for name, shown in zip(("nodes", "edges"), map(cv.items, cv.canvas(nodes, edges, CanvasOptions()), ("nodes", "edges")), strict=True)
    }
    _write(dump(document, args["pretty"]), args.get("output"))
    return OK


def run_extract(args: dict) -> int:
    try:
        text = read_input(args.get("input"))
    except OSError as error:
        _say(str(error))
        return FILE
    if not text.strip():
        _say("Input text is empty")
        return FAILED
    spec = SchemaSpec()
    if args.get("schema"):
        try:
            spec = read_schema(args["schema"])
        except (OSError, ValueError) as error:
            _say(str(error))
            return FILE
    try:
        limits = {name: positive_int(args.get(name), f"--{name.replace('_', '-')}") for name in ("max_nodes", "max_edges")}
    except ValueError as error:
        _say(str(error))
        return CONFIG
    spec = spec.limited(**limits)
    try:
        provider = resolve_provider(args)
    except ValueError as error:
        _say(str(error))
        return FAILED
    if not provider.model and provider.type != "rule":
        _say("A model is required (-m)")
        return CONFIG
    make = RuleProvider if provider.type == "rule" else lambda: http_provider(ExtractorConfig(provider), spec)
    docs = session().createDataFrame([(0, text)], "doc_id bigint, text string")
    row = extract(docs, make, spec).select("status", "error", F.substring("raw", 1, 200).alias("raw"), F.to_json("validation").alias("v")).first()
    if row.status != "ok":
        _say(row.error or row.status)
        if row.raw:
            _say(row.raw)
        return FAILED
    result = json.loads(row.v)
    for warning in result["warnings"]:
        _say(f"Warning: {warning['message']}")
    _write(dump(result["graph"], args["pretty"]), args.get("output"))
    return OK


def main(argv: list[str]) -> int:
    if "-h" in argv or "--help" in argv:
        sys.stdout.write(USAGE)
        return OK
    if "-v" in argv or "--version" in argv:
        sys.stdout.write(f"{__version__}\n")
        return OK
    command = argv[0] if argv and argv[0] in ("validate", "canvas", "extract") else "extract"
    args = parse_args(argv[1:] if argv and argv[0] == command else argv)
    return {"validate": run_validate, "canvas": run_canvas, "extract": run_extract}[command](args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
