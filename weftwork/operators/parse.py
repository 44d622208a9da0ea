"""Strict parsing of repaired replies into graphs; errors are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import humanize
from weftwork.functions.variants import field, is_array, is_object, is_string, items, js_string
from weftwork.model import EDGE, NODE
from weftwork.operators.repair import with_repaired
from weftwork.session import spread


def _text_or(value: Column, default: Column) -> Column:
    return F.when(is_string(value), F.try_variant_get(value, "$", "string")).otherwise(default)


def _fields(values: Column, names: tuple[str, ...]) -> Column:
    """Each object's fields as a struct, so that every field is looked up once; other values are dropped."""
    return F.transform(F.filter(values, is_object), lambda v: F.struct(*(field(v, n).alias(n) for n in (*names, "metadata"))))


def _metadata(value: Column) -> Column:
    return F.when(is_object(value) | is_array(value), value).alias("metadata")


def parse_nodes(values: Column) -> Column:
    """Nodes of an array of values; what is no object or has no id is dropped."""
    made = F.transform(
        _fields(values, ("id", "label", "type")),
        lambda v: F.struct(
            js_string(v["id"]).alias("id"), F.coalesce(js_string(v["label"]), F.lit("")).alias("label"), _text_or(v["type"], F.lit("other")).alias("type"), _metadata(v["metadata"])
        ).cast(NODE),
    )
    return F.filter(made, lambda n: n["id"] != "")


def parse_edges(values: Column) -> Column:
    """Edges of an array of values; what is no object or lacks its id or an end is dropped."""
    typed = F.transform(
        _fields(values, ("id", "source", "target", "type", "label")),
        lambda v: F.struct(
            *(js_string(v[name]).alias(name) for name in ("id", "source", "target")),
            _text_or(v["type"], F.lit("related_to")).alias("type"), _text_or(v["label"], F.lit(None).cast("string")).alias("label"), _metadata(v["metadata"]),
        ).cast(EDGE),
    )
    kept = F.filter(typed, lambda e: (e["id"] != "") & (e["source"] != "") & (e["target"] != ""))
    return F.transform(kept, lambda e: e.withField("label", F.coalesce(e["label"], humanize(e["type"]))))


def parse_value(v: Column) -> Column:
    """``status, error, graph`` of a parsed reply (a VARIANT, null where it is no JSON).

    Status ``ok`` or ``parse_error``; a root array is an empty graph, other roots
    that are no object are errors.
    """
    ok = is_object(v) | is_array(v)
    return F.struct(
        F.when(ok, "ok").otherwise("parse_error").alias("status"),
        F.when(v.isNull(), "Failed to parse JSON").when(~ok, "Response is not a JSON object").alias("error"),
        F.when(ok, F.struct(parse_nodes(items(v, "nodes")).alias("nodes"), parse_edges(items(v, "edges")).alias("edges"))).alias("graph"),
    )


def parse_replies(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with ``status``, ``error`` and ``graph``; the reply is repaired first.

    Columns of those names in ``replies`` are replaced. The parsed value is read by
    several expressions, so it is a column of its own.
    """
    kept = [c for c in replies.columns if c not in ("status", "error", "graph")]
    read = with_repaired(spread(replies.select(*(F.col(f"`{c}`") for c in kept))), raw, "__text").withColumn("__v", F.try_parse_json("__text"))
    parsed = read.withColumn("__p", parse_value(F.col("__v")))
    return parsed.select(*(F.col(f"`{c}`") for c in kept), "__p.status", "__p.error", "__p.graph")
