"""Text to graph: prompt, provider, parse, validate; and the retry rules over stored attempts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import js_trim
from weftwork.model import MAX_RETRIES, SchemaSpec
from weftwork.operators.parse import parse_replies, parse_value
from weftwork.operators.prompt import prompt_column, schema_column
from weftwork.operators.repair import truncated_column, with_repaired
from weftwork.operators.validate import validate_column
from weftwork.session import spread, written
from weftwork.sources.providers import Provider, call

_CALLED = "doc_id bigint, status string, error string, raw string, finish_reason string, attempts int, prompt_tokens bigint, completion_tokens bigint"


def input_status(text: Column) -> Column:
    """``input_error`` for a null or blank text, else ``ok``."""
    return F.when(F.coalesce(js_trim(text) != "", F.lit(False)), "ok").otherwise("input_error")


def response_content(content: Column, reasoning: Column, reasoning_alt: Column) -> Column:
    """The first that is not blank, untrimmed."""
    return F.coalesce(*(F.when(js_trim(c) != "", c) for c in (content, reasoning, reasoning_alt)))


def masked(message: Column) -> Column:
    """Keys replaced, also those with hyphens and underscores."""
    return F.regexp_replace(message, r"sk-[A-Za-z0-9_-]+", "sk-***")


def annotated(message: Column, finish_reason: Column) -> Column:
    """An error with the finish reason behind it, if there is one."""
    return F.concat(message, F.when(F.coalesce(finish_reason != "", F.lit(False)), F.concat(F.lit(" (finish_reason: "), finish_reason, F.lit(")"))).otherwise(""))


def call_provider(documents: DataFrame, make: Callable[[], Provider], spec: SchemaSpec, max_retries: int = MAX_RETRIES, in_flight: int = 1) -> DataFrame:
    """Replies for ``doc_id, text``; one provider a task, made where it runs, with ``in_flight`` calls at a time.

    Blank texts are filtered before, since nothing pushes a filter through Python.
    """
    asked = spread(documents.select("doc_id", "text")).where(input_status(F.col("text")) == "ok").select("doc_id", prompt_column(F.col("text"), schema_column(spec)).alias("prompt"))

    def ask(batches):
        provider = make()
        with ThreadPoolExecutor(in_flight) if in_flight > 1 else nullcontext() as pool:
            for batch in batches:
                keys, texts = batch["doc_id"].tolist(), batch["prompt"].tolist()
                outcomes = (pool.map if pool else map)(lambda d, p: call(provider, d, p, max_retries), keys, texts)
                out = [(d, o.status, o.error, o.raw, o.finish_reason, o.attempts, o.prompt_tokens, o.completion_tokens) for d, o in zip(keys, outcomes, strict=True)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _CALLED.split(", ")]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return asked.mapInPandas(ask, _CALLED)


def extract(
    documents: DataFrame, make: Callable[[], Provider], spec: SchemaSpec | None = None, max_retries: int = MAX_RETRIES, keep: bool = True, in_flight: int = 1
) -> DataFrame:
    """One row a document: ``doc_id, status, error, raw, attempts, prompt_tokens, completion_tokens, validation``.

    Status is ``ok``, ``input_error``, ``parse_error`` or ``provider_error``; nothing
    raises. Whether a reply holds a graph is for the parser to say: where the call loop
    took a reply that the parser refuses, the row is a ``parse_error``. With ``keep`` the replies are written before anything reads them, since
    asking again costs and may answer otherwise; a lost task still asks again, so
    calls happen at least once.
    """
    called = call_provider(documents, make, (spec or SchemaSpec()).resolved(), max_retries, in_flight)
    if keep and not documents.isStreaming:
        called = written(called, "replies")
    parsed = parse_replies(called.withColumnsRenamed({"status": "said", "error": "problem"}))
    refused = (F.col("said") == "ok") & (F.col("status") != "ok")
    told = parsed.select(
        "doc_id",
        F.when(refused, F.col("status")).otherwise(F.col("said")).alias("status"),
        F.when(refused, annotated(F.col("error"), F.col("finish_reason"))).otherwise(F.col("problem")).alias("error"),
        "raw",
        "attempts",
        "prompt_tokens",
        "completion_tokens",
        validate_column(F.when(F.col("said") == "ok", F.col("graph"))).alias("validation"),
    )
    blank = documents.where(input_status(F.col("text")) != "ok").select("doc_id", F.lit("input_error").alias("status"), F.lit("Input text cannot be empty").alias("error"))
    return told.unionByName(blank, allowMissingColumns=True)


def replay(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The retry rules over stored attempts (``graph_id, attempt, raw, finish_reason, prompt_tokens, completion_tokens``).

    ``graph_id, status, attempts, error, prompt_tokens, completion_tokens``: what the
    loop would have ended with. Attempts beyond the retries and behind the first that
    parses or forbids another are not made. A null reply is an empty response, which
    ends the loop. Of equal attempts the one with the smaller reply counts.
    """
    key = ["graph_id", "attempt"]
    rows = attempts.select("graph_id", "attempt", "raw", "finish_reason", "prompt_tokens", "completion_tokens").where("graph_id is not null and attempt is not null")
    rows = rows.groupBy(*key).agg(F.min(F.struct("raw", "finish_reason", "prompt_tokens", "completion_tokens")).alias("r")).select(*key, "r.*")
    order = Window.partitionBy("graph_id").orderBy("attempt")
    text = with_repaired(rows, "raw", "text").withColumn("value", F.try_parse_json("text")).withColumn("broken", truncated_column(F.col("raw")))
    parsed = text.withColumn("p", parse_value(F.col("value"))).select(*key, "raw", "finish_reason", "prompt_tokens", "completion_tokens", "broken", "p.status", "p.error")
    empty = ~F.coalesce(js_trim(F.col("raw")) != "", F.lit(False))
    stops = empty | (F.col("status") == "ok") | F.coalesce(F.col("raw") == F.lag("raw").over(order), F.lit(False)) | ((F.col("finish_reason") == "stop") & F.col("broken"))
    judged = parsed.withColumns({"empty": empty, "nth": F.row_number().over(order), "stops": F.coalesce(stops, F.lit(False))})
    made = judged.where(F.col("nth") <= max_retries + 1).withColumn(
        "over", F.coalesce(F.sum(F.col("stops").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    last = made.where("over = 0").groupBy("graph_id").agg(F.max_by(F.struct("*"), "nth").alias("r"), F.count("*").alias("attempts"))
    status = F.when(F.col("r.empty"), "provider_error").otherwise(F.col("r.status"))
    ok = F.col("r.status") == "ok"
    error = F.when(F.col("r.empty"), "Empty response from LLM").when(~ok, annotated(F.col("r.error"), F.col("r.finish_reason")))
    return last.select(
        "graph_id", status.alias("status"), "attempts", error.alias("error"),
        F.when(ok, F.col("r.prompt_tokens")).alias("prompt_tokens"), F.when(ok, F.col("r.completion_tokens")).alias("completion_tokens"),
    )
