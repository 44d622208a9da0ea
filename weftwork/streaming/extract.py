"""Extraction as a stream: the per-row pipeline unchanged, late repeats dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.model import MAX_RETRIES, SchemaSpec
from weftwork.operators.extract import extract
from weftwork.session import prepare
from weftwork.sources.providers import Provider


def deduplicated(rows: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """One row for each value of ``keys``, across all batches of a stream.

    With a ``time`` column only repeats within the delay are dropped, and state is kept
    no longer than that; without one the keys are kept for good.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else rows.dropDuplicates(keys)


def stream_extract(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    make: Callable[[], Provider],
    spec: SchemaSpec | None = None,
    max_retries: int = MAX_RETRIES,
    once: bool = True,
    time: str | None = None,
    delay: str = "1 day",
):
    """Write the extraction of a streaming ``doc_id, text`` to Parquet; returns the running query.

    With a ``time`` column a document that was sent again within the delay is not asked
    for again. Replies of a batch are written before they are parsed, as in the batch
    form, and a batch that is repeated after a failure replaces its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        prepare(rows.sparkSession)
        found = extract(rows, make, spec, max_retries)
        flat_result(found).write.mode("overwrite").parquet(f"{path}/batch={number}")

    if time:
        documents = deduplicated(documents, ["doc_id"], time, delay)
    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_table(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream to Parquet; returns the running query."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def flat_result(found: DataFrame) -> DataFrame:
    """``doc_id, status, n_nodes, n_edges, n_errors, n_warnings, valid`` of an extraction."""
    v = F.col("validation")
    sizes = {"n_nodes": v["graph"]["nodes"], "n_edges": v["graph"]["edges"], "n_errors": v["errors"], "n_warnings": v["warnings"]}
    return found.select(
        "doc_id", "status", *(F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(n) for n, c in sizes.items()), F.coalesce(v["valid"], F.lit(False)).alias("valid")
    )


def stream_folder(spark, folder: str, table: str, columns: list[str]) -> DataFrame:
    """A Parquet table as a stream, each file once."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    source = spark.readStream.schema(schema)
    path = f"{folder}/{table}.parquet"
    return source.parquet(path if _is_folder(spark, path) else folder, pathGlobFilter=None if _is_folder(spark, path) else f"{table}.parquet").select(*columns)


def _is_folder(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


