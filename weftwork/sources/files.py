"""Texts, schemas and graphs from files; results to files."""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.model import SchemaSpec


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_input(path: str | None, stream=None) -> str:
    """A whole file, or everything on standard input."""
    if path is None:
        return (stream or sys.stdin).read()
    if not Path(path).exists():
        raise FileNotFoundError(f"Input file not found: {path}")
    return Path(path).read_text(encoding="utf-8")


def read_schema(path: str) -> SchemaSpec:
    if not Path(path).exists():
        raise FileNotFoundError(f"Schema file not found: {path}")
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as error:
        raise ValueError("Invalid JSON in schema file") from error
    return SchemaSpec.from_json(data if isinstance(data, dict) else {})


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: strictly parsed JSON of each file, null where it is not JSON."""
    return read_texts(spark, path).select("path", F.try_parse_json("text").alias("value"))


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON text a row; ``pretty`` spreads each over lines."""
    row = F.struct("*")
    df.select(F.to_json(row, {"pretty": "true"} if pretty else {}).alias("value")).write.mode("overwrite").text(path)


def dump(value, pretty: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"
