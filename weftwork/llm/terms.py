"""Frequency of every distinct value or term, kept up to date by signed deltas.

A record is a graph. Each change of the tables is a DataFrame of rows with a sign
(+1 added, -1 removed; a changed row is a removal and an addition). ``delta`` turns
them into signed occurrences per field, term and graph; ``TermCounts`` merges a delta
into counts that persist in hash buckets, rewriting only buckets that the delta
touches; ``counts`` and ``marks`` read the state. The work of an increment follows
the changed rows and touched buckets, not the collection.

The pseudo-terms of ``GRAPHS`` count rows per graph, so that the state also knows
how many graphs each table has.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.text import has_text
from weftwork.session import fresh_folder, written

#: Field of a pseudo-term for each table.
GRAPHS = {"nodes": "#nodes", "edges": "#edges"}
#: Table of each field.
TABLES = {"node_type": "nodes", "node_label": "nodes", "edge_type": "edges"}
STATE = "field_name string, term string, graph_id bigint, n bigint, bucket int"


def _terms(values: Column, field_name: str) -> Column:
    return F.transform(F.filter(values, has_text), lambda t: F.struct(F.lit(field_name).alias("field_name"), t.alias("term")))


def node_terms(nodes: DataFrame, sign: int = 1) -> DataFrame:
    """Terms of node rows: ``field_name, term, graph_id, n`` with n the sign.

    The type is one term as stored; the label gives the parts of its lower-cased
    form between single spaces. Null, empty and blank terms are left out; rows
    without a graph count as occurrences of no record.
    """
    terms = F.concat(
        _terms(F.array("type"), "node_type"),
        F.coalesce(_terms(F.split(F.lower("label"), " "), "node_label"), _terms(F.array().cast("array<string>"), "node_label")),
        F.array(F.struct(F.lit(GRAPHS["nodes"]).alias("field_name"), F.lit("").alias("term"))),
    )
    return nodes.select("graph_id", F.explode(terms).alias("t")).select("t.field_name", "t.term", "graph_id", F.lit(sign).cast("bigint").alias("n"))


def edge_terms(edges: DataFrame, sign: int = 1) -> DataFrame:
    """Terms of edge rows, as ``node_terms``."""
    terms = F.concat(_terms(F.array("type"), "edge_type"), F.array(F.struct(F.lit(GRAPHS["edges"]).alias("field_name"), F.lit("").alias("term"))))
    return edges.select("graph_id", F.explode(terms).alias("t")).select("t.field_name", "t.term", "graph_id", F.lit(sign).cast("bigint").alias("n"))


def delta(*parts: DataFrame) -> DataFrame:
    """Signed occurrences per field, term and graph; what cancels out is left out."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("field_name", "term", "graph_id").agg(F.sum("n").alias("n")).where("n <> 0")


def counts(state: DataFrame) -> DataFrame:
    """``field_name, term, occurrences, records``: records are the graphs that hold the term."""
    return state.groupBy("field_name", "term").agg(F.sum("n").alias("occurrences"), F.count(F.when(F.col("n") > 0, F.col("graph_id"))).alias("records"))


def marks(term_counts: DataFrame, rare: int = 1, common: float = 0.1) -> DataFrame:
    """``field_name, term, mark`` of terms in exactly ``rare`` records or in more than the share ``common`` of them.

    The number of records of each table is one row a table, found by an aggregate
    whose result has two rows.
    """
    tables = F.create_map(*(F.lit(x) for pair in TABLES.items() for x in pair))
    totals = term_counts.where(F.col("field_name").isin(list(GRAPHS.values()))).select(F.expr("substring(field_name, 2)").alias("table_name"), F.col("records").alias("total"))
    named = term_counts.where(F.col("field_name").isin(list(TABLES))).withColumn("table_name", tables[F.col("field_name")])
    mark = F.when(F.col("records") == rare, "rare").when(F.col("records") > F.col("total") * common, "common")
    return named.join(F.broadcast(totals), "table_name").withColumn("mark", mark).where("mark is not null").select("field_name", "term", "mark")


#: Rows of the state that a bucket is made for.
BUCKET_ROWS = 500_000


@dataclass
class TermCounts:
    """Persistent counts in hash buckets of (field, term, graph) below ``path``.

    Buckets are by the whole key, so that a term of a third of all rows is spread like
    any other. Every merge writes the touched buckets under a new version and then a
    manifest, which names for each bucket the version that holds it. ``open`` reads the
    newest manifest, in this process or another; a merge that fails midway leaves no
    manifest and changes nothing. Older versions stay readable until ``vacuum``.
    """

    spark: SparkSession
    path: str
    buckets: int | None = None
    version: int = 0
    holds: dict[int, int] = field(default_factory=dict)

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> TermCounts:
        """Empty counts in a new folder; the first delta settles the number of buckets where none is given."""
        return cls(spark, fresh_folder(spark, "terms"), buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TermCounts:
        """The counts that an earlier merge left below ``path``."""
        path = path.rstrip("/")
        done = [int(s.getPath().getName().partition("=")[2]) for s in cls(spark, path)._list(f"{path}/manifest") if cls(spark, path)._list(s.getPath().toString() + "/_SUCCESS")]
        if not done:
            raise FileNotFoundError(f"no counts below {path}")
        row = json.loads(spark.read.text(f"{path}/manifest/version={max(done)}", wholetext=True).first().value)
        return cls(spark, path, row["buckets"], row["version"], {int(b): v for b, v in row["holds"].items()})

    def _files(self, buckets) -> list[str]:
        return [f"{self.path}/version={self.holds[b]}/bucket={b}" for b in sorted(buckets) if b in self.holds]

    def state(self, buckets=None) -> DataFrame:
        files = self._files(self.holds if buckets is None else buckets)
        if not files:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).option("basePath", self.path).parquet(*files).select("field_name", "term", "graph_id", "n", "bucket")

    def merge(self, change: DataFrame) -> TermCounts:
        """Add a delta to the buckets it touches."""
        if self.buckets is None:
            change = written(change, "delta")
            self.buckets = max(16, math.ceil(change.count() / BUCKET_ROWS))
        change = change.withColumn("bucket", F.pmod(F.xxhash64("field_name", "term", "graph_id"), F.lit(self.buckets)).cast("int"))
        if self.holds:
            change = written(change, "delta")
            touched = [row.bucket for row in change.select("bucket").distinct().collect()]  # at most self.buckets rows
            change = (
                self.state(touched)
                .unionByName(change)
                .groupBy("field_name", "term", "graph_id", "bucket")
                .agg(F.sum("n").alias("n"))
                .where("n <> 0")
            )
        else:
            touched = range(self.buckets)
        version = self.version + 1
        target = f"{self.path}/version={version}"
        change.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        new = {int(name.partition("=")[2]) for s in self._list(target) if (name := s.getPath().getName()).startswith("bucket=")}
        holds = {b: v for b, v in self.holds.items() if b not in set(touched)} | dict.fromkeys(new, version)
        row = json.dumps({"version": version, "buckets": self.buckets, "holds": holds})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={version}")
        self.version, self.holds = version, holds
        return self

    def vacuum(self) -> None:
        """Remove versions and manifests that the newest manifest does not need."""
        used = {*self.holds.values(), self.version}
        for status in [*self._list(self.path), *self._list(f"{self.path}/manifest")]:
            name = status.getPath().getName()
            manifest = status.getPath().getParent().getName() == "manifest"
            if name.startswith("version=") and int(name.partition("=")[2]) not in ({self.version} if manifest else used):
                self._system(status.getPath()).delete(status.getPath(), True)

    def _system(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, target: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        return list(self._system(path).listStatus(path)) if self._system(path).exists(path) else []
