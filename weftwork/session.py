"""Session settings the operators rely on, and where long lineages are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; everything else is the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Folders of written tables that this process made.
_MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators need on a session that may be someone else's."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset and the master is local, a temporary
    folder is made; on a cluster that would be readable from one machine only,
    so it is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    place = tempfile.mkdtemp(prefix="weftwork-")
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{place}")
    return f"file://{place}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name for a written table below the shared folder."""
    _MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def discard(spark: SparkSession) -> int:
    """Remove the written tables that this process made; how many there were.

    For when the results built on them have been stored: operators are lazy beyond
    these tables, and a result that still reads one fails without it.
    """
    removed = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the shared folder, so that a lost executor costs no long recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where a scan gives fewer.

    A small table of one row group would keep one core busy with work that costs far
    more than moving it. Larger tables come in more pieces than cores and stay as they
    are; so does anything but a plain scan, whose plan is not known before it runs.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join whose sides both grow with the input, so that neither is broadcast.

    Spark estimates the size of a side from compressed files and takes an explode for one
    row each. What it holds for small can be a hundred times as large once it is in the
    memory of the driver, which builds every broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back, for results that several branches read."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
