"""The folder that all executors see, and tables dealt to all of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode only: on a cluster no machine's folder will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors see")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: cuts the lineage, survives lost executors, and gives later joins true sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan in fewer parts than the cluster has cores (a small file, few row groups), dealt to all cores; larger tables stay as they are read. For rows that cost much more to compute than to send."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Tasks to which dealt deals a larger table, for each core or part of its scan.
DEALT = 4


def dealt(df: DataFrame) -> DataFrame:
    """A scan of few columns dealt evenly, whatever its size, for rows that cost much more to compute than to send: a file's rows lie in its row groups, so a scan of many parts may have all rows in few of them."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if parts < cores else DEALT * parts)
