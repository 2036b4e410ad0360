"""Where intermediate files go: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN = "spark.assayloom.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only on a local master that has none."""
    # a session cannot be given spark.checkpoint.dir later on
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = "file://" + tempfile.mkdtemp(prefix="assayloom-")
    spark.conf.set(_OWN, path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of this application that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str = "graph") -> DataFrame:
    """df written as Parquet and read back, which cuts the lineage with files that survive a lost executor.

    Spark removes the shuffle files of the write as soon as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path, was = new_path(spark, kind), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._assayloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Removes stored() tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._assayloom_path)


def drop_tables(spark: SparkSession) -> None:
    """Removes all that this application has stored under paths of new_path(). For callers that have written their results."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for kind in files.listStatus(root) if files.exists(root) else []:
        if kind.isDirectory():
            remove(spark, f"{kind.getPath()}/{spark.sparkContext.applicationId}")
