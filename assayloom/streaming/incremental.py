"""Streams that stand for a resumable crawl: new record files are appended once, each id once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import exists


def new_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON-lines files; lines that cannot be read are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def append(stream: DataFrame, out: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends records whose key out does not have yet as Parquet and stops; the checkpoint makes reruns go on from there.

    The written table itself says which keys are known, so no state is kept that
    grows with them, and a batch that is run again adds nothing twice.
    """

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if exists(spark, out):
            fresh = fresh.join(spark.read.parquet(out).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(out)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once).start()


def each_batch(stream: DataFrame, checkpoint: str, call: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls a function with every micro-batch and its number, like a per-epoch callback."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(call).start()


def missing(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is still to fetch."""
    return wanted.join(done.select(key), key, "left_anti")
