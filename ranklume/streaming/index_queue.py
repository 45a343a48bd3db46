"""Changes of catalog entities as a stream of index requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUESTS = "id long, parent_type string, parent_id long, action int, ts timestamp"
INDEX, UNINDEX = 0, 1


def requests(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of requests that are appended to a folder of Parquet files."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def last_requests(batch: DataFrame) -> DataFrame:
    """The last request of each entity: an entity asked to be indexed and then removed is removed."""
    w = Window.partitionBy("parent_type", "parent_id").orderBy(F.desc("id"))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def oldest_of_each(batch: DataFrame, most: int = 1000) -> DataFrame:
    """At most the ``most`` oldest requests of each type, as one run of the queue takes them."""
    w = Window.partitionBy("parent_type").orderBy("id")
    return batch.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def applied(documents: DataFrame, batch: DataFrame, source: DataFrame) -> DataFrame:
    """documents (id, ...) after a batch of one type: asked ones are taken from source again or, if gone there or unindexed, removed."""
    last = last_requests(batch).select(F.col("parent_id").alias("id"), "action")
    kept = documents.join(last.select("id"), "id", "left_anti")
    fresh = source.join(last.where(F.col("action") == INDEX).select("id"), "id", "left_semi")
    return kept.unionByName(fresh.select(*documents.columns))


def runs(batch: DataFrame, most: int = 1000) -> DataFrame:
    """The batch with ``run``: the ``most`` oldest requests of each type are of run 0, the next ones of run 1, and so on."""
    w = Window.partitionBy("parent_type").orderBy("id")
    return batch.withColumn("run", F.floor((F.row_number().over(w) - 1) / most).cast("int"))


def _handed(apply: Callable[[DataFrame, int], None], most: int) -> Callable[[DataFrame, int], None]:
    def hand(batch: DataFrame, n: int) -> None:
        dealt = runs(batch, most).persist()
        try:
            last = dealt.agg(F.max("run")).first()[0]
            for k in range(0 if last is None else last + 1):
                apply(last_requests(dealt.where(F.col("run") == k).drop("run")), n)
        finally:
            dealt.unpersist()

    return hand


def consume(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds", most: int = 1000) -> StreamingQuery:
    """Hands the last requests of each micro-batch to ``apply``, at most ``most`` requests of a type at a time, the oldest first.
    ``apply`` has to bear a batch's return after a failure."""
    return stream.writeStream.foreachBatch(_handed(apply, most)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def consume_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, most: int = 1000) -> None:
    """As consume, over what has arrived so far."""
    stream.writeStream.foreachBatch(_handed(apply, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
