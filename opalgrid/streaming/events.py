"""Event streams: subscription with replay, deduplication, filters, windows, rings of errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.shared import shared_folder

ALL, NEW = -2, -1


def subscribe(spark: SparkSession, path: str, schema, replay: int = ALL, after: int | None = None, files: int = 1000) -> DataFrame:
    """A stream of the event files under ``path``; ``replay`` as -2 (all), -1 (later than ``after``) or an id to go on from."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    least = after if replay == NEW else replay
    return stream if replay == ALL or least is None else stream.filter(F.col("event_id") > least)


def without_repeats(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event once; the state of ids is bounded by the watermark."""
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.dropDuplicatesWithinWatermark(["event_id"])


def holding(stream: DataFrame, term: str) -> DataFrame:
    """Events whose JSON holds the term in any case."""
    return stream.filter(F.contains(F.lower(F.to_json(F.struct(*stream.columns))), F.lit(term.lower())))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available and returns its sink as a table."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def polled(stream: DataFrame, every: float = 2.0) -> tuple[int, bool]:
    """Starts a stream over what is available and asks for its state every few seconds until it is done.

    The rows that it read, and whether it ended by itself; a stream that is still active when the caller is interrupted
    is stopped.
    """
    folder = shared_folder(stream.sparkSession, "poll")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(every):
            pass
        return sum(p["numInputRows"] for p in query.recentProgress), query.exception() is None
    finally:
        query.stop()


def ring(path: str, most: int, order: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the ``most`` newest rows: ring ``n`` holds those after batch n."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        old = spark.read.schema(df.schema).parquet(f"{path}/{batch - 1}") if batch else df.limit(0)
        df.unionByName(old).orderBy(F.desc(order), key).limit(most).write.mode("overwrite").parquet(f"{path}/{batch}")

    return write
