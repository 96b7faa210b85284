"""State that lives as long as a stream: rings of the last events per channel, and windows that feed longer windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from opalgrid.shared import shared_folder

RING = "channel string, total long, place int, at timestamp, id long"
#: The time of events that have none: before every other.
NEVER = -(1 << 62)


class Ring(StatefulProcessor):
    """The ``most`` newest events of a channel as a list, and how many there were as a value.

    Both are forgotten when a channel has been idle for ``idle_ms``. Newest means the latest time, then the smallest id,
    whatever the order in which events arrive; a batch is merged piece by piece, so that a busy channel takes no more
    memory than one piece. Events without a time come last.
    """

    def __init__(self, most: int, idle_ms: int) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "at long, id long", ttlDurationMs=self.idle_ms)
        self.total = handle.getValueState("total", "n long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple[str], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.last.get()) if self.last.exists() else [], columns=["at", "id"], dtype="int64")
        total = self.total.get()[0] if self.total.exists() else 0
        for part in rows:
            total += len(part)
            held = pd.concat([held, part[["at", "id"]].astype("int64")]).sort_values(["at", "id"], ascending=[False, True]).head(self.most)
        self.last.put([(int(at), int(i)) for at, i in held.itertuples(index=False, name=None)])
        self.total.update((total,))
        times = [None if t == NEVER else pd.Timestamp(t, unit="us") for t in held["at"]]
        yield pd.DataFrame({"channel": key[0], "total": total, "place": range(1, len(held) + 1), "at": pd.Series(times, dtype="datetime64[us]"), "id": held["id"].to_numpy()})

    def close(self) -> None:
        pass


def rings(stream: DataFrame, channel: str, at: str, key: str, most: int = 10, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(channel, total, place, at, id): in update mode the whole ring of every channel that a batch touches."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = stream.select(F.col(channel).cast("string").alias("channel"), F.coalesce(micros, F.lit(NEVER)).alias("at"), F.col(key).cast("long").alias("id"))
    return rows.groupBy("channel").transformWithStateInPandas(Ring(most, idle_ms), RING, "Update", "ProcessingTime")


#: What a query of rings takes along when it starts: a store that keeps lists and expires entries, and no batches without
#: data, which would follow each other for ever as time goes on.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_rings(stream: DataFrame) -> DataFrame:
    """Runs a stream of rings over what is available; the last ring of every channel.

    Each batch is written under its number, so that a batch that is run again replaces itself.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "rings")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rings/batch={batch}")

    with settings(spark):
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    every = spark.read.schema(f"{RING}, batch int").parquet(f"{folder}/rings")
    last = every.groupBy(F.col("channel").alias("_channel")).agg(F.max("batch").alias("_batch"))
    return every.join(last, F.col("channel").eqNullSafe(F.col("_channel")) & (F.col("batch") == F.col("_batch")), "left_semi").drop("batch")


SEGMENTS = ("15 minutes", "1 hour", "1 day")


def segments(stream: DataFrame, at: str, channel: str, value: str, late: str = "1 hour") -> DataFrame:
    """(segment, start, channel, n, total) of quarters, hours and days, each made of the one before, in append mode.

    Events meet the state of their quarter alone; a quarter that closes feeds its hour by its window time and an hour its
    day, so that the longer windows hold a row per shorter one and not the events again. A day appears with its hours and
    quarters (at most 24 and 96) when the watermark passes its end; later events are dropped from all three alike.
    """
    timed = stream.select(F.col(at).cast("timestamp").alias("_at"), F.col(channel).alias("channel"), F.col(value).alias("_v")).withWatermark("_at", late)
    quarter = timed.groupBy(F.window("_at", SEGMENTS[0]).alias("window"), "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"))
    inner = F.struct(F.col("window.start").alias("start"), "n", "total")
    sums = (F.sum("n").alias("n"), F.sum("total").alias("total"))
    hour = quarter.groupBy(F.window(F.window_time("window"), SEGMENTS[1]).alias("window"), "channel").agg(*sums, F.collect_list(inner).alias("quarters"))
    day = hour.groupBy(F.window(F.window_time("window"), SEGMENTS[2]).alias("window"), "channel").agg(*sums, F.collect_list(inner).alias("hours"), F.flatten(F.collect_list("quarters")).alias("quarters"))
    tagged = lambda name, rows: F.transform(rows, lambda x: F.struct(F.lit(name).alias("segment"), x["start"].alias("start"), x["n"].alias("n"), x["total"].alias("total")))
    every = F.concat(tagged(SEGMENTS[2], F.array(inner)), tagged(SEGMENTS[1], F.col("hours")), tagged(SEGMENTS[0], F.col("quarters")))
    return day.select("channel", F.inline(every)).select("segment", "start", "channel", "n", "total")
