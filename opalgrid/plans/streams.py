"""Queries over event streams, each run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalgrid.functions import text as tx
from opalgrid.plans.dialect import table
from opalgrid.plans.registry import register
from opalgrid.shared import shared_folder
from opalgrid.streaming import event_log as el
from opalgrid.streaming import events as st
from opalgrid.streaming import stateful as sf

def n_rows():
    return F.count(F.lit(1))


def stream(spark, d, **how):
    """The events table as a stream: its folder is watched for event files alone."""
    schema = table(spark, d, "events").schema
    return st.subscribe(spark, f"{d}/events.parquet*", schema, **how)


SUBSCRIBE = "SELECT event_id, '/event/' || event_type AS channel FROM events"


@register("stream_subscribe", SUBSCRIBE)
@register("src_stream", SUBSCRIBE)
def stream_subscribe(spark, d):
    return st.drained(stream(spark, d).select("event_id", F.concat(F.lit("/event/"), "event_type").alias("channel")))


@register("stream_replay", "SELECT event_id FROM events WHERE event_id > 500")
def stream_replay(spark, d):
    return st.drained(stream(spark, d, replay=500).select("event_id"))


CURSOR_SQL = "SELECT event_id, event_type, CASE WHEN event_id <= half THEN 1 ELSE 2 END AS run FROM events, (SELECT CAST(count(*) // 2 AS BIGINT) AS half FROM events) WHERE event_id > 100"


@register("stream_replay_cursor", CURSOR_SQL)
def stream_replay_cursor(spark, d):
    """Two subscriptions over a growing log: the second goes on where the cursor of the first stands."""
    folder, events = shared_folder(spark, "log"), table(spark, d, "events").select("event_id", "event_type")
    half, cursor, runs = events.count() // 2, f"{folder}/cursor.json", []
    for i, part in enumerate((F.col("event_id") <= half, F.col("event_id") > half), 1):
        events.filter(part).write.mode("append").parquet(f"{folder}/log")
        stream = el.subscribe_log(spark, f"{folder}/log", events.schema, replay=100, cursor=cursor)
        runs.append(el.deliver(stream, f"{folder}/out{i}", f"{folder}/state{i}", cursor).withColumn("run", F.lit(i)))
    return runs[0].unionByName(runs[1])


@register("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark, d):
    twice = stream(spark, d).withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    return st.drained(st.without_repeats(twice).select("event_id", "event_type"))


@register("stream_newest_first", "SELECT event_id FROM events ORDER BY ts DESC, event_id")
def stream_newest_first(spark, d):
    return st.drained(stream(spark, d).select("event_id", "ts")).orderBy(F.desc("ts"), "event_id").select("event_id")


@register("stream_filter", "SELECT event_id FROM events WHERE contains(lower(event_type || props), 'err') OR contains(props, '\"k\":7}') OR contains(props, '\"k\": 7}')")
def stream_filter(spark, d):
    rows = stream(spark, d).select("event_id", "event_type", "props")
    few = rows.select("event_id", "event_type", F.regexp_replace("props", " ", "").alias("props"))
    return st.drained(few.filter(F.contains(F.lower(F.to_json(F.struct("event_type", "props"))), F.lit("err")) | F.contains("props", F.lit('"k":7}'))).select("event_id"))


@register("stream_channel_list", "SELECT 'All Change Events' AS label, 0 AS place UNION ALL SELECT DISTINCT event_type, 1 FROM events")
def stream_channel_list(spark, d):
    head = spark.range(1).select(F.lit("All Change Events").alias("label"), F.lit(0).alias("place"))
    return head.unionByName(table(spark, d, "events").select(F.col("event_type").alias("label"), F.lit(1).alias("place")).distinct())


GENERATED = """
WITH d AS (SELECT c_custkey AS replay_id, md5('3:' || c_custkey || ':c_name') AS a, md5('3:' || c_custkey || ':c_acctbal') AS b, md5('3:' || c_custkey || ':c_mktsegment') AS c FROM customer)
SELECT replay_id, substr(a, 1, CAST(CAST('0x' || substr(a, 1, 8) AS BIGINT) % 15 + 5 AS BIGINT)) AS c_name, round(CAST('0x' || substr(b, 1, 8) AS BIGINT) % 100000 / 100.0::DOUBLE, 2) AS c_acctbal,
       substr(c, 1, CAST(CAST('0x' || substr(c, 1, 8) AS BIGINT) % 15 + 5 AS BIGINT)) AS c_mktsegment FROM d
"""


@register("stream_generate", GENERATED)
@register("sink_publish", GENERATED)
def stream_generate(spark, d):
    """Payloads for the settable fields of an object, published to a log and read back by a subscription.

    Values come from a hash of seed, event and field: a task that runs again makes the same ones.
    """
    settable = [f for f in table(spark, d, "customer").schema.fields if f.name not in ("c_custkey", "c_nationkey")]
    value = lambda f: tx.random_value(F.concat(F.col("c_custkey").cast("string"), F.lit(f":{f.name}")), f.dataType.simpleString(), 3)
    folder = shared_folder(spark, "publish")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("replay_id"), *[value(f).cast(f.dataType).alias(f.name) for f in settable])
    rows.write.parquet(f"{folder}/log")
    return el.deliver(el.subscribe_log(spark, f"{folder}/log", rows.schema, key="replay_id"), f"{folder}/out", f"{folder}/state")


@register("stream_running_stats", "SELECT event_type, count(*) AS total, round(sum(value), 4) AS spent FROM events GROUP BY event_type")
def stream_running_stats(spark, d):
    rows = stream(spark, d).groupBy("event_type").agg(n_rows().alias("total"), F.sum("value").alias("spent"))
    return st.drained(rows, "complete").select("event_type", "total", F.round("spent", 4).alias("spent"))


@register("stream_error_ring", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def stream_error_ring(spark, d):
    folder = shared_folder(spark, "ring")
    errors = stream(spark, d).filter("event_type = 'error'").select("event_id", "ts")
    query = errors.writeStream.foreachBatch(st.ring(folder, 10, "ts", "event_id")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(p["batchId"] for p in query.recentProgress)
    return spark.read.schema(errors.schema).parquet(f"{folder}/{last}").select("event_id")


@register("stream_window_limits", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_limits(spark, d):
    timed = stream(spark, d).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    rows = st.drained(timed.groupBy(F.window("t", "1 day"), "event_type").agg(n_rows().alias("n")), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def in_batches(spark, d, batches=4):
    """The events, in the order of time, as a stream of several micro-batches."""
    events, folder = table(spark, d, "events"), shared_folder(spark, "batches")
    ends = events.agg(F.min("ts").cast("timestamp").cast("long").alias("a"), (F.max("ts").cast("timestamp").cast("long") + 1).alias("b")).first()
    at = F.floor((F.col("ts").cast("timestamp").cast("long") - ends["a"]) * batches / (ends["b"] - ends["a"]))
    for i in range(batches):
        events.filter(at == i).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@register("stream_error_rings", "SELECT event_type, count(*) OVER (PARTITION BY event_type) AS total, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS INTEGER) AS place, event_id FROM events QUALIFY place <= 10")
def stream_error_rings(spark, d):
    """The last ten events of every type, kept as state over several micro-batches."""
    kept = sf.latest_rings(sf.rings(in_batches(spark, d), "event_type", "ts", "event_id"))
    return kept.select(F.col("channel").alias("event_type"), "total", "place", F.col("id").alias("event_id"))


SEGMENTS_SQL = """
SELECT s AS segment, strftime(time_bucket(CAST(s AS INTERVAL), ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events, (SELECT unnest(['15 minutes', '1 hour', '1 day']) AS s), (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2, 3
"""


@register("stream_segments", SEGMENTS_SQL)
def stream_segments(spark, d):
    """Quarters, hours and days of all closed days, from one state of events."""
    rows = st.drained(sf.segments(in_batches(spark, d), "ts", "event_type", "value"))
    return rows.select("segment", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.col("channel").alias("event_type"), "n", F.round("total", 4).alias("total"))


@register("stream_poll", "SELECT count(*) AS n, true AS done FROM events")
def stream_poll(spark, d):
    rows, done = st.polled(stream(spark, d).select("event_id"))
    return spark.createDataFrame([(rows, done)], "n long, done boolean")
