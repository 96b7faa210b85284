"""Rings and chained windows over several micro-batches, late events included."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opalgrid.streaming import events as st
from opalgrid.streaming import stateful as sf

SCHEMA = "event_id long, ts timestamp, kind string, value double"
DAY = datetime(2024, 3, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_rings_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, DAY + timedelta(minutes=rng.randrange(300)), rng.choice("aab"), 1.0) for i in range(200)] + [(900, DAY, None, 1.0), (901, DAY, "once", 1.0), (902, None, "none", 1.0)]
    rng.shuffle(rows)
    for part in (rows[:70], rows[70:140], rows[140:]):
        put(spark, tmp_path / "in", part)
    got = sf.latest_rings(sf.rings(stream(spark, tmp_path / "in"), "kind", "ts", "event_id")).collect()
    for kind in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == kind]
        newest = sorted(own, key=lambda r: (-(r[1] or datetime(1970, 1, 1)).timestamp(), r[0]))[:10]
        assert [r["id"] for r in sorted((r for r in got if r["channel"] == kind), key=lambda r: r["place"])] == [r[0] for r in newest]
        assert {r["total"] for r in got if r["channel"] == kind} == {len(own)}


def test_three_segments_from_one_state(spark, tmp_path):
    at = lambda h, m=0: DAY + timedelta(hours=h, minutes=m)
    rows = [(i, at(i // 4, 15 * (i % 4) + i % 15), "ab"[i % 2], float(i)) for i in range(96)]
    put(spark, tmp_path / "in", rows)
    put(spark, tmp_path / "in", [(200, at(30), "a", 1.0)])  # closes the first day
    put(spark, tmp_path / "in", [(201, at(3), "a", 1000.0), (202, at(29, 30), "a", 2.0)])  # one is a day late, one is in time
    put(spark, tmp_path / "in", [(203, at(60), "b", 5.0)])
    got = {(r["segment"], r["start"], r["channel"]): (r["n"], r["total"]) for r in st.drained(sf.segments(stream(spark, tmp_path / "in"), "ts", "kind", "value")).collect()}
    want: dict = {}
    for _, ts, kind, value in [*rows, (200, at(30), "a", 1.0), (202, at(29, 30), "a", 2.0)]:
        for name, minutes in (("15 minutes", 15), ("1 hour", 60), ("1 day", 1440)):
            start = DAY + timedelta(minutes=(ts - DAY) // timedelta(minutes=minutes) * minutes)
            n, total = want.get((name, start, kind), (0, 0.0))
            want[name, start, kind] = (n + 1, total + value)
    assert got == want


def test_the_plan_has_one_state_of_events(spark, tmp_path):
    put(spark, tmp_path / "in", [(1, DAY, "a", 1.0)])
    assert len(sf.segments(stream(spark, tmp_path / "in"), "ts", "kind", "value").columns) == 5
    static = sf.segments(spark.createDataFrame([(1, DAY, "a", 1.0)], SCHEMA), "ts", "kind", "value")
    assert static.agg(F.count(F.lit(1))).first()[0] == 3
