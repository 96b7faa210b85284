"""Cached catalogs: readers, expiry, deltas, refreshes that die; and rules on odd values."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opalgrid.operators import rules as ru
from opalgrid.operators.snapshots import SnapshotCache

T0 = datetime(2024, 5, 1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_expiry_and_deltas(spark, tmp_path):
    cache = SnapshotCache(spark, f"file://{tmp_path}/cache", hours=10)
    assert cache.read(T0) is None
    cache.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string"), T0)
    old = cache.read(T0 + timedelta(hours=1))
    cache.refresh(spark.createDataFrame([(2, "B", False), (4, "d", None), (3, "x", True)], "k long, v string, gone boolean"), "k", T0 + timedelta(hours=6), gone="gone")
    assert rows(old) == [(1, "a"), (2, "b"), (3, "c")]  # a reader keeps its snapshot
    assert rows(cache.read(T0 + timedelta(hours=7))) == [(1, "a"), (2, "B"), (4, "d")]
    assert rows(cache.read(T0 + timedelta(hours=10))) == [(2, "B"), (4, "d")]  # an entry lives ten hours
    cache.refresh(spark.createDataFrame([(5, "e")], "k long, v string"), "k", T0 + timedelta(hours=12))
    assert rows(SnapshotCache(spark, cache.folder, hours=None).read(T0 + timedelta(days=99))) == [(2, "B"), (4, "d"), (5, "e")]  # dead entries stay behind
    assert cache.prune() == 2 and cache.read(T0 + timedelta(hours=13)).count() == 3


def test_a_refresh_that_dies_or_comes_second(spark, tmp_path, monkeypatch):
    cache = SnapshotCache(spark, f"file://{tmp_path}/cache")
    cache.write(spark.createDataFrame([(1, "a")], "k long, v string"), T0)
    with pytest.raises(Exception, match="(?i)divi"):
        cache.refresh(spark.range(3).select(F.col("id").alias("k"), F.expr("cast(1 / (id - 1) as string)").alias("v")), "k", T0)
    assert rows(cache.read(T0)) == [(1, "a")]
    seen = iter([cache.current(), "another"])
    monkeypatch.setattr(cache, "current", lambda: next(seen))
    with pytest.raises(RuntimeError, match="another refresh"):
        cache.refresh(spark.createDataFrame([(2, "b")], "k long, v string"), "k", T0)


@pytest.mark.parametrize(("value", "wanted", "broken"), [(58, ">=58", False), (57, ">= 58", True), (58, "<58", True), (None, ">=1", False), (None, "=1", True), (1, "==1", False), (5, "~6", True), (5, None, False), (5, "", False)])
def test_thresholds(spark, value, wanted, broken):
    row = spark.createDataFrame([(value, wanted)], "v int, w string").select(ru.breaks_threshold(F.col("v"), F.col("w")).alias("x")).first()
    assert row["x"] is broken
