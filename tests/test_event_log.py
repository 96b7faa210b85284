"""Subscriptions that go on where the last run ended."""

from __future__ import annotations

import pytest

from opalgrid.streaming import event_log as el

SCHEMA = "event_id long, kind string"


def put(spark, folder, ids, name):
    spark.createDataFrame([(i, f"k{i}" if i is not None else None) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def run(spark, tmp, name, **how):
    schema = spark.createDataFrame([], SCHEMA).schema
    return el.deliver(el.subscribe_log(spark, f"{tmp}/log", schema, **how), f"{tmp}/{name}/out", f"{tmp}/{name}/state", how.get("cursor"))


def test_runs_over_a_growing_folder_equal_one_run(spark, tmp_path):
    put(spark, tmp_path / "log", range(1, 50), "a")
    assert ids(run(spark, tmp_path, "x")) == list(range(1, 50))
    assert ids(run(spark, tmp_path, "x")) == list(range(1, 50))  # nothing new
    put(spark, tmp_path / "log", [*range(50, 80), None], "b")
    put(spark, tmp_path / "log", range(80, 90), "c")
    assert ids(run(spark, tmp_path, "x")) == ids(run(spark, tmp_path, "y")) == list(range(1, 90))


@pytest.mark.parametrize(("replay", "first", "both"), [(el.ALL, 10, 16), (el.NEW, 0, 6), (4, 6, 12), (100, 0, 0)])
def test_replay_says_where_to_begin(spark, tmp_path, replay, first, both):
    put(spark, tmp_path / "log", range(1, 11), "a")
    assert run(spark, tmp_path, "x", replay=replay).count() == first
    put(spark, tmp_path / "log", range(11, 17), "b")
    assert run(spark, tmp_path, "x", replay=replay).count() == both


def test_a_cursor_outlives_its_checkpoint(spark, tmp_path):
    cursor = f"file://{tmp_path}/cursor/at.json"
    put(spark, tmp_path / "log", range(1, 21), "a")
    first = ids(run(spark, tmp_path, "one", replay=5, cursor=cursor))
    assert first == list(range(6, 21))
    put(spark, tmp_path / "log", range(21, 31), "b")
    assert el.read_cursor(cursor) == 20
    assert ids(run(spark, tmp_path, "two", replay=5, cursor=cursor)) == list(range(21, 31)) and el.read_cursor(cursor) == 30
    assert run(spark, tmp_path, "three", replay=5, cursor=cursor).count() == 0 and el.read_cursor(cursor) == 30


def test_a_run_that_dies_between_batch_and_commit(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    seen = []

    def write(fail):
        def keep(df, batch):
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/{batch}")
            seen.append((batch, ids(df)))
            if fail:
                raise RuntimeError("killed after the write")

        return keep

    def start(fail):
        stream = el.subscribe_log(spark, f"{tmp_path}/log", schema)
        return stream.writeStream.foreachBatch(write(fail)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    put(spark, tmp_path / "log", range(1, 31), "a")
    with pytest.raises(Exception, match="killed"):
        start(True).awaitTermination()
    put(spark, tmp_path / "log", range(31, 41), "b")  # what comes meanwhile does not enter the batch that is run again
    assert el._unfinished(f"{tmp_path}/state")
    start(False).awaitTermination()
    start(False).awaitTermination()
    assert not el._unfinished(f"{tmp_path}/state")
    batches = dict(seen)
    assert seen[0] == seen[1] == (0, list(range(1, 31))) and batches[1] == list(range(31, 41))
    assert ids(spark.read.option("recursiveFileLookup", "true").schema(SCHEMA).parquet(f"{tmp_path}/out")) == list(range(1, 41))


def test_files_in_the_making_and_an_empty_log(spark, tmp_path):
    assert run(spark, tmp_path, "x").count() == 0
    put(spark, tmp_path / "log", [3, 4], "a")
    put(spark, tmp_path / "log" / "_temporary" / "0", [1, 2], "b")
    assert ids(run(spark, tmp_path, "x")) == [3, 4]
