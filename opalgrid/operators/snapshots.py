"""A catalog that is cached as immutable snapshots: written whole, aged entry by entry, refreshed by deltas.

A snapshot is a folder of files that never change. A small pointer file names the present one and is replaced at once, so that
a reader sees one snapshot from beginning to end however often the cache is refreshed meanwhile, and a refresh that dies
leaves the snapshot before it in place. Every entry carries the time it was written at; one that is older than the time to
live is not read, and the next refresh leaves it behind.
"""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.shared import file_system, read_note, replace_note

WRITTEN = "_written"


class SnapshotCache:
    """Snapshots of one catalog under a folder; ``hours`` is the time that entries live, none for ever."""

    def __init__(self, spark: SparkSession, folder: str, hours: float | None = 168) -> None:
        self.spark, self.folder, self.hours = spark, folder.rstrip("/"), hours

    def current(self) -> str | None:
        """The name of the present snapshot."""
        note = read_note(f"{self.folder}/CURRENT.json")
        return note and note["snapshot"]

    def _alive(self, now: datetime) -> Column:
        return F.lit(True) if self.hours is None else F.col(WRITTEN) + F.make_dt_interval(hours=F.lit(0), secs=F.lit(self.hours * 3600)) > F.lit(now)

    def read(self, now: datetime) -> DataFrame | None:
        """The entries of the present snapshot that are alive; none if nothing was written yet."""
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}").filter(self._alive(now)).drop(WRITTEN)

    def _publish(self, rows: DataFrame, base: str | None) -> str:
        name = f"snapshot-{uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        if self.current() != base:
            raise RuntimeError("another refresh has replaced the snapshot that this one was made from")
        replace_note(f"{self.folder}/CURRENT.json", {"snapshot": name})
        return name

    def write(self, rows: DataFrame, now: datetime) -> str:
        """A new snapshot of all rows."""
        return self._publish(rows.withColumn(WRITTEN, F.lit(now)), self.current())

    def refresh(self, delta: DataFrame, key: str, now: datetime, gone: str | None = None) -> str:
        """A new snapshot: the delta's rows in place of those with their keys, the other entries that are alive as they were.

        ``gone`` names a boolean column of the delta; its rows take their keys' entries away. One shuffle by key.
        """
        base = self.current()
        removed = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
        new = delta.filter(~removed).drop(*([gone] if gone else [])).withColumn(WRITTEN, F.lit(now))
        if base is None:
            return self._publish(new, None)
        old = self.spark.read.parquet(f"{self.folder}/{base}").filter(self._alive(now))
        return self._publish(old.join(delta.select(key), key, "left_anti").select(new.columns).unionByName(new), base)

    def prune(self) -> int:
        """Deletes all snapshots but the present one, for when no reader is left on them; how many there were."""
        from pyarrow import fs

        system, path = file_system(self.folder)
        old = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("snapshot-") and f.base_name != self.current()]
        for f in old:
            system.delete_dir(f.path)
        return len(old)
