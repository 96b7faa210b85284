"""A streaming source over a growing folder of event files, with replay ids as offsets.

An offset is the replay id of the last event delivered, so that a batch is an interval of ids: read again after a failure it
holds the same events, whatever files have come since. ``replay`` says where a new subscription begins: -2 at the first
event kept, -1 behind the last one there is, any other number behind that id. A subscription with a ``cursor`` notes the
last id of every batch that was committed, and a later subscription with the same cursor goes on from there, even with a
checkpoint of its own; with the same checkpoint Spark itself goes on.

The driver's side reads the ends of ids from the files' footers, each footer once; a partition is a row group of a file
that overlaps the interval, and tasks read that row group alone. Ids rise within a channel: an event that arrives with
an id at or below the last one delivered is not delivered, as with any log that is read from a position. Rows without an
id are not delivered. Files whose names begin with a dot or an underscore are not yet, or not, event files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from opalgrid.shared import file_system, read_note, replace_note

ALL, NEW = -2, -1
#: Before every id.
START = -(1 << 63)


def read_cursor(uri: str) -> int | None:
    """The id in a cursor file; none if there is no such file."""
    note = read_note(uri)
    return note and int(note["replay"])


def write_cursor(uri: str, replay: int) -> None:
    """Replaces the cursor file at once."""
    replace_note(uri, {"replay": replay})


class RowGroup(InputPartition):
    """A row group of a file, and the ids that are wanted of it: above ``low``, up to ``high``."""

    def __init__(self, file: str, group: int, low: int, high: int) -> None:
        self.file, self.group, self.low, self.high = file, group, low, high


class EventLogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.key = schema, options["path"], options.get("key", "event_id")
        self.replay, self.cursor = int(options.get("replay", ALL)), options.get("cursor")
        self.known: dict[str, list[tuple[int, int]]] = {}

    def _ends(self) -> Iterator[tuple[str, int, int, int]]:
        """(file, row group, least id, greatest id) of all event files."""
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            return
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        for f in sorted(files, key=lambda f: f.path):
            inner = f.path.removeprefix(path).split("/")
            if f.type != fs.FileType.File or not f.path.endswith(".parquet") or any(x[:1] in ("_", ".") for x in inner if x):
                continue
            if f.path not in self.known:
                self.known[f.path] = self._groups(system, f.path)
            for i, (low, high) in enumerate(self.known[f.path]):
                if low <= high:
                    yield f.path, i, low, high

    def _groups(self, system: Any, path: str) -> list[tuple[int, int]]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        out = []
        with system.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            column = file.schema_arrow.names.index(self.key)
            for i in range(file.metadata.num_row_groups):
                stats = file.metadata.row_group(i).column(column).statistics
                if stats is not None and stats.has_min_max:
                    out.append((stats.min, stats.max))
                else:  # no statistics, or no id at all
                    ends = pc.min_max(file.read_row_group(i, columns=[self.key]).column(0)).as_py()
                    out.append((1, 0) if ends["min"] is None else (ends["min"], ends["max"]))
        return out

    def _last(self) -> int:
        return max((high for _, _, _, high in self._ends()), default=START)

    def initialOffset(self) -> dict:
        noted = read_cursor(self.cursor) if self.cursor else None
        if noted is not None:
            return {"replay": noted}
        return {"replay": START if self.replay == ALL else self._last() if self.replay == NEW else self.replay}

    def latestOffset(self) -> dict:
        return {"replay": max(self._last(), self._floor())}

    def _floor(self) -> int:
        """An empty log ends where the subscription begins."""
        return START if self.replay in (ALL, NEW) and not self.cursor else self.initialOffset()["replay"]

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        low, high = start["replay"], end["replay"]
        return [RowGroup(f, i, low, high) for f, i, least, most in self._ends() if most > low and least <= high]

    def read(self, partition: RowGroup) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = file_system(self.path)
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as f:
            names = list(dict.fromkeys([*self.schema.names, self.key]))
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=names):
                ids = batch.column(self.key)
                kept = batch.filter(pc.and_(pc.greater(ids, partition.low), pc.less_equal(ids, partition.high)))
                if kept.num_rows:
                    yield pa.RecordBatch.from_arrays([kept.column(c.name).cast(c.type) for c in wanted], schema=wanted)

    def commit(self, end: dict) -> None:
        if self.cursor:
            noted = read_cursor(self.cursor)
            if noted is None or noted < end["replay"]:
                write_cursor(self.cursor, end["replay"])


class EventLog(DataSource):
    """Format ``event_log``; options path, key, replay, cursor."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def streamReader(self, schema: StructType) -> EventLogReader:
        return EventLogReader(schema, dict(self.options))


def subscribe_log(spark: SparkSession, path: str, schema: StructType, replay: int = ALL, cursor: str | None = None, key: str = "event_id") -> DataFrame:
    """A stream of the events under ``path`` from a replay id on, or from where the cursor stands."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").schema(schema).option("path", path).option("key", key).option("replay", replay)
    return (reader.option("cursor", cursor) if cursor else reader).load()


def _unfinished(state: str) -> bool:
    """Whether a batch was planned under a checkpoint and did not end."""
    from pyarrow import fs

    system, path = file_system(state)
    files = [system.get_file_info(fs.FileSelector(f"{path}/{part}", allow_not_found=True)) for part in ("offsets", "commits")]
    planned, ended = ({f.base_name for f in part if f.base_name.isdigit()} for part in files)
    return bool(planned - ended)


def deliver(stream: DataFrame, out: str, state: str, cursor: str | None = None) -> DataFrame:
    """Runs a stream over what is available into ``out``; runs with one ``state`` deliver every event once between them.

    The sink's own log names the files of each batch that ended, so that a batch that is run again replaces its files.
    A start that finds an unfinished batch runs that one alone, and so another start follows it. Spark tells a source of a
    batch's end when it plans the next one; the end of the last batch is noted in the ``cursor`` here.
    """
    again = True
    while again:
        again = _unfinished(state)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        ends = [json.loads(p.json)["sources"][0]["endOffset"] for p in query.recentProgress]
        if cursor and ends and ends[-1]:
            write_cursor(cursor, max(ends[-1]["replay"], read_cursor(cursor) or START))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
