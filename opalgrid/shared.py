"""The folder that the driver and all executors see, and small files in it that are replaced at once."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints; only a local session may do without naming one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{(named or tempfile.mkdtemp(prefix='opalgrid-')).rstrip('/')}/opalgrid/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[Any, str]:
    """(pyarrow's file system, path) of a path as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def read_note(uri: str) -> dict[str, Any] | None:
    """What a note holds; none if there is no such file."""
    from pyarrow import fs

    system, path = file_system(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def replace_note(uri: str, note: dict[str, Any]) -> None:
    """Writes a note beside its place and moves it there, so that a reader finds the old one or the new one whole."""
    system, path = file_system(uri)
    folder = path.rsplit("/", 1)[0]
    system.create_dir(folder)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(json.dumps(note).encode())
    system.move(draft, path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes everything that this library has put into the shared folder, for when no result is read any more."""
    from pyarrow import fs

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        system, path = file_system(f"{named.rstrip('/')}/opalgrid")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)
