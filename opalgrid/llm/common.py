"""Helpers that the corpus operators share: text rules, shared storage, skew-safe lookups.

Text rules used everywhere in this subpackage
---------------------------------------------
* a null text counts as the empty text;
* lower-casing touches A-Z only (other letters keep their case);
* a word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key that holds more than 1/HOT_SHARE of the rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 256


def text_of(col: Column | str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. A text of ASCII bytes alone takes the cheaper ``lower``."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def doc_crc(col: Column | str) -> Column:
    """crc32 of an id written as text: the folds of the learned operators are its remainders."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` where the cluster names one. Where that is unset (tests on one machine) a
    temporary folder is made once per session and remembered in the session's own settings.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("opalgrid.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
        spark.conf.set("opalgrid.shared.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/opalgrid/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a narrow table to the shared folder and reads it back: the lineage is cut, and a lost executor costs
    a reread of files instead of the work that made them."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that workers open by themselves (memory maps).

    It lies in the shared folder, which must then be a mounted one; a store that only Spark can open is refused.
    """
    base = shared_dir(spark)
    if "://" in base and not base.startswith("file://") or base.startswith("hdfs:"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, spark.checkpoint.dir is {base}")
    path = f"{base.removeprefix('file://').removeprefix('file:')}/opalgrid/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind; what outlasts a job is written by ``materialize``."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows with a table that has one row per key, safe for keys that hold much of ``left``.

    ``count`` is a column of ``right``: the rows of ``left`` with that key; ``total``: all rows of ``left``. Keys
    above 1/HOT_SHARE of the rows number at most HOT_SHARE, so that these few rows of ``right`` are broadcast
    whatever the size of the data; every other key is small enough to be shuffled. ``key`` is never null.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(max(total, HOT_SHARE))
    few = F.broadcast(right.filter(hot))
    cold = left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(right.filter(~hot), key)
    return left.join(few, key).select(cold.columns).unionByName(cold)
