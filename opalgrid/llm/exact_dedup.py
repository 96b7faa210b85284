"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch of documents is reduced to one row per distinct
digest before it meets the index, so neither side of the sort-merge anti-join has a hot key; the index side is read
bucket by bucket without a shuffle. Digests that the index lacks are appended to it. Each append adds a file per
bucket, which is sorted by itself only; ``compact`` writes the index anew with one sorted file per bucket.

A batch may have a name. Adding a named batch again, say after a crash between its append and the use of its report,
gives the report of the first time: what the index holds under that name still counts as new.

DataFrame operations only. Defined results: a null text equals the empty one; texts of any length are read whole; of
equal texts the largest id stays; a null id stays only where its whole group has null ids; rows that repeat an id that
stays are all marked as kept; an empty batch adds nothing. Only the id and text columns are read, so other columns may
have any name.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.llm.common import ascii_lower, free_name, fresh_path, lookup, materialize, text_of

BUCKET_DIGESTS = 10_000_000
LEAST_BUCKETS = 32


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text_of(text)).cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, batch) of every text seen, bucketed and sorted by digest.

    ``path`` is kept between sessions: naming the same path again picks the index up where it was left. ``expected``
    is the number of digests that it is made for; it decides the number of buckets, of about BUCKET_DIGESTS each, when
    the index is made. That number is written beside the index and read from there when it is opened again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digests")
        note = f"{self.path}.buckets"
        wanted = buckets or max(LEAST_BUCKETS, ceil(expected / BUCKET_DIGESTS))
        spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("ignore").parquet(note)
        self.buckets = spark.read.parquet(note).first()["buckets"]
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Takes the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compact(self, path: str | None = None, expected: int = 0) -> DigestIndex:
        """A new index of the same rows with one sorted file per bucket; this one is left as it is."""
        fresh = DigestIndex(self.spark, path, max(expected, self.read().count()))
        self.read().repartition(fresh.buckets, "digest").write.insertInto(fresh.table)
        return fresh

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicates a batch, appends its new digests, and returns a row per document.

        Columns: the id, ``keep_id`` (of this batch the largest id with that text, or the id under which an earlier
        batch stored it), ``group_size`` (in this batch), ``kept``, ``text_sha256``.
        """
        batch = batch or uuid.uuid4().hex
        digests = materialize(docs.select(F.col(id_col).cast("long").alias("_id"), text_digest(F.col(text_col)).alias("digest")), "batch")
        groups = materialize(digests.groupBy("digest").agg(F.max("_id").alias("own_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        fresh = groups.hint("merge").join(self.read(), "digest", "left_anti")
        fresh.select("digest", F.col("own_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(self.table)
        found = groups.join(self.read().hint("merge"), "digest")
        found = found.select("digest", "group_size", "keep_id", (F.col("batch") == batch).alias("_new"))
        out = lookup(digests, found, "digest", "group_size", digests.count())
        same = F.coalesce(F.col("_id") == F.col("keep_id"), F.col("_id").isNull() & F.col("keep_id").isNull())
        return out.select(
            F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_new") & same).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document with its verdict, over a new index unless one is given."""
    if index is not None:
        return index.add(docs, id_col, text_col, batch)
    own = DigestIndex(docs.sparkSession)
    report = own.add(docs, id_col, text_col, batch)
    own.forget()
    return report


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns. A document with a null id stays."""
    gone_id, gone_digest = free_name(docs, "id"), free_name(docs, "digest")
    gone = dedup_report(docs, id_col, text_col, index, batch).filter("NOT kept").select(F.col(id_col).alias(gone_id), F.unhex("text_sha256").alias(gone_digest))
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (text_digest(F.col(text_col)) == F.col(gone_digest))
    return docs.join(gone, same, "left_anti")
