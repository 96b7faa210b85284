"""The corpus pipeline: classifier, exact dedup, near dedup, mixing, packing.

Each stage works on all that the one before it kept, written as Parquet and read again. All but the last return the
columns of ``documents``; the mix repeats a row as often as it was taken.

Defined results: a null text counts as empty in every stage, and is judged by the classifier like any other text; without
a single label every score is 0.5, and so every document is rejected. Documents with null ids are told apart from others and
are dropped by the classifier alone. Of equal texts the rows with the largest id stay, of near ones those with the smallest, repeated
rows of one id and text together; the mix and the packing treat every row as a document. Texts of any length are read
whole; empty tables give an empty result, and further columns are passed on up to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import exact_dedup, mixing, near_copies, packing, quality_classifier
from opalgrid.llm.common import fresh_path, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, cosine 0.8) the document with the smallest id stays."""
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_exact), ("simhash near dedup", drop_near), ("mixing", mix), ("packing", pack)]

#: No SQL: the classifier, fingerprints and tokenizer are not expressible; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            path = fresh_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
