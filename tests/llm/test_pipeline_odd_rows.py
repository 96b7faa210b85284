"""The whole pipeline over empty tables, null and repeated ids, ties and extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, path, rows, labels, schema=SCHEMA):
    import corpus_pipeline

    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, str(path))


@pytest.mark.parametrize("what", ["nothing", "no labels", "all null"])
def test_empty_tables(spark, tmp_path, what):
    rows = {"nothing": [], "no labels": [(i, f"some words of text {i}", "en", "s", 1) for i in range(20)], "all null": [(None,) * 5] * 5}[what]
    out = run(spark, tmp_path, rows, [])
    pieces = out.collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    # a classifier that has seen no label rejects every document
    assert not pieces


def test_null_and_repeated_ids(spark, tmp_path):
    own = random.Random(4)
    text = lambda n: " ".join(own.choices([f"w{k}" for k in range(500)], k=n))
    good = [(i, text(60)) for i in range(80)] + [(None, text(60)) for _ in range(40)] + [(7, text(60)) for _ in range(20)]
    bad = [(1000 + i, " ".join(f"##{w}$$" for w in text(60).split())) for i in range(40)]
    rows = [(i, t, "en", ("a", None)[k % 2], 1, "x") for k, (i, t) in enumerate(good + good[:5] + bad)]
    labels = [(i, int(i < 1000), 0) for i, _ in good + bad if i is not None]
    out = run(spark, tmp_path, rows, labels, f"{SCHEMA}, _id string").collect()
    ids = {r["doc_id"] for r in out}
    assert None in ids and 7 in ids and not any(i is not None and i >= 1000 for i in ids)
    # repeated rows stay together, and a mix of 1.5 times its input holds no row more than twice
    whole = sum(r["start"] == 0 for r in out)
    assert len(good) < whole <= 2 * (len(good) + 5)
