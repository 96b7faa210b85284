"""Hard negatives: rows of another label that score a set share of what an anchor's positives score, exactly.

The largest inner products are nearest neighbours once vectors are augmented: a row x becomes (x, sqrt(M^2 - |x|^2)),
M being the longest row, and a query q becomes (q, 0), so that their squared distance is M^2 + |q|^2 - 2 x.q. Every row is
stored under a one-dimensional key, (nearest pivot, distance to it), in a table sorted by that key and cut into cells
of up to ``CELL`` rows of one pivot. By the triangle inequality a row within r of a query lies, under any pivot, in the
interval of keys [d - r, d + r], d being the query's distance to the pivot. A search scans these intervals for a small r,
then the annuli that a larger r adds, and last whatever lies within the distance of its worst hit so far (or of the
lowest score it accepts): every row beyond that is farther, which certifies the result. Where distances say little
(random vectors of many dimensions) the last round scans nearly all cells; results are the same.

Queries travel in blocks of up to ``BLOCK`` with like keys; a scan meets blocks with cells, partitioned by cell and by
part of the blocks, so that a task holds one cell and one block whatever the number of either. All vectors enter the
index. Pivots alone are fitted on a sample of at most ``SAMPLE`` rows, and a poor one costs time, never rows.

Scores are integers: each component x counts as floor(256 * x), held to +-2**20 (x to 4,096), so that products of up to
8,192 components are exact. Labels and ids are integers.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter
vector counts as padded with zeros, an empty one scores 0 with all; a zero vector is a row like any other; equal scores
are ordered by id; rows that share an id are separate rows, but none is a positive or negative of an anchor with the same id,
and repeated anchors repeat their results; an anchor without positives or without fitting negatives has no rows; a
positive with a negative score has no negatives, as no score lies between; an empty table gives no rows. Only the three
named columns are read, whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm.common import materialize

SCALE = 256
LARGEST = 1 << 20
DIMENSIONS = 8192
PIVOTS = 32
SAMPLE = 2048
CELL = 512
BLOCK = 128
#: Blocks that a part of a cell's work holds at most, about.
PART_BLOCKS = 64
#: Blocks whose best scores a task remembers from one cell to the next.
KEPT_BLOCKS = 256
#: Radii of the rounds before the last, as shares of the longest distance there can be.
SHARES = (1 / 64, 1 / 8)
#: Beyond every score.
FAR = 1 << 60


@dataclass
class Index:
    """cells (cell, pivot, lo, hi, ids, labels, vecs), sorted by (pivot, distance); M; the pivots; the dimensions."""

    cells: DataFrame
    longest: float
    pivots: Any
    dimensions: int


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec) of the rows that take part; components as integers."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vec, lambda x: F.floor(F.lit(SCALE) * F.greatest(F.least(x.cast("double"), F.lit(1e6)), F.lit(-1e6))))
    held = F.transform(whole, lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    named = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull()
    return rows.filter(named & finite).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), held.alias("vec"))


def _matrix(column: Any, dimensions: int) -> Any:
    """An Arrow column of integer lists as rows, padded with zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dimensions))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def fit_pivots(sample: Any, longest: float, count: int = PIVOTS, rounds: int = 5) -> Any:
    """Centres of an augmented sample, by a few rounds of k-means from its first rows."""
    import numpy as np

    full = np.hstack([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(axis=1), 0))[:, None]])
    centres = np.unique(full, axis=0)[:: max(1, len(np.unique(full, axis=0)) // count)][:count]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1)[None] - 2 * full @ centres.T, axis=1)
        centres = np.array([full[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(rows: Any, last: Any, pivots: Any) -> Any:
    """Distances of augmented rows to all pivots."""
    import numpy as np

    full = np.hstack([rows, last[:, None]])
    squares = (full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _lists(groups: list[Any]) -> Any:
    """Arrays as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, groups)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(groups) if groups else np.zeros(0)))


def keyed(points: DataFrame, longest: float, pivots: Any, dimensions: int, queries: bool) -> DataFrame:
    """(pivot, dist, id, label, vec binary, reach): key of each row, or of each query with its distances to all pivots."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS rows

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = _matrix(batch.column("vec"), dimensions)
            last = np.zeros(len(rows)) if queries else np.sqrt(np.maximum(longest**2 - (rows**2).sum(axis=1), 0))
            away = _distances(rows, last, shared.value)
            pivot = np.argmin(away, axis=1).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
            vecs = pa.array([r.tobytes() for r in rows.astype(np.int32)], type=pa.binary())
            reach = _lists(list(away) if queries else [away[i, :0] for i in range(len(rows))]) if len(rows) else pa.array([], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(away[np.arange(len(rows)), pivot]), batch.column("id"), batch.column("label"), vecs, reach], ["pivot", "dist", "id", "label", "vec", "reach"])

    return points.mapInArrow(run, "pivot int, dist double, id long, label long, vec binary, reach array<double>")


def packed(keys: DataFrame, most: int) -> DataFrame:
    """Records of up to ``most`` rows with one pivot and neighbouring distances; keys that many rows share are split by id."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            pivot, dist = batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            turns = np.flatnonzero(np.diff(pivot)) + 1
            cuts = [x for a, b in zip([0, *turns], [*turns, len(pivot)], strict=True) for x in range(a, b, most)] + [len(pivot)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            ids, labels, vecs = batch.column("id").to_numpy(), batch.column("label").to_numpy(), batch.column("vec").to_pylist()
            reach = batch.column("reach")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pivot[a] for a, _ in spans]), pa.array([dist[a] for a, _ in spans]), pa.array([dist[b - 1] for _, b in spans]), _lists([ids[a:b] for a, b in spans]),
                    _lists([labels[a:b] for a, b in spans]), pa.array([b"".join(vecs[a:b]) for a, b in spans], type=pa.binary()), _lists([reach.slice(a, b - a).flatten().to_numpy() for a, b in spans]),
                ],
                ["pivot", "lo", "hi", "ids", "labels", "vecs", "reach"],
            )

    return ranged.mapInArrow(run, "pivot int, lo double, hi double, ids array<long>, labels array<long>, vecs binary, reach array<double>")


def build_index(points: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> Index:
    """The index of all points (id, label, vec)."""
    import numpy as np

    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    size, most = points.agg(F.max(F.size("vec")), F.max(norm)).first()
    if (size or 0) > DIMENSIONS:
        raise ValueError(f"vectors of up to {DIMENSIONS} components, not {size}")
    dimensions, longest = max(1, size or 0), float(most or 0) ** 0.5
    some = points.select("vec", F.xxhash64(F.lit("pivots"), "id").alias("_h"), "id").orderBy("_h", "id").limit(sample).collect()
    rows = np.zeros((max(1, len(some)), dimensions))
    for i, r in enumerate(some):
        rows[i, : len(r["vec"])] = r["vec"]
    centres = fit_pivots(rows, longest, pivots)
    cells = packed(keyed(points, longest, centres, dimensions, queries=False), CELL).drop("reach").withColumn("cell", F.monotonically_increasing_id())
    return Index(materialize(cells, "cells"), longest, centres, dimensions)


def query_blocks(index: Index, queries: DataFrame) -> DataFrame:
    """Blocks of queries (id, label, vec) with like keys: (block, ids, labels, vecs, reach)."""
    keys = keyed(queries, index.longest, index.pivots, index.dimensions, queries=True)
    return materialize(packed(keys, BLOCK).drop("pivot", "lo", "hi").withColumn("block", F.monotonically_increasing_id()), "blocks")


def _shells(index: Index, asked: DataFrame, radius: float) -> DataFrame:
    """(block, pivot, lo, hi): the keys in which rows within the radius, or within what is still wanted, can lie."""
    longest, dimensions, pivots = index.longest, index.dimensions, len(index.pivots)
    slack = 1e-6 * (longest + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for row in batch.itertuples(index=False):
                vecs = np.frombuffer(row.vecs, dtype="<i4").reshape(-1, dimensions).astype(np.float64)
                base = longest**2 + (vecs**2).sum(axis=1)[row.places]
                farthest, nearest = base - 2.0 * row.lows, np.sqrt(np.maximum(base - 2.0 * row.highs, 0))
                within = np.minimum(np.sqrt(np.maximum(farthest, 0)), radius) + slack
                away = row.reach.reshape(-1, pivots)[row.places]
                lo, hi = np.maximum(away - within[:, None], nearest[:, None] - away - slack), away + within[:, None]
                open_ = (lo <= hi) & (farthest >= -slack)[:, None]
                lo, hi = np.where(open_, lo, np.inf).min(axis=0), np.where(open_, hi, -np.inf).max(axis=0)
                some = np.flatnonzero(lo <= hi)
                yield pd.DataFrame({"block": row.block, "pivot": some, "lo": lo[some], "hi": hi[some]})

    return asked.select("block", "vecs", "reach", "places", "lows", "highs").mapInPandas(run, "block long, pivot int, lo double, hi double")


def _hits(index: Index, asked: DataFrame, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """(block, place, win, score, id): of every pair of block and cell the first ``k`` rows of each window."""
    dimensions = index.dimensions
    parts = ceil(asked.count() / PART_BLOCKS) or 1
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    windows = [F.col(c) for c in ("places", "wins", "lows", "highs")]
    blocks = dealt.join(asked, "block").select("cell", "part", "block", "ids", "labels", "vecs", *windows)
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("places", "wins", "lows", "highs")]
    cells = dealt.select("cell", "part").distinct().join(index.cells, "cell").select("cell", "part", F.lit(None).cast("long").alias("block"), "ids", "labels", "vecs", *nothing)
    stream = cells.unionByName(blocks).repartition("cell", "part").sortWithinPartitions("cell", "part", "block")  # a cell comes before its blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        ids = labels = rows = None
        best: dict[int, Any] = {}  # the k best scores so far of each window of a block
        for batch in batches:
            for row in batch.itertuples(index=False):
                vecs = np.frombuffer(row.vecs, dtype="<i4").reshape(-1, dimensions).astype(np.float64)
                if row.places is None:
                    ids, labels, rows = row.ids, row.labels, vecs.T
                    continue
                scores = (vecs @ rows).astype(np.int64)  # exact: sums stay below 2**53
                fits = ((row.labels[:, None] == labels[None]) == same) & (row.ids[:, None] != ids[None])
                own = scores[row.places]
                fits = fits[row.places] & (own >= row.lows[:, None]) & (own <= row.highs[:, None])
                if len(best) >= KEPT_BLOCKS:
                    best.clear()
                scored = np.hstack([best.get(row.block, np.full((len(own), k), -FAR)), np.where(fits, own, -FAR)])
                best[row.block] = scored = np.partition(scored, len(ids), axis=1)[:, len(ids) :]
                fits &= own >= scored.min(axis=1)[:, None]  # what k rows of this task outdo cannot be among the first k
                at, to = np.nonzero(fits)
                order = np.lexsort((ids[to], -own[at, to], at))
                at, to = at[order], to[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, to = at[first], to[first]
                yield pd.DataFrame({"block": row.block, "place": row.places[at], "win": row.wins[at], "score": own[at, to], "id": ids[to]}).astype({"block": "int64"})

    return stream.mapInPandas(run, "block long, place int, win int, score long, id long")


def search(index: Index, blocks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """(block, place, win, score, id, rank): the first ``k`` rows of every window (block, place, win, low, high).

    A window asks, for the query at a place of a block, for rows with the same label (or with another one) whose
    scores lie between low and high. Every round writes its pairs and its best rows to the shared folder.
    """
    key = ["block", "place", "win"]
    directory = index.cells.select("cell", "pivot", "lo", "hi")
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    found, met = None, None
    longest = 4 * index.longest + 1
    for radius in (*[longest * s for s in SHARES], float("inf")):
        wanted = windows
        if found is not None:
            full = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).filter(F.col("_n") == k)
            wanted = windows.join(full, key, "left").withColumn("low", F.greatest("low", "_least"))
        grouped = wanted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "win", "low", "high"))).alias("_w"))  # BLOCK times the windows of a query
        asked = blocks.join(grouped, "block").select("*", *[F.col(f"_w.{c}").alias(f"{c}s") for c in ("place", "win", "low", "high")]).drop("_w")
        shells = _shells(index, asked, radius).select("block", "pivot", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        pairs = shells.join(directory, "pivot").filter("_lo <= hi AND lo <= _hi").select("block", "cell")
        pairs = materialize(pairs if met is None else pairs.join(met, ["block", "cell"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            hits = _hits(index, asked, pairs, k, same)
            hits = hits if found is None else hits.unionByName(found.drop("rank"))
            found = materialize(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        met = pairs if met is None else met.unionByName(pairs)
    return found if found is not None else windows.select(*key, F.col("low").alias("score"), F.col("low").alias("id"), F.col("win").alias("rank")).limit(0)


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """A row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``positives`` other rows of the same label; the negatives of each are the first
    ``negatives`` rows of other labels that score at least ``low`` and at most ``high`` percent of the positive's score.
    ``anchors`` is a condition on the id column.
    """
    points = materialize(usable(rows, id_col, vec_col, label_col), "points")
    index = build_index(points)
    named = points.withColumnRenamed("id", id_col).filter(anchors).withColumnRenamed(id_col, "id")
    blocks = query_blocks(index, named)
    queries = blocks.select("block", F.posexplode("ids").alias("place", "anchor_id"))
    whole = queries.select("block", "place", F.lit(0).alias("win"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    near = search(index, blocks, whole, positives, same=True).select("block", "place", F.col("rank").alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    per = F.col("positive_score")
    windows = near.filter(per >= 0).select("block", "place", "win", F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"(positive_score * {high}) div 100").alias("high"))
    hard = search(index, blocks, windows, negatives, same=False).select("block", "place", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near, ["block", "place", "win"]).join(queries, ["block", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
