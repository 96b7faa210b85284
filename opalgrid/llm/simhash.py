"""SimHash near-duplicates by pivot distance tables.

Every document gets a 64-bit fingerprint from its word shingles. Distinct fingerprints enter a table of Hamming
distances to reference fingerprints (pivots), kept apart for four 16-bit blocks. Two fingerprints that differ in at
most two bits agree on at least two blocks, hence on all pivot distances of those blocks: the six block pairs are the
retrieval keys. Of the pairs that share a key, those whose whole distance vectors differ by more than the limit in any
coordinate cannot be near (triangle inequality) and are discarded; the survivors are verified bit by bit.

A key that more than ``PAIR_LIMIT`` fingerprints share is not paired up. Its members take an exact way of linear size:
two fingerprints differ in at most two bits if and only if some value lies within one bit of both, so each member is
listed under itself and its 64 one-bit neighbours, and members of one list are chained to its smallest. A list has at
most 65 members. Links lost: none; components are the same on either way.

Defined results: a null text is empty; a text without words has fingerprint zero and links like any other; fewer than
three words make one shingle; repeated rows and copies share a fingerprint and so a component; null ids are ignored
when a component is named; texts of any length are read whole; an empty table gives no rows; columns other than the id
and the text are not read, and the filtering variant passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.llm.common import free_name, lookup, materialize, text_of

SEED = 42
SHINGLE = 3
BITS = 2
PIVOTS = 16
BLOCKS = 4
PAIR_LIMIT = 32
CHUNK = 1 << 15


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of one text, lower-cased by ``bytes.lower`` (A-Z) and split by ``bytes.split`` (ASCII blanks)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, dtype=np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + SHINGLE - 1]
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(part, part[1:], part[2:], strict=False))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int32)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * total > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp): the id and the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [fingerprint(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.Series([v - (1 << 64) if v >> 63 else v for v in values], dtype="int64")

    return docs.select(F.col(id_col).cast("long").alias("_id"), simhash(text_of(text_col)).alias("fp"))


def pivots() -> list[int]:
    """Reference fingerprints, signed: SplitMix64 outputs, so that they are fixed by a rule and not by a list."""
    out, state, mask = [], SEED, (1 << 64) - 1
    for _ in range(PIVOTS):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def pivot_table(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp) with ``blocks``: for each block the array of its distances to the pivots' blocks."""
    width = 64 // BLOCKS

    def block(value: Column, b: int) -> Column:
        return F.shiftrightunsigned(value, b * width).bitwiseAND(F.lit((1 << width) - 1))

    def distance(b: int, p: int) -> Column:
        return F.bit_count(block(F.col("fp"), b).bitwiseXOR(F.lit((p >> (b * width)) & ((1 << width) - 1)))).cast("byte")

    # the block's own population is its distance to the zero pivot, which with PIVOTS others pins the block down
    return nodes.select("node", "fp", *[F.array(F.bit_count(block(F.col("fp"), b)).cast("byte"), *[distance(b, p) for p in pivots()]).alias(f"_d{b}") for b in range(BLOCKS)])


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes (node, fp; fp distinct) within BITS bits."""
    table = pivot_table(nodes)
    pairs = list(combinations(range(BLOCKS), BLOCKS - BITS))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"_d{b}") for b in pair]) for i, pair in enumerate(pairs)])
    vector = F.array(*[sum((F.element_at(f"_d{b}", j + 1) for b in range(1, BLOCKS)), F.element_at("_d0", j + 1)).cast("byte") for j in range(PIVOTS + 1)])
    keyed = materialize(table.select("node", "fp", F.explode(keys).alias("_key"), vector.alias("_v")), "pivots")
    shared = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "keys")
    members = lookup(keyed, shared, "_key", "_n", keyed.count())
    members = materialize(members, "members")

    a = members.filter(F.col("_n") <= PAIR_LIMIT).select("_key", F.col("node").alias("a"), F.col("fp").alias("fa"), F.col("_v").alias("va"))
    b = a.select("_key", F.col("a").alias("b"), F.col("fa").alias("fb"), F.col("va").alias("vb"))
    near = a.join(b, "_key").filter(F.col("a") < F.col("b"))
    widest = F.greatest(*[F.abs(F.element_at("va", j + 1) - F.element_at("vb", j + 1)) for j in range(PIVOTS + 1)])
    near = near.filter(widest <= BITS).filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= BITS).select("a", "b")

    crowd = members.filter(F.col("_n") > PAIR_LIMIT).select("node", "fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    lists = crowd.select("node", F.explode(flips).alias("_z")).groupBy("_z").agg(F.collect_set("node").alias("_in"))
    lists = lists.filter(F.size("_in") > 1).select(F.array_min("_in").alias("a"), F.explode("_in").alias("b")).filter("a < b")
    return near.unionByName(lists).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    A round points every node at its smallest neighbour, smaller or not. These pointers make trees of two nodes or
    more, each with one two-node cycle at its root: two steps along them never lead to a larger node, so that the
    smaller node of the cycle is the smallest of the tree. Pointers are doubled until they hold the roots, and edges
    between different roots are the next round's. A round so leaves at most half of the nodes that still have edges:
    rounds grow with the logarithm of the nodes whatever the order of the labels along a path, and there is no limit
    to them. Tables are written to the shared folder. The driver sees one number a step.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    left = True
    while left:
        least = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "least")
        ahead = least.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        trees = materialize(least.join(ahead, "to").select("node", F.least("to", "_next").alias("to")), "trees")
        moved = True
        while moved:
            ahead = trees.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            jumped = materialize(trees.join(ahead, "to").select("node", F.col("to").alias("_was"), F.col("_next").alias("to")), "trees")
            moved = jumped.filter("to <> _was").limit(1).count() > 0
            trees = jumped.select("node", "to")
        root = trees.select(F.col("node").alias("label"), F.col("to").alias("_root"))
        labels = materialize(labels.join(root, "label", "left").select("node", F.coalesce("_root", "label").alias("label")), "labels")
        ends = both.join(trees.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a").join(trees.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b")
        both = materialize(ends.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        left = both.limit(1).count() > 0
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("_n")), "nodes")
    named = nodes.filter("node IS NOT NULL").select("node", "fp")
    labels = components(links(named))
    found = nodes.join(labels, "node", "left").select("fp", "_n", F.coalesce("label", "node").alias("component_id"))
    out = lookup(fps, materialize(found, "found"), "fp", "_n", fps.count())
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; documents with null ids stay."""
    gone_id = free_name(docs, "id")
    gone = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone_id))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
