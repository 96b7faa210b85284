"""Graphs as edge tables (a, b)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.shared import shared_folder


#: A node that starts more than this share of all edges is a hub.
HUB_SHARE = 256
#: Edges of a bucket; a graph has no more buckets than its edges fill, since every round opens them all.
BUCKET_EDGES = 1 << 19


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth) of everything reachable from ``starts`` (node), these included at depth 0; null nodes are passed over.

    The edges are written once as a table bucketed by their start, and what was met is a table bucketed by node with a
    partition for each depth, so that a round reads its edges, its frontier and what was met where they lie: the ends
    that a round finds are all that it shuffles. A node is written once and a lost executor costs a round at most; cycles
    end by themselves, and there is no limit of rounds. Hubs, of which there are at most HUB_SHARE, would fill single
    buckets; their edges lie in a table without buckets and meet the few hubs of a frontier by a broadcast.
    """
    spark, name = edges.sparkSession, uuid.uuid4().hex
    kept, hubs, met = (f"closure_{part}_{name}" for part in ("edges", "hubs", "met"))
    folder = shared_folder(spark, "closure")
    kind = starts.schema["node"].dataType
    known = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).filter("a IS NOT NULL AND b IS NOT NULL")
    degrees, total = known.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), known.count()
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, -(-total // BUCKET_EDGES)))
    wide = [r["a"] for r in degrees.filter(F.col("_n") * HUB_SHARE > max(total, 64 * HUB_SHARE)).select("a").collect()]
    is_hub = F.col("a").isin(wide) if wide else F.lit(False)
    try:
        known.filter(~is_hub).repartition(n, "a").write.bucketBy(n, "a").sortBy("a").saveAsTable(kept)
        if wide:
            known.filter(is_hub).write.saveAsTable(hubs)
        depth, found = 0, _met(starts.select("node").filter("node IS NOT NULL").repartition(n, "node").distinct(), met, 0, n, folder)
        while found:
            frontier = spark.table(met).filter(F.col("depth") == depth).select(F.col("node").alias("a"))
            ends = spark.table(kept).join(frontier, "a", "left_semi").select(F.col("b").alias("node"))
            if wide:
                few = F.broadcast(frontier.filter(is_hub))
                ends = ends.unionByName(spark.table(hubs).join(few, "a", "left_semi").select(F.col("b").alias("node")))
            depth += 1
            found = _met(ends.repartition(n, "node").distinct().join(spark.table(met).select("node"), "node", "left_anti"), met, depth, n, None)
    finally:
        for t in (kept, hubs, met):  # the edges go with their table; what was met stays in the shared folder
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    return spark.read.schema(T.StructType([T.StructField("node", kind), T.StructField("depth", T.IntegerType())])).parquet(folder)


def _met(nodes: DataFrame, table: str, depth: int, buckets: int, folder: str | None) -> int:
    """Adds the nodes of a depth to the table, and says how many they are."""
    seen = Observation()
    writer = nodes.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(depth)).write.mode("append").partitionBy("depth").bucketBy(buckets, "node")
    (writer.option("path", folder) if folder else writer).saveAsTable(table)
    return seen.get["n"]


def flagged_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, flag, depth) of all states that paths from ``starts`` reach: what a path carries along as a flag.

    An edge (a, b, turn) sets the flag where ``turn`` is true, clears it where it is false and keeps it where it is null. Paths
    begin without the flag. A state is a node with a flag, so that this is the closure of a graph of twice the size;
    nodes are integers of up to 62 bits.
    """
    flag = F.col("_flag")
    states = edges.withColumn("_flag", F.explode(F.array(F.lit(0), F.lit(1))))
    after = F.coalesce(F.col("turn").cast("int"), flag)
    states = states.select((F.col("a") * 2 + flag).cast("long").alias("a"), (F.col("b") * 2 + after).cast("long").alias("b"))
    reached = closure(states, starts.select((F.col("node") * 2).cast("long").alias("node")))
    return reached.select(F.shiftright("node", 1).alias("node"), F.col("node").bitwiseAND(F.lit(1)).cast("int").alias("flag"), "depth")


def repeated_behind(edges: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node) of the screens that a path reaches after a write, with no screen that bars the way back between.

    ``nodes``: node, writes, screen, back (whether one may go back from it). Going back from such a screen runs the
    write again.
    """
    turn = F.when(F.col("screen") & ~F.col("back"), False).when(F.col("writes"), True)
    turned = edges.join(nodes.select(F.col("node").alias("a"), turn.alias("turn")), "a")
    reached = flagged_closure(turned, starts).join(nodes, "node")
    return reached.filter(F.col("screen") & F.col("back") & (F.col("writes") | (F.col("flag") == 1))).select("node").distinct()


def dependencies(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All edges met when following ``a -> b`` level by level: (a, b, depth, repeated).

    An edge is repeated if its end was reached before its own level.
    """
    nodes = closure(edges, starts)
    out = edges.join(nodes.select(F.col("node").alias("a"), (F.col("depth") + 1).alias("depth")), "a")
    ends = nodes.select(F.col("node").alias("b"), F.col("depth").alias("_first"))
    return out.join(ends, "b").select("a", "b", "depth", (F.col("_first") < F.col("depth")).alias("repeated"))


def referenced_by(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges that end in a target, one hop back, all of them marked as repeated."""
    ends = targets.select(F.col("node").alias("b")).distinct()
    return edges.join(ends, "b", "left_semi").select("a", "b", F.lit(1).alias("depth"), F.lit(True).alias("repeated"))


def cyclomatic(nodes: DataFrame, flow: str) -> DataFrame:
    """(flow, complexity): 1, plus rules + 1 of each decision (1 where it lists none), plus one for each loop."""
    weight = F.when(F.col("kind") == "decision", F.coalesce(F.col("rules") + 1, F.lit(1))).when(F.col("kind") == "loop", 1).otherwise(0)
    return nodes.groupBy(flow).agg((F.lit(1) + F.sum(weight)).cast("long").alias("complexity"))
