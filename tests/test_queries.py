"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from opalgrid.operators import graph
from opalgrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame)]
    cells = frame.astype(object).where(frame.notna(), None).map(lambda v: f"{v:.10g}" if isinstance(v, float) else str(v))
    return list(frame), sorted(map(tuple, cells.values.tolist()))


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, key):
    frame = registry.queries()[key](spark, SF).toPandas()
    if key in registry.oracle_sql():
        assert plain(frame) == plain(duck.sql(registry.oracle_sql()[key]).df())
    else:
        assert len(frame.columns)


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_positional_join_has_every_batch(spark, tmp_path):
    keys = spark.range(1, 1001).repartition(7)
    keys.selectExpr("id * 3 AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    keys.filter("id <= 700").selectExpr("id * id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["join_positional"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(3 * i, f"s{i}") for i in range(1, 701)]


ORDERED = "soql_order_by sort_logs_typed sort_toggle sort_auto_numeric sort_manifest rank_autocomplete rank_field_creator rank_schema_objects stream_newest_first sort_locale rank_locale sort_consumption agg_severity_members sink_manifest_lines".split()


@pytest.mark.parametrize("key", ORDERED)
def test_sorted_queries_keep_their_order(spark, duck, key):
    got = [tuple(map(str, r)) for r in registry.queries()[key](spark, SF).collect()]
    assert got and got == [tuple(map(str, r)) for r in duck.sql(registry.oracle_sql()[key]).fetchall()]


@pytest.mark.parametrize("key", ["soql_like", "tbl_filter_any", "tbl_field_search", "join_anti", "graph_fault_path", "rule_unused_variable", "rule_hardcoded"])
def test_predicates_hit(spark, duck, key):
    assert len(duck.sql(registry.oracle_sql()[key]).fetchall())


def test_explain_shows_a_pushed_filter(spark):
    lines = [r["text"] for r in registry.queries()["soql_explain"](spark, SF).collect()]
    assert any("PushedFilters" in x and "EqualTo(o_orderstatus,F)" in x for x in lines) and any("HashAggregate" in x for x in lines)


def test_closure_of_a_long_chain(spark):
    edges = spark.range(0, 12).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(12, 0), (12, 5)], "a long, b long"))
    got = graph.closure(edges, spark.createDataFrame([(2,)], "node long")).collect()
    assert {(r["node"], r["depth"]) for r in got} == {(n, (n - 2) % 13) for n in range(13)}


def test_a_round_shuffles_what_it_finds_alone(spark, monkeypatch):
    plans, write = [], graph._met

    def noted(nodes, *rest):
        plans.append(nodes._jdf.queryExecution().executedPlan().toString())
        return write(nodes, *rest)

    monkeypatch.setattr(graph, "_met", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.range(0, 400).selectExpr("id AS a", "id * 2 + 1 AS b")
    try:
        got = graph.closure(edges, spark.createDataFrame([(0,)], "node long"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["node"], r["depth"]) for r in got.collect()} == {(2**k - 1, k) for k in range(10)}
    assert not spark.sql("SHOW TABLES LIKE 'closure_*'").count()
    for plan in plans[1:]:
        # one exchange, of the ends found; edges, frontier and what was met are read where they lie
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3


def test_closure_with_hubs_nulls_and_cycles(spark):
    rows = [(0, i) for i in range(1, 20_000)] + [(i, i % 7) for i in range(1, 500)] + [(None, 3), (5, None), (19_999, 0)]
    got = graph.closure(spark.createDataFrame(rows, "a long, b long").repartition(5), spark.createDataFrame([(3,), (3,), (None,)], "node long"))
    depths = {r["node"]: r["depth"] for r in got.collect()}
    assert depths == {3: 0} or len(depths) == 1  # 3 leads to itself alone
    got = graph.closure(spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(7,)], "node long"))
    depths = {r["node"]: r["depth"] for r in got.collect()}
    assert depths[7] == 0 and depths[0] == 1 and set(depths) == set(range(20_000)) and max(depths.values()) == 2


def test_flags_along_paths(spark):
    edges = spark.createDataFrame([(1, 2, True), (2, 3, None), (3, 4, False), (4, 5, None), (1, 5, None), (5, 1, None), (2, 6, False), (6, 7, True)], "a long, b long, turn boolean")
    got = {(r["node"], r["flag"]) for r in graph.flagged_closure(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0), (7, 1)}


def test_buckets_follow_the_edges(spark, monkeypatch):
    noted, write = [], graph._met

    def met(nodes, table, depth, buckets, folder):
        noted.append(buckets)
        return write(nodes, table, depth, buckets, folder)

    monkeypatch.setattr(graph, "_met", met)
    kept, edges = spark.conf.get("spark.sql.shuffle.partitions"), spark.range(0, 400).selectExpr("id AS a", "id * 2 + 1 AS b")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for size, buckets in ((graph.BUCKET_EDGES, 2), (100, 4), (1, 64)):
            monkeypatch.setattr(graph, "BUCKET_EDGES", size)
            got = graph.closure(edges.limit(400 if size > 1 else 100), spark.createDataFrame([(0,)], "node long"))
            assert {(r["node"], r["depth"]) for r in got.collect()} >= {(2**k - 1, k) for k in range(7)} and set(noted) == {buckets}
            noted.clear()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
