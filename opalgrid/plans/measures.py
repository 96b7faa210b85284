"""Queries of aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opalgrid.functions import text as tx
from opalgrid.operators import ranking as rk
from opalgrid.operators import sketches as sk
from opalgrid.operators import tables as tb
from opalgrid.plans.dialect import table
from opalgrid.plans.registry import register
from opalgrid.plans.shaping import LIMITS_SQL, limits

def n_rows():
    return F.count(F.lit(1))


def _usage(name: str, filled: str, total: str) -> str:
    share = f"({filled} * 100.0::DOUBLE / {total})"
    return f"SELECT '{name}' AS field, {filled} AS filled, {total} AS total, CASE WHEN {total} <= 0 THEN 0.0 WHEN floor({share} + 0.5) = 0 AND {filled} > 0 THEN round({share}, 3) ELSE floor({share} + 0.5) END::DOUBLE AS usage FROM x"


@register("agg_field_usage", "WITH x AS (SELECT count(*) AS n, count(nullif(o_orderstatus, 'P')) AS s, count(CASE WHEN o_orderkey = 1 THEN 1 END) AS r, count(o_totalprice) AS p FROM orders) " + " UNION ALL ".join([_usage("status", "s", "n"), _usage("rare", "r", "n"), _usage("o_totalprice", "p", "n"), _usage("none", "0", "n")]))
def agg_field_usage(spark, d):
    rows = table(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.when(F.col("o_orderkey") == 1, 1).alias("rare"), "o_totalprice", F.lit(None).cast("int").alias("none"))
    return tb.field_usage(rows)


CALLS = "SELECT CASE WHEN user_id % 2 = 0 THEN 'rest' ELSE 'soap' END AS mode, event_type AS method, value AS duration, event_type = 'error' AS failed, event_id, ts, user_id FROM events"


def calls(spark, d):
    mode = F.when(F.col("user_id") % 2 == 0, "rest").otherwise("soap")
    return table(spark, d, "events").select(mode.alias("mode"), F.col("event_type").alias("method"), F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"), "event_id", "ts", "user_id")


@register("agg_api_stats", f"SELECT mode, method, count(*) AS total, count(*) FILTER (WHERE failed) AS errors, round(sum(duration), 4) AS spent FROM ({CALLS}) GROUP BY GROUPING SETS ((mode), (mode, method))")
def agg_api_stats(spark, d):
    return spark.sql("SELECT mode, method, count(*) AS total, count_if(failed) AS errors, round(sum(duration), 4) AS spent FROM {api_calls} GROUP BY GROUPING SETS ((mode), (mode, method))", api_calls=calls(spark, d))


@register("agg_api_avg", f"SELECT mode, CASE WHEN count(*) > 0 THEN floor(sum(duration) / count(*) + 0.5) ELSE 0 END::DOUBLE AS average, CAST(floor(date_diff('minute', min(ts), max(ts))) AS BIGINT) AS minutes FROM ({CALLS}) GROUP BY ROLLUP(mode)")
def agg_api_avg(spark, d):
    rows = calls(spark, d).rollup("mode")
    minutes = (F.unix_seconds(F.date_trunc("minute", F.max("ts")).cast("timestamp")) - F.unix_seconds(F.date_trunc("minute", F.min("ts")).cast("timestamp"))) / 60
    return rows.agg(F.when(n_rows() > 0, F.floor(F.sum("duration") / n_rows() + 0.5)).otherwise(0).cast("double").alias("average"), F.floor(minutes).alias("minutes"))


@register("agg_perf_batches", "SELECT count(*) AS n, round(avg(value), 1) AS average, round(min(value), 1) AS lowest, round(max(value), 1) AS highest FROM events HAVING count(*) > 1")
def agg_perf_batches(spark, d):
    rows = table(spark, d, "events").agg(n_rows().alias("n"), *[F.round(f("value"), 1).alias(k) for k, f in (("average", F.avg), ("lowest", F.min), ("highest", F.max))])
    return rows.filter("n > 1")


CONSUMED = f"SELECT name, CASE WHEN mx = 0 THEN NULL ELSE (mx - remaining) / mx::DOUBLE END AS used, CASE WHEN mx = 0 THEN 0 ELSE CAST(floor((1 - remaining / mx::DOUBLE) * 100 + 0.5) AS BIGINT) END AS gauge, remaining < 0 AS over FROM ({LIMITS_SQL})"


@register("agg_limits_consumption", CONSUMED)
def agg_limits_consumption(spark, d):
    used = F.try_divide((F.col("mx") - F.col("remaining")).cast("double"), F.col("mx"))
    gauge = F.coalesce(F.floor((1 - F.try_divide(F.col("remaining").cast("double"), F.col("mx"))) * 100 + 0.5), F.lit(0))
    return limits(spark, d).select("name", used.alias("used"), gauge.alias("gauge"), (F.col("remaining") < 0).alias("over"))


@register("agg_import_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, CAST(0 AS BIGINT) AS processing, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders")
def agg_import_counts(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(s == "O").alias("queued"), F.count_if(s == "Q").alias("processing"), F.count_if(s == "F").alias("succeeded"), F.count_if(s == "P").alias("failed"))


GROUP_SQL = "CASE WHEN starts_with(p_type, 'STANDARD') THEN 'Field_' || p_brand ELSE p_type END"


def part_groups(spark, d):
    key = F.when(F.col("p_type").startswith("STANDARD"), F.concat(F.lit("Field_"), "p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").withColumn("kind", key)


@register("agg_dep_groups", f"SELECT kind, count(*) OVER (PARTITION BY kind) AS n, p_partkey FROM (SELECT {GROUP_SQL} AS kind, p_partkey FROM part) ORDER BY n DESC, kind, p_partkey")
def agg_dep_groups(spark, d):
    """Groups, largest first, a row per member: no group is gathered."""
    rows = part_groups(spark, d).select("kind", "p_partkey")
    return rows.join(rows.groupBy("kind").agg(n_rows().alias("n")), "kind").select("kind", "n", "p_partkey").orderBy(F.desc("n"), "kind", "p_partkey")


@register("agg_dep_flat_groups", f"SELECT kind, count(*) AS n FROM (SELECT {GROUP_SQL} AS kind, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2) GROUP BY kind")
def agg_dep_flat_groups(spark, d):
    return rk.first_per_key(part_groups(spark, d), ["kind", "p_size"], [F.col("p_partkey")]).groupBy("kind").agg(n_rows().alias("n"))


@register("agg_dep_counts", "SELECT l_returnflag, count(*) AS total, count(DISTINCT (l_partkey, l_suppkey)) AS different FROM lineitem GROUP BY l_returnflag")
def agg_dep_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(n_rows().alias("total"), F.count_distinct("l_partkey", "l_suppkey").alias("different"))


@register("agg_type_breakdown", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def agg_type_breakdown(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(n_rows().alias("n")).orderBy(F.desc("n"), "p_type")


@register("agg_severity_groups", "SELECT CASE event_type WHEN 'error' THEN 1 ELSE 3 END AS place, event_type AS rule, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def agg_severity_groups(spark, d):
    order = F.array_position(F.array(*[F.lit(x) for x in ("error", "warning", "info", "note")]), tx.severity(F.col("event_type"))).cast("int")
    return table(spark, d, "events").groupBy(order.alias("place"), F.col("event_type").alias("rule")).agg(n_rows().alias("n"), F.min("event_id").alias("first_id"))


@register("agg_field_by_label", "SELECT lower(p_type) AS label, count(DISTINCT p_brand) AS objects, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names FROM part GROUP BY 1")
def agg_field_by_label(spark, d):
    names = F.array_sort(F.collect_set("p_brand"))
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("label")).agg(F.size(names).cast("long").alias("objects"), F.array_join(names, ",").alias("names"))


@register("agg_manifest", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members FROM part GROUP BY p_type")
def agg_manifest(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("members"))


@register("agg_purge_stats", "SELECT o_custkey, count(*) AS found, count(*) FILTER (WHERE o_orderstatus <> 'P') AS deleted, bool_and(o_orderstatus <> 'P') AS done FROM orders GROUP BY o_custkey")
def agg_purge_stats(spark, d):
    ok = F.col("o_orderstatus") != "P"
    return table(spark, d, "orders").groupBy("o_custkey").agg(n_rows().alias("found"), F.count_if(ok).alias("deleted"), F.bool_and(ok).alias("done"))


@register("agg_field_objects", """WITH p AS (SELECT lower(p_type) AS label, p_brand AS object, min(p_partkey) AS first_key FROM part GROUP BY 1, 2)
SELECT label, object, first_key, count(*) OVER (PARTITION BY label) AS objects FROM p""")
def agg_field_objects(spark, d):
    """Fields by label: a row per object that has one, with the first record of it and how many objects share the label."""
    pairs = table(spark, d, "part").groupBy(F.lower("p_type").alias("label"), F.col("p_brand").alias("object")).agg(F.min("p_partkey").alias("first_key"))
    return pairs.join(pairs.groupBy("label").agg(n_rows().alias("objects")), "label").select("label", "object", "first_key", "objects")


@register("agg_purge_children", """WITH c AS (SELECT l_orderkey, count(*) AS found, count(*) FILTER (l_returnflag <> 'R') AS deleted, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS stuck FROM lineitem GROUP BY 1)
SELECT o_custkey, o_orderkey, version, coalesce(found, 0) AS found, coalesce(deleted, 0) AS deleted, coalesce(found, 0) = coalesce(deleted, 0) AS version_deleted, CASE WHEN stuck IS NOT NULL THEN 'line ' || stuck || ' is locked' END AS error
FROM (SELECT * FROM ({VERSIONS}) QUALIFY NOT (version > (max(version) OVER (PARTITION BY o_custkey)) - 3 OR version = 2)) LEFT JOIN c ON l_orderkey = o_orderkey""".replace("{VERSIONS}", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders"))
def agg_purge_children(spark, d):
    """What purging old versions found and deleted of their children; a version goes when all of its children did."""
    locked = F.col("l_returnflag") == "R"
    children = table(spark, d, "lineitem").groupBy("l_orderkey").agg(n_rows().alias("found"), F.count_if(~locked).alias("deleted"), F.min(F.when(locked, F.col("l_linenumber"))).alias("stuck"))
    old = rk.keep_latest(versions(spark, d), "o_custkey", "version", "active", 2).filter("NOT keep")
    rows = old.join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("found", "deleted")})
    error = F.concat(F.lit("line "), F.col("stuck").cast("string"), F.lit(" is locked"))
    return rows.select("o_custkey", "o_orderkey", "version", "found", "deleted", (F.col("found") == F.col("deleted")).alias("version_deleted"), error.alias("error"))


@register("agg_group_urls", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1)) AS n, url FROM pages ORDER BY host, url")
def agg_group_urls(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    return rows.join(rows.groupBy("host").agg(n_rows().alias("n")), "host").select("host", "n", "url").orderBy("host", "url")


@register("agg_section_groups", "SELECT o_orderpriority, max(n) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE k <= 5 GROUP BY 1")
def agg_section_groups(spark, d):
    rows = table(spark, d, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    few = rows.select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 5").groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("sample"))
    return few.join(rows.groupBy("o_orderpriority").agg(n_rows().alias("n")), "o_orderpriority").select("o_orderpriority", "n", "sample")


@register("agg_match_count", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) AS BIGINT) AS n FROM documents")
def agg_match_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"\Qthe\E")).cast("long").alias("n"))


@register("agg_permission_fold", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def agg_permission_fold(spark, d):
    folded = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(folded.alias("m"))
    return rows.select("n_regionkey", F.size("m").cast("long").alias("n"), F.array_join(F.map_values("m"), ",").alias("names"))


VERSIONS = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders"


def versions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version")).withColumn("active", F.col("version") == 2)


@register("win_keep_latest", f"SELECT o_orderkey, version > (max(version) OVER (PARTITION BY o_custkey)) - 3 OR version = 2 AS keep FROM ({VERSIONS})")
def win_keep_latest(spark, d):
    return rk.keep_latest(versions(spark, d), "o_custkey", "version", "active", 2).select("o_orderkey", "keep")


HISTORY = "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, event_type) AS place FROM (SELECT user_id, event_type, max(ts) AS newest FROM events GROUP BY 1, 2) QUALIFY place <= 3"


@register("win_history_dedup", HISTORY)
@register("tbl_history", HISTORY)
def win_history_dedup(spark, d):
    return rk.recent_history(table(spark, d, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", F.col("place").cast("long").alias("place"))


@register("win_last_errors", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def win_last_errors(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(10).select("event_id")


@register("win_next_index", "SELECT CAST(max(CAST(regexp_extract(n, '^Query ?([0-9]+)$', 1) AS BIGINT)) + 1 AS BIGINT) AS next FROM (SELECT 'Query ' || c_custkey AS n FROM customer)")
def win_next_index(spark, d):
    name = F.concat(F.lit("Query "), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").agg((F.coalesce(F.max(F.regexp_extract(name, "^Query ?([0-9]+)$", 1).try_cast("long")), F.lit(0)) + 1).alias("next"))


@register("win_unique_name", "SELECT p_partkey, p_type || CASE WHEN row_number() OVER w > 1 THEN ' (' || (row_number() OVER w - 1) || ')' ELSE '' END AS name FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)")
def win_unique_name(spark, d):
    k = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.concat("p_type", F.when(k > 1, F.concat(F.lit(" ("), (k - 1).cast("string"), F.lit(")"))).otherwise("")).alias("name"))


@register("win_repeated_flag", "SELECT l_orderkey, l_linenumber, min(l_orderkey) OVER (PARTITION BY l_partkey) < l_orderkey AS repeated FROM lineitem")
def win_repeated_flag(spark, d):
    first = F.min("l_orderkey").over(Window.partitionBy("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (first < F.col("l_orderkey")).alias("repeated"))


FIRST = "SELECT p_type, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY p_type"


@register("win_first_per_key", FIRST)
@register("dedup_key", FIRST)
def win_first_per_key(spark, d):
    part = table(spark, d, "part").select("p_type", "p_partkey")
    a = rk.first_per_key(part, ["p_type"], [F.col("p_partkey")]).withColumnRenamed("p_partkey", "first_key")
    b = rk.first_per_key(part, ["p_type"], [F.col("p_partkey").desc()]).withColumnRenamed("p_partkey", "last_key")
    return a.join(b, "p_type")


@register("win_batch_assign", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 200) AS BIGINT) AS batch FROM orders")
def win_batch_assign(spark, d):
    return rk.batches(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 200, ["o_orderpriority"]).select("o_orderkey", "batch")


@register("win_first_last_child", "SELECT n_nationkey, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY n_regionkey) THEN '└─ ' ELSE '├─ ' END || n_name AS line FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)")
def win_first_last_child(spark, d):
    group = Window.partitionBy("n_regionkey")
    last = F.row_number().over(group.orderBy("n_name")) == F.count(F.lit(1)).over(group)
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.when(last, "└─ ").otherwise("├─ "), "n_name").alias("line"))


@register("sort_logs_typed", "SELECT event_id FROM events ORDER BY nullif(value, 0) DESC NULLS LAST, event_id")
def sort_logs_typed(spark, d):
    return table(spark, d, "events").orderBy(F.nullif(F.col("value"), F.lit(0.0)).desc_nulls_last(), "event_id").select("event_id")


@register("sort_toggle", "SELECT c_custkey FROM customer ORDER BY c_name DESC")
def sort_toggle(spark, d):
    clicks, column = 2, F.col("c_name")
    return table(spark, d, "customer").orderBy(column.asc() if clicks % 2 else column.desc()).select("c_custkey")


@register("sort_auto_numeric", "SELECT p_partkey FROM part ORDER BY p_size, p_partkey")
def sort_auto_numeric(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.format_string("%d.%06d", F.col("p_size"), "p_partkey").alias("v"))
    return rk.auto_sort(rows, "v").select("p_partkey")


@register("sort_consumption", f"SELECT name FROM ({CONSUMED}) ORDER BY used DESC NULLS LAST, name")
def sort_consumption(spark, d):
    return agg_limits_consumption(spark, d).orderBy(F.col("used").desc_nulls_last(), "name").select("name")


TIER = "CASE WHEN lower({v}) = '{x}' THEN 1 WHEN lower({t}) = '{x}' THEN 2 WHEN starts_with(lower({v}), '{x}') THEN 3 WHEN starts_with(lower({t}), '{x}') THEN 4 WHEN contains(lower({v}), '__{x}') THEN 5 WHEN contains(lower({v}), '_{x}') THEN 6 WHEN contains(lower({t}), ' {x}') THEN 7 ELSE 8 END"


@register("rank_autocomplete", f"SELECT p_partkey, {TIER.format(v='p_name', t='p_type', x='steel')} AS tier FROM part ORDER BY tier, p_partkey")
def rank_autocomplete(spark, d):
    rows = table(spark, d, "part").select("p_partkey", rk.match_tier(F.col("p_name"), F.col("p_type"), "STEEL").alias("tier"))
    return rows.orderBy("tier", "p_partkey")


@register("rank_objects", "SELECT n_name, CASE WHEN n_nationkey = 7 THEN 2 WHEN lower(n_name) = 'nation_7' THEN 3 WHEN starts_with(lower(n_name), '007') THEN 5 ELSE 10 END + CASE WHEN n_regionkey = 0 THEN 20 ELSE 0 END AS tier FROM nation")
def rank_objects(spark, d):
    apis = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("regular")))
    tier = rk.object_tier(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.col("n_name"), F.col("n_name"), apis, "007")
    return table(spark, d, "nation").select("n_name", tier.alias("tier"))


@register("rank_best_match", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_name = (SELECT max(c_name) FROM customer) THEN 1 ELSE 2 END, c_custkey LIMIT 1")
def rank_best_match(spark, d):
    customer = table(spark, d, "customer")
    wanted = customer.agg(F.max("c_name").alias("wanted"))
    return customer.join(F.broadcast(wanted)).orderBy(F.when(F.col("c_name") == F.col("wanted"), 1).otherwise(2), "c_custkey").limit(1).select("c_custkey")  # one row is broadcast


@register("rank_field_creator", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') ORDER BY greatest(CASE WHEN lower(p_name) = 'a' THEN 4 WHEN starts_with(lower(p_name), 'a') THEN 3 WHEN contains(lower(p_name), 'a') THEN 2 ELSE 0 END, CASE WHEN lower(p_type) = 'a' THEN 4 WHEN starts_with(lower(p_type), 'a') THEN 3 WHEN contains(lower(p_type), 'a') THEN 2 ELSE 0 END) DESC, length(p_name), p_name, p_partkey")
def rank_field_creator(spark, d):
    score = rk.search_score(F.col("p_name"), F.col("p_type"), "A")
    return table(spark, d, "part").filter(score > 0).orderBy(score.desc(), F.length("p_name"), "p_name", "p_partkey").select("p_partkey")


@register("rank_schema_objects", "SELECT n_name FROM nation WHERE contains(lower(n_name), 'i') ORDER BY CASE WHEN lower(n_name) = 'i' THEN 0 WHEN starts_with(lower(n_name), 'i') THEN 1 ELSE 2 END, n_name")
def rank_schema_objects(spark, d):
    low = F.lower("n_name")
    return table(spark, d, "nation").filter(F.contains(low, F.lit("i"))).orderBy(F.when(low == "i", 0).when(low.startswith("i"), 1).otherwise(2), "n_name").select("n_name")


@register("topk_endpoints", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def topk_endpoints(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(n_rows().alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@register("page_logs", "SELECT event_id, 75 < (SELECT count(*) FROM events) AS has_more FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def page_logs(spark, d):
    size, page = 25, 2
    logs = table(spark, d, "events")
    more = logs.agg((n_rows() > (page + 1) * size).alias("has_more"))
    rows = logs.orderBy(F.desc("ts"), "event_id").offset(page * size).limit(size).select("event_id")
    return rows.join(F.broadcast(more))  # one row is broadcast


@register("topk_search_limits", "SELECT * FROM (SELECT 'customer' AS source, c_name AS name FROM customer ORDER BY c_name LIMIT 15) UNION ALL SELECT * FROM (SELECT 'part', p_name FROM part ORDER BY p_name, p_partkey LIMIT 20)")
def topk_search_limits(spark, d):
    a = table(spark, d, "customer").orderBy("c_name").limit(15).select(F.lit("customer").alias("source"), F.col("c_name").alias("name"))
    b = table(spark, d, "part").orderBy("p_name", "p_partkey").limit(20).select(F.lit("part").alias("source"), F.col("p_name").alias("name"))
    return a.unionByName(b)


@register("sort_manifest", "SELECT DISTINCT p_type || '~' || p_brand AS entry FROM part ORDER BY 1")
def sort_manifest(spark, d):
    return table(spark, d, "part").select(F.concat_ws("~", "p_type", "p_brand").alias("entry")).distinct().orderBy("entry")


@register("union_all", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name")))


@register("union_hetero", "SELECT r_name AS name, r_regionkey AS region, NULL AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
def union_hetero(spark, d):
    a = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return a.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation")), allowMissingColumns=True)


@register("distinct_values", "SELECT DISTINCT l_partkey FROM lineitem")
def distinct_values(spark, d):
    return table(spark, d, "lineitem").select("l_partkey").distinct()


EXCEPT = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


@register("except_keepset", EXCEPT)
@register("join_anti", EXCEPT)
def except_keepset(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("filter_used_values", "SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
def filter_used_values(spark, d):
    used = spark.createDataFrame([("Brand#11",), ("Brand#12",)], "p_brand string")
    return table(spark, d, "part").select("p_brand").distinct().join(F.broadcast(used), "p_brand", "left_anti")


NAMES_SQL = "SELECT doc_id, regexp_extract(text, '[A-Za-zÀ-ÿ]*[À-ÿ][A-Za-zÀ-ÿ]*') AS name FROM documents"


def accented(spark, d):
    """The first word with an accent in each document; empty where there is none."""
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "[A-Za-zÀ-ÿ]*[À-ÿ][A-Za-zÀ-ÿ]*", 0).alias("name"))


@register("sort_locale", f"SELECT name, doc_id FROM ({NAMES_SQL}) ORDER BY coalesce(name, '') COLLATE de, doc_id")
def sort_locale(spark, d):
    """Names in the order of a German reader."""
    return rk.locale_sort(accented(spark, d), "name", "doc_id", locale="de").select("name", "doc_id")


@register("filter_locale", f"SELECT doc_id, name FROM ({NAMES_SQL}) WHERE lower(strip_accents(name)) = 'fur' OR starts_with(lower(strip_accents(name)), 're')")
def filter_locale(spark, d):
    """Names that equal or begin like a term, in any case and with any accent."""
    name = F.collate("name", rk.ANY_CASE_AND_ACCENT)
    return accented(spark, d).filter((name == "FUR") | F.startswith(name, F.collate(F.lit("Ré"), rk.ANY_CASE_AND_ACCENT))).select("doc_id", "name")


@register("rank_locale", f"""SELECT doc_id, name, CASE WHEN n = 'que' THEN 1 WHEN t = 'que' THEN 2 WHEN starts_with(n, 'que') THEN 3 WHEN starts_with(t, 'que') THEN 4 WHEN contains(n, '__que') THEN 5 WHEN contains(n, '_que') THEN 6 WHEN contains(t, ' que') THEN 7 ELSE 8 END AS tier
FROM (SELECT doc_id, name, lower(strip_accents(CASE WHEN doc_id % 3 = 0 THEN 'x_' || name ELSE name END)) AS n, lower(strip_accents('Der ' || name)) AS t FROM ({NAMES_SQL})) ORDER BY tier, replace(lower(strip_accents(name)), 'ß', 'ss'), name COLLATE de, doc_id""")
def rank_locale(spark, d):
    """Search tiers of accented names."""
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x_"), "name")).otherwise(F.col("name"))
    tier = rk.match_tier(value, F.concat(F.lit("Der "), "name"), "Qué", rk.ANY_CASE_AND_ACCENT)
    rows = accented(spark, d).select("doc_id", "name", tier.alias("tier"))
    return rows.orderBy("tier", F.collate("name", rk.ANY_CASE_AND_ACCENT), F.collate("name", "de"), "doc_id")


@register("agg_distinct_sketch", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS exact, true AS within FROM lineitem GROUP BY 1")
def agg_distinct_sketch(spark, d):
    """Distinct orders a year from sketches a day, held against the exact counts."""
    items, year = table(spark, d, "lineitem"), F.year
    sketched = sk.distinct_over(sk.daily_sketches(items, F.col("l_shipdate"), "l_orderkey"), year("day").alias("year"))
    exact = items.groupBy(year("l_shipdate").alias("year")).agg(F.count_distinct("l_orderkey").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= 3 * sk.ERROR * F.col("exact") + 1
    return exact.join(sketched, "year", "left").select("year", "exact", near.alias("within"))


MEMBERS_SQL = """
WITH v AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'note' ELSE 'info' END AS severity, coalesce(nullif(event_type, 'signup'), 'Unknown Rule') AS rule FROM events)
SELECT CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS INTEGER) AS place, severity, rule, count(*) OVER (PARTITION BY severity, rule) AS n, event_id FROM v ORDER BY place, rule, event_id
"""


@register("agg_severity_members", MEMBERS_SQL)
def agg_severity_members(spark, d):
    """Violations by severity, in its fixed order, and rule, with the size of their group; a row per member and no list in a cell."""
    level = F.when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "view", "note").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", tx.severity(level).alias("severity"), F.coalesce(F.nullif(F.col("event_type"), F.lit("signup")), F.lit("Unknown Rule")).alias("rule"))
    return rk.grouped_members(rows, "severity", ("error", "warning", "info", "note"), "rule", "event_id")
