"""Queries over the catalog: projections, filters, relationship paths, groupings, date literals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.catalog import CATALOG, ObjectQuery, polymorphic, run_plan, search
from opalgrid.functions import dates
from opalgrid.functions import text as tx
from opalgrid.plans.registry import register

ANCHOR = date(1998, 7, 15)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(col: str) -> F.Column:
    return F.round(F.sum(col), 2)


@register("scan_object", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_object(spark, d):
    return ObjectQuery(spark, d, "orders").frame.select("o_orderkey", "o_orderstatus")


@register("scan_query_all", "SELECT c_mktsegment, count(*) AS every, count(*) FILTER (WHERE c_acctbal >= 0) AS present FROM customer GROUP BY c_mktsegment")
def scan_query_all(spark, d):
    """Rows with the deleted ones, beside those that a plain query sees."""
    each = [ObjectQuery(spark, d, "customer", namespace="archive", all_rows=flag).frame.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")) for flag in (True, False)]
    every, present = each[0].withColumnRenamed("n", "every"), each[1].withColumnRenamed("n", "present")
    return every.join(present, "c_mktsegment", "left").select("c_mktsegment", "every", F.coalesce("present", F.lit(0)).alias("present"))


@register("scan_tooling", "SELECT 'Event log' AS label, event_type AS kind, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'Layout', p_type, count(*) FROM part GROUP BY p_type")
def scan_tooling(spark, d):
    """Objects of the tooling namespace, whose definitions are not those of the data of the same name."""
    out = []
    for name, kind in (("events", "event_type"), ("part", "p_type")):
        q = ObjectQuery(spark, d, name, namespace="tooling")
        out.append(q.frame.groupBy(F.lit(q.object.label).alias("label"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    return out[0].unionByName(out[1])


@register("scan_search", "SELECT 'customer' AS object, CAST(c_custkey AS VARCHAR) AS id, c_name || ' | ' || c_mktsegment AS text FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build') UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name || ' | ' || p_type FROM part WHERE contains(lower(p_name), 'build') OR contains(lower(p_type), 'build')")
def scan_search(spark, d):
    return search(spark, d, "BUILD", {"customer": ("c_custkey", "c_name", "c_mktsegment"), "part": ("p_partkey", "p_name", "p_type")})


@register("scan_graphql", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def scan_graphql(spark, d):
    """Unwraps edges, nodes and boxed values of a nested response."""
    node = F.struct(F.struct(F.col("n_nationkey").alias("value")).alias("id"), F.struct(F.col("n_name").alias("value")).alias("name"))
    reply = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    return reply.select(F.explode("edges").alias("e")).select(F.col("e.node.id.value").alias("id"), F.col("e.node.name.value").alias("name"))


@register("scan_paged", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def scan_paged(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@register("scan_parallel_offset", "SELECT CAST(floor((o_orderkey - 1) / 2000) AS BIGINT) AS page, count(*) AS n FROM orders GROUP BY 1")
def scan_parallel_offset(spark, d):
    return table(spark, d, "orders").groupBy(F.floor((F.col("o_orderkey") - 1) / 2000).alias("page")).agg(F.count(F.lit(1)).alias("n"))


@register("scan_in_batched", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scan_in_batched(spark, d):
    values = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(values, "o_custkey", "left_semi")


@register("scan_composite", "SELECT 'orders' AS reference_id, 200 AS status, count(*) AS n FROM orders UNION ALL SELECT 'customer', 200, count(*) FROM customer UNION ALL SELECT 'missing', 404, 0")
def scan_composite(spark, d):
    """Sub-queries with a status each; one that cannot be planned is a row of its own."""
    out = []
    for name in ("orders", "customer", "missing"):
        try:
            out.append(ObjectQuery(spark, d, name).frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reference_id"), F.lit(200).alias("status"), "n"))
        except LookupError:
            out.append(spark.range(1).select(F.lit(name).alias("reference_id"), F.lit(404).alias("status"), F.lit(0).cast("long").alias("n")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("scan_composite_ref", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY')")
def scan_composite_ref(spark, d):
    first = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").agg(F.min("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(F.broadcast(first), "o_custkey").select("o_orderkey", "o_totalprice")  # one row


@register("src_listview", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def src_listview(spark, d):
    """A stored view under a name."""
    view = table(spark, d, "customer").filter("c_acctbal > 5000")
    return spark.sql("SELECT c_custkey, c_name FROM {rich_customers}", rich_customers=view)


@register("soql_project", "SELECT c_name, c_acctbal FROM customer")
def soql_project(spark, d):
    return ObjectQuery(spark, d, "CUSTOMER").frame.select("C_NAME", "C_ACCTBAL").toDF("c_name", "c_acctbal")


@register("soql_fields_all", "SELECT * FROM nation LIMIT 200")
def soql_fields_all(spark, d):
    q = ObjectQuery(spark, d, "nation")
    return q.frame.select(*q.fields("ALL")).limit(200)


@register("soql_fields_standard", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def soql_fields_standard(spark, d):
    q = ObjectQuery(spark, d, "customer")
    return q.frame.select(*q.fields("STANDARD"))


@register("soql_fields_custom", "SELECT c_acctbal, c_mktsegment FROM customer")
def soql_fields_custom(spark, d):
    q = ObjectQuery(spark, d, "customer")
    return q.frame.select(*q.fields("CUSTOM"))


@register("soql_all_matching_fields", "SELECT p_partkey, p_retailprice FROM part")
def soql_all_matching_fields(spark, d):
    q = ObjectQuery(spark, d, "part")
    return q.frame.select("p_partkey", *q.matching("Price"))


PATH_SQL = "SELECT o.o_orderkey, n.n_name AS nation, r.r_name AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"


@register("soql_parent_path", PATH_SQL)
@register("join_parent_left", PATH_SQL)
def soql_parent_path(spark, d):
    q = ObjectQuery(spark, d, "orders")
    nation, region = q.cols("Customer.Nation.n_name", "Customer.Nation.Region.r_name")
    return q.frame.select("o_orderkey", nation.alias("nation"), region.alias("region"))


CHILD_SQL = "SELECT c_custkey, coalesce(n, 0) AS n, latest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 3 GROUP BY o_custkey) ON c_custkey = o_custkey"


@register("soql_child_subquery", CHILD_SQL)
@register("join_child_nest", CHILD_SQL)
def soql_child_subquery(spark, d):
    rows = ObjectQuery(spark, d, "customer").children("Orders", ["o_orderkey", "o_totalprice"], [F.col("o_orderkey").desc()], 3)
    n = F.when(F.col("Orders").isNull(), 0).otherwise(F.size("Orders")).cast("long")
    return rows.select("c_custkey", n.alias("n"), F.array_max("Orders")["o_orderkey"].alias("latest"))


@register("soql_count_all", "SELECT count(*) AS total_size FROM lineitem")
def soql_count_all(spark, d):
    return ObjectQuery(spark, d, "lineitem").frame.agg(F.count(F.lit(1)).alias("total_size"))


@register("soql_cmp", "SELECT count(*) FILTER (WHERE s IS NULL) AS is_null, count(*) FILTER (WHERE s IS NOT NULL) AS not_null, count(*) FILTER (WHERE s <> 'O') AS not_o, count(*) FILTER (WHERE p >= 100000) AS large FROM (SELECT nullif(o_orderstatus, 'P') AS s, o_totalprice AS p FROM orders)")
def soql_cmp(spark, d):
    """``= null`` and ``!= null`` test for null; other comparisons keep three-valued logic."""
    rows = table(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"), F.col("o_totalprice").alias("p"))
    tests = {"is_null": F.col("s").isNull(), "not_null": F.col("s").isNotNull(), "not_o": F.col("s") != "O", "large": F.col("p") >= 100000}
    return rows.agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


@register("soql_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')")
def soql_in(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21")).select("p_partkey", "p_brand")


SEMI_SQL = "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"


@register("soql_in_subquery", SEMI_SQL)
@register("join_semi_in", SEMI_SQL)
def soql_in_subquery(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@register("soql_like", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%econ%'")
def soql_like(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").ilike("%Econ%")).select("p_partkey", "p_type")


@register("soql_not_like", "SELECT event_id FROM events WHERE NOT event_type ILIKE 'c%'")
def soql_not_like(spark, d):
    return table(spark, d, "events").filter(~F.col("event_type").ilike("c%")).select("event_id")


@register("soql_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 5000)")
def soql_and_or(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, d, "orders").filter(((s == "F") & (p > 200000)) | ((s == "O") & (p < 5000))).select("o_orderkey")


@register("soql_bool_lit", "SELECT count(*) FILTER (WHERE err) AS yes, count(*) FILTER (WHERE NOT err) AS no FROM (SELECT event_type = 'error' AS err FROM events)")
def soql_bool_lit(spark, d):
    err = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count_if(err == F.lit("TRUE").cast("boolean")).alias("yes"), F.count_if(err == F.lit("false").cast("boolean")).alias("no"))


LITERALS = (
    "TODAY", "LAST_WEEK", "THIS_WEEK", "NEXT_WEEK", "LAST_MONTH", "THIS_MONTH", "NEXT_MONTH", "LAST_90_DAYS", "NEXT_90_DAYS", "LAST_N_DAYS:30",
    "N_DAYS_AGO:7", "LAST_N_WEEKS:4", "N_WEEKS_AGO:2", "LAST_N_MONTHS:5", "N_MONTHS_AGO:3", "THIS_QUARTER", "LAST_QUARTER", "NEXT_N_QUARTERS:2",
    "N_QUARTERS_AGO:3", "THIS_YEAR", "LAST_YEAR", "NEXT_YEAR", "LAST_N_YEARS:3", "N_YEARS_AGO:2", "THIS_FISCAL_QUARTER", "LAST_FISCAL_YEAR", "N_FISCAL_QUARTERS_AGO:1",
    "YESTERDAY", "TOMORROW", "NEXT_N_DAYS:10", "NEXT_N_WEEKS:3", "NEXT_N_MONTHS:2", "NEXT_QUARTER", "LAST_N_QUARTERS:3", "NEXT_N_YEARS:2", "LAST_FISCAL_QUARTER",
    "NEXT_FISCAL_QUARTER", "NEXT_N_FISCAL_QUARTERS:3", "LAST_N_FISCAL_QUARTERS:2", "THIS_FISCAL_YEAR", "NEXT_FISCAL_YEAR", "NEXT_N_FISCAL_YEARS:2", "LAST_N_FISCAL_YEARS:2", "N_FISCAL_YEARS_AGO:2",
)
#: The ranges written out, against the anchor 1998-07-15 (a Wednesday; weeks start on Sunday, fiscal years in April).
RANGES = (
    ("1998-07-15", "1998-07-16"), ("1998-07-05", "1998-07-12"), ("1998-07-12", "1998-07-19"), ("1998-07-19", "1998-07-26"),
    ("1998-06-01", "1998-07-01"), ("1998-07-01", "1998-08-01"), ("1998-08-01", "1998-09-01"), ("1998-04-16", "1998-07-16"),
    ("1998-07-16", "1998-10-14"), ("1998-06-15", "1998-07-16"), ("1998-07-08", "1998-07-09"), ("1998-06-14", "1998-07-12"),
    ("1998-06-28", "1998-07-05"), ("1998-02-01", "1998-07-01"), ("1998-04-01", "1998-05-01"), ("1998-07-01", "1998-10-01"),
    ("1998-04-01", "1998-07-01"), ("1998-10-01", "1999-04-01"), ("1997-10-01", "1998-01-01"), ("1998-01-01", "1999-01-01"),
    ("1997-01-01", "1998-01-01"), ("1999-01-01", "2000-01-01"), ("1995-01-01", "1998-01-01"), ("1996-01-01", "1997-01-01"),
    ("1998-07-01", "1998-10-01"), ("1997-04-01", "1998-04-01"), ("1998-04-01", "1998-07-01"),
    ("1998-07-14", "1998-07-15"), ("1998-07-16", "1998-07-17"), ("1998-07-16", "1998-07-26"), ("1998-07-19", "1998-08-09"),
    ("1998-08-01", "1998-10-01"), ("1998-10-01", "1999-01-01"), ("1997-10-01", "1998-07-01"), ("1999-01-01", "2001-01-01"),
    ("1998-04-01", "1998-07-01"), ("1998-10-01", "1999-01-01"), ("1998-10-01", "1999-07-01"), ("1998-01-01", "1998-07-01"),
    ("1998-04-01", "1999-04-01"), ("1999-04-01", "2000-04-01"), ("1999-04-01", "2001-04-01"), ("1996-04-01", "1998-04-01"), ("1996-04-01", "1997-04-01"),
)


@register("soql_date_lit", " UNION ALL ".join(f"SELECT '{n}' AS literal, count(*) AS n FROM orders WHERE o_orderdate >= '{a}' AND o_orderdate < '{b}'" for n, (a, b) in zip(LITERALS, RANGES, strict=True)))
def soql_date_lit(spark, d):
    """All literals in one scan: each is a counted range predicate."""
    col = F.col("o_orderdate")
    counts = [F.count_if(dates.date_predicate(col, "=", x, ANCHOR, fiscal_start=4)).alias(x) for x in LITERALS]
    return table(spark, d, "orders").agg(*counts).unpivot([], [F.col(f"`{x}`") for x in LITERALS], "literal", "n")


@register("soql_date_lit_ops", "SELECT count(*) FILTER (WHERE o_orderdate < '1998-06-01') AS lt, count(*) FILTER (WHERE o_orderdate < '1998-07-01') AS le, count(*) FILTER (WHERE o_orderdate >= '1998-07-01') AS gt, count(*) FILTER (WHERE o_orderdate >= '1998-06-01') AS ge, count(*) FILTER (WHERE o_orderdate < '1998-06-01' OR o_orderdate >= '1998-07-01') AS ne FROM orders")
def soql_date_lit_ops(spark, d):
    ops = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "ne": "!="}
    return table(spark, d, "orders").agg(*[F.count_if(dates.date_predicate(F.col("o_orderdate"), op, "LAST_MONTH", ANCHOR)).alias(k) for k, op in ops.items()])


@register("soql_dt_lit", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-02-01'")
def soql_dt_lit(spark, d):
    lo, hi = F.lit("1996-01-01T00:00:00").cast("timestamp_ntz"), F.lit("1996-02-01").cast("timestamp_ntz")
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).select("o_orderkey")


@register("soql_order_by", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) ORDER BY s ASC NULLS FIRST, o_orderkey DESC")
def soql_order_by(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"))
    return rows.orderBy(F.col("s").asc_nulls_first(), F.col("o_orderkey").desc())


@register("soql_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def soql_limit(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").limit(25)


@register("soql_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")
def soql_offset(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").offset(30).limit(10)


@register("soql_group_by", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY 1 LIMIT 100")
def soql_group_by(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(100)


@register("soql_agg_result", "SELECT o_orderstatus, count(o_orderkey) AS expr0, max(o_totalprice) AS expr1 FROM orders GROUP BY o_orderstatus")
def soql_agg_result(spark, d):
    """Aggregates without an alias are named by their place."""
    aggs = [F.count("o_orderkey"), F.max("o_totalprice")]
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(*[a.alias(f"expr{i}") for i, a in enumerate(aggs)])


@register("soql_user_mode", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10")
def soql_user_mode(spark, d):
    """A policy of visible rows and columns in front of a query."""
    visible, allowed = F.col("c_nationkey") < 10, ("c_custkey", "c_name", "c_mktsegment")
    asked = ("c_custkey", "c_name", "c_acctbal")
    return table(spark, d, "customer").filter(visible).select(*[c for c in asked if c in allowed])


@register("soql_distinct_values", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand ILIKE '%#1%' ORDER BY 1 LIMIT 100")
def soql_distinct_values(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").ilike("%#1%")).select(F.col("p_brand").alias("value")).distinct().orderBy("value").limit(100)


@register("soql_query_builder", "SELECT event_id FROM events WHERE event_type = 'error' AND ts >= '2024-01-10'")
def soql_query_builder(spark, d):
    """Filters that are set are chained; the others add nothing."""
    wanted = {"event_type": "error", "user_id": None, "since": "2024-01-10"}
    rows = table(spark, d, "events")
    for name in ("event_type", "user_id"):
        if wanted[name] is not None:
            rows = rows.filter(F.col(name) == wanted[name])
    return rows.filter(F.col("ts") >= F.lit(wanted["since"]).cast("timestamp_ntz")).select("event_id")


@register("soql_plan_sanitize", "SELECT 'orders' AS object, o_orderkey AS key, o_orderpriority AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'part', p_partkey, p_brand FROM part")
def soql_plan_sanitize(spark, d):
    """A declarative plan: unknown objects and fields are dropped, and what is beyond the bound of queries."""
    plan = [
        {"object": "orders", "fields": ["o_orderkey", "nothing", "o_orderpriority"], "where": {"o_orderstatus": "O"}}, {"object": "secret"},
        {"object": "part", "fields": ["p_partkey", "p_brand"], "where": {"no_field": 1}}, {"object": "region", "fields": ["r_regionkey", "r_name"]},
    ]
    out = None
    for name, rows in run_plan(spark, d, plan, most=2):
        rows = rows.toDF("key", "value").select(F.lit(name).alias("object"), F.col("key").cast("long").alias("key"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("soql_explain")
def soql_explain(spark, d):
    """The physical plan as rows of numbered lines."""
    rows = spark.sql(f"EXPLAIN SELECT o_orderpriority, count(*) FROM parquet.`{d}/orders.parquet` WHERE o_orderstatus = 'F' GROUP BY 1")
    return rows.select(F.posexplode(F.split("plan", "\n")).alias("line", "text")).filter("length(text) > 0")


@register("soql_saved_name", "SELECT CASE WHEN contains(lower(q), ':select') OR contains(lower(q), ':find') THEN substr(q, 1, strpos(q, ':') - 1) ELSE '' END AS name, CASE WHEN contains(lower(q), ':select') OR contains(lower(q), ':find') THEN substr(q, strpos(q, ':') + 1) ELSE q END AS query FROM (SELECT 'q' || c_custkey || ':select c_name from customer' AS q FROM customer UNION ALL SELECT 'select 1')")
def soql_saved_name(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.lit("q"), "c_custkey", F.lit(":select c_name from customer")).alias("q"))
    rows = rows.unionByName(spark.range(1).select(F.lit("select 1").alias("q")))
    named = F.lower("q").rlike(":(select|find)")
    return rows.select(F.when(named, F.substring_index("q", ":", 1)).otherwise("").alias("name"), F.when(named, F.regexp_replace("q", "^[^:]*:", "")).otherwise(F.col("q")).alias("query"))


@register("soql_typo_fix", "SELECT 'select a, b from t' || n_nationkey || ' where x = ''two  blanks,, kept, from here'' and y = 1' AS query FROM nation")
def soql_typo_fix(spark, d):
    """Repeated commas, a comma before FROM and runs of blanks are mended outside string literals."""
    q = F.concat(F.lit("  select  a,, b, from  t"), "n_nationkey", F.lit("\n where x = 'two  blanks,, kept, from here'  and y = 1 "))
    return table(spark, d, "nation").select(tx.mend_typos(q).alias("query"))


@register("soql_escape", r"SELECT replace(replace(p_name || '''\', '\', '\\'), '''', '\''') AS escaped FROM part")
def soql_escape(spark, d):
    raw = F.concat("p_name", F.lit("'\\"))
    return table(spark, d, "part").select(F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")).alias("escaped"))


#: The starter queries offered to a new user.
TEMPLATES = (
    "SELECT Id FROM ",
    'FIND {""}\nIN Name Fields\nRETURNING Contact(Name, Phone)',
    "{\n\tuiapi {\n\t\tquery {\n\t\t\tContact {\n\t\t\t\tedges {\n\t\t\t\t\t node {\n\t\t\t\t\t\tId\n\t\t\t\t\t\tName { value }\n\t\t\t\t\t}\n\t\t\t\t}\n\t\t\t}\n\t\t}\n\t}\n}",
    "SELECT Id FROM WHERE",
    "SELECT Id FROM WHERE IN",
    "SELECT Id FROM WHERE LIKE",
    "SELECT Id FROM WHERE ORDER BY",
)
TEMPLATES_SQL = r"""
SELECT CAST(place - 1 AS INTEGER) AS place, template, (SELECT count(*) FROM customer WHERE c_custkey % 9 = place - 1) AS saved FROM (SELECT unnest(t) AS template, generate_subscripts(t, 1) AS place FROM (SELECT [
  'SELECT Id FROM ', E'FIND {""}\nIN Name Fields\nRETURNING Contact(Name, Phone)',
  E'{\n\tuiapi {\n\t\tquery {\n\t\t\tContact {\n\t\t\t\tedges {\n\t\t\t\t\t node {\n\t\t\t\t\t\tId\n\t\t\t\t\t\tName { value }\n\t\t\t\t\t}\n\t\t\t\t}\n\t\t\t}\n\t\t}\n\t}\n}',
  'SELECT Id FROM WHERE', 'SELECT Id FROM WHERE IN', 'SELECT Id FROM WHERE LIKE', 'SELECT Id FROM WHERE ORDER BY'] AS t))
"""


@register("soql_templates", TEMPLATES_SQL)
def soql_templates(spark, d):
    """The starter queries in their order, and how many saved queries are one of them as it was."""
    starters = spark.range(1).select(F.posexplode(F.split(F.lit("//".join(TEMPLATES)), "//")).alias("place", "template"))
    saved = F.coalesce(F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("c_custkey") % 9).cast("int")), F.concat(F.lit("select "), "c_name"))
    used = table(spark, d, "customer").groupBy(saved.alias("template")).agg(F.count(F.lit(1)).alias("saved"))
    return starters.join(used, "template", "left").select("place", "template", F.coalesce("saved", F.lit(0)).alias("saved"))


@register("join_polymorphic", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN c_name ELSE s_name END AS who FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey")
def join_polymorphic(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, "customer").otherwise("supplier").alias("kind"))
    targets = {"customer": (table(spark, d, "customer"), "c_custkey", "c_name"), "supplier": (table(spark, d, "supplier"), "s_suppkey", "s_name")}
    return polymorphic(rows, "user_id", "kind", targets, "who").select("event_id", "who")


@register("agg_sum_avg_min_max_count", "SELECT l_returnflag, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_basic(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q), 2).alias("s"), F.round(F.avg(q), 6).alias("a"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.count(F.lit(1)).alias("n"))


@register("agg_count_distinct", "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_linestatus")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_distinct("l_partkey").alias("parts"))


@register("agg_grouping", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
def agg_grouping(spark, d):
    rows = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"))


@register("agg_rollup_having", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority) HAVING count(*) > 10")
def agg_rollup_having(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")


@register("soql_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def soql_not_in(spark, d):
    return table(spark, d, "orders").filter(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@register("agg_date_group", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def agg_date_group(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(money("o_totalprice").alias("total"))


@register("fn_calendar", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS calendar_month, CAST(quarter(o_orderdate) AS BIGINT) AS calendar_quarter, CAST(year(o_orderdate) AS BIGINT) AS calendar_year, CAST(day(o_orderdate) AS BIGINT) AS day_in_month, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS day_in_week, CAST(dayofyear(o_orderdate) AS BIGINT) AS day_in_year, CAST(hour(o_orderdate) AS BIGINT) AS hour_in_day, CAST(ceil(day(o_orderdate) / 7.0) AS BIGINT) AS week_in_month, CAST(ceil(dayofyear(o_orderdate) / 7.0) AS BIGINT) AS week_in_year, strftime(o_orderdate, '%Y-%m-%d') AS day_only FROM orders")
def fn_calendar(spark, d):
    c = F.col("o_orderdate")
    cols = {
        "calendar_month": F.month(c), "calendar_quarter": F.quarter(c), "calendar_year": F.year(c), "day_in_month": F.dayofmonth(c), "day_in_week": F.dayofweek(c),
        "day_in_year": F.dayofyear(c), "hour_in_day": F.hour(c), "week_in_month": dates.week_in_month(c), "week_in_year": dates.week_in_year(c),
    }
    return table(spark, d, "orders").select("o_orderkey", *[x.cast("long").alias(k) for k, x in cols.items()], F.to_date(c).cast("string").alias("day_only"))


@register("fn_fiscal", "SELECT o_orderkey, CAST(month(o_orderdate - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_month, CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS BIGINT) AS fiscal_quarter, CAST(year(o_orderdate + INTERVAL 9 MONTH) AS BIGINT) AS fiscal_year FROM orders")
def fn_fiscal(spark, d):
    c = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.fiscal_month(c, 4).cast("long").alias("fiscal_month"), dates.fiscal_quarter(c, 4).cast("long").alias("fiscal_quarter"), dates.fiscal_year(c, 4).cast("long").alias("fiscal_year"))


@register("fn_to_label", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders")
def fn_to_label(spark, d):
    labels = F.create_map(F.lit("F"), F.lit("Fulfilled"), F.lit("O"), F.lit("Open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(labels[F.col("o_orderstatus")], "o_orderstatus").alias("label"))


@register("fn_convert_timezone", "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def fn_convert_timezone(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("+02:00"), F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("local"))


@register("fn_convert_currency", "SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 4.0 ELSE 2.0 END, 2) AS amount FROM orders")
def fn_convert_currency(spark, d):
    rates = spark.createDataFrame([("EUR", 4.0), ("USD", 2.0)], "currency string, rate double")
    rows = table(spark, d, "orders").withColumn("currency", F.when(F.col("o_orderkey") % 2 == 0, "EUR").otherwise("USD"))
    return rows.join(F.broadcast(rates), "currency").select("o_orderkey", F.round(F.col("o_totalprice") * F.col("rate"), 2).alias("amount"))


@register("flagship", "SELECT o.o_orderstatus, count(o.o_orderkey) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' AND o.o_orderdate >= '1995-01-01' AND o.o_orderdate < '1998-01-01' GROUP BY 1")
def flagship(spark, d):
    """Orders of three years by customers of one region: a path of three relationships and a relative date."""
    q = ObjectQuery(spark, d, "orders", CATALOG)
    region = q.col("Customer.Nation.Region.r_name")
    rows = q.frame.filter((region == "ASIA") & dates.date_predicate(F.col("o_orderdate"), "=", "LAST_N_YEARS:3", ANCHOR))
    return rows.groupBy("o_orderstatus").agg(F.count("o_orderkey").alias("n"), money("o_totalprice").alias("total"))
