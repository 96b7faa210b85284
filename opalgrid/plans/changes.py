"""Queries of keyed merges and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opalgrid.catalog import CATALOG
from opalgrid.operators import imports as im
from opalgrid.operators import merges as mg
from opalgrid.operators import ranking as rk
from opalgrid.plans.dialect import table
from opalgrid.plans.measures import VERSIONS, versions
from opalgrid.plans.registry import register


def customers(spark, d, where: str):
    return table(spark, d, "customer").filter(where)


@register("join_full_merge_fields", "SELECT c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS label, c_custkey % 2 = 0 AS described FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def join_full_merge_fields(spark, d):
    described = customers(spark, d, "c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("label"), F.lit(True).alias("described"))
    particles = customers(spark, d, "c_custkey % 3 = 0").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("label"))
    out = mg.full_merge(described, particles, "name", {"label": "left", "described": "left"})
    return out.withColumn("described", F.coalesce("described", F.lit(False)))


@register("join_full_merge_children", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def join_full_merge_children(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    b = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return mg.full_merge(a, b, "o_orderkey", {"label": "right"})


@register("join_catalog_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name END AS label, c_custkey % 3 = 0 AS layoutable, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN '0' END, CASE WHEN c_custkey % 3 = 0 THEN '1' END, CASE WHEN c_custkey % 5 = 0 THEN '2' END) AS apis FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def join_catalog_merge(spark, d):
    a = customers(spark, d, "c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("label"))
    b = customers(spark, d, "c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("label"), F.lit(True).alias("layoutable"))
    c = customers(spark, d, "c_custkey % 5 = 0").select("c_custkey", F.lit("").alias("label"))
    return mg.merge_sources([a, b, c], "c_custkey", ["label"], ["layoutable"]).select("c_custkey", "label", "layoutable", F.array_join("sources", ",").alias("apis"))


@register("join_catalog_override", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'Standard' ELSE 'Custom' END AS type FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def join_catalog_override(spark, d):
    a = customers(spark, d, "c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("label"), F.lit("Standard").alias("type"))
    b = customers(spark, d, "c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("label"))
    return mg.full_merge(a, b, "c_custkey", {"label": "right", "type": "left"}).withColumn("type", F.coalesce("type", F.lit("Custom")))


PREFIXES = "CASE o_orderkey % 3 WHEN 0 THEN '001' WHEN 1 THEN '006' ELSE 'zzz' END"


@register("join_lookup_prefix", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' END AS object FROM orders")
@register("dml_object_detect", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'orders' END AS object FROM orders")
def join_lookup_prefix(spark, d):
    prefix = F.element_at(F.array(F.lit("001"), F.lit("006"), F.lit("zzz")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(prefix, F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"))
    names = CATALOG.rows(spark).filter("namespace = 'data'").select("key_prefix", F.col("name").alias("object"))
    return rows.join(F.broadcast(names), F.substring("id", 1, 3) == F.col("key_prefix"), "left").select("o_orderkey", "object")  # the catalog is fixed


@register("join_short_id", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_short_id(spark, d):
    long = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lpad(F.col("l_orderkey").cast("string"), 15, "0"), F.lit("AAA")).alias("id18"))
    short = table(spark, d, "orders").select("o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 15, "0").alias("id15"))
    return long.join(short, F.substring("id18", 1, 15) == F.col("id15")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@register("join_enrich_two_hop", "SELECT o_orderkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR), '?') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def join_enrich_two_hop(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").filter("n_nationkey < 20")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n_name", F.col("c_nationkey").cast("string"), F.lit("?")).alias("nation"))


@register("join_id_to_name", "SELECT event_id, coalesce(c_name, CAST(user_id AS VARCHAR)) AS who FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 2 = 0")
def join_id_to_name(spark, d):
    names = customers(spark, d, "c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, d, "events").join(names, "user_id", "left").select("event_id", F.coalesce("c_name", F.col("user_id").cast("string")).alias("who"))


TREE = "SELECT p.n_name AS parent, count(c.c_custkey) AS children FROM nation p LEFT JOIN customer c ON c.c_nationkey = p.n_nationkey GROUP BY 1"


@register("join_self_tree", TREE)
@register("graph_tree_children", TREE)
def join_self_tree(spark, d):
    kids = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("kids"))
    rows = table(spark, d, "nation").join(kids, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(F.col("n_name").alias("parent"), F.coalesce("kids", F.lit(0)).alias("children"))


MERGED = """
SELECT p_type AS name, CASE WHEN numeric THEN CASE WHEN p_type LIKE 'PROMO%' THEN '25' ELSE CAST(most AS VARCHAR) END WHEN p_type LIKE '%TIN' THEN '[A-Z' ELSE p_type END AS config
FROM (SELECT p_type, max(p_size) AS most, length(p_type) % 2 = 0 AS numeric FROM part GROUP BY p_type)
"""


@register("join_rule_overrides", MERGED.replace("'[A-Z'", "'[A-Za-z0-9]+'"))
@register("rule_config_merge", MERGED.replace("'[A-Z'", "'[A-Za-z0-9]+'"))
def join_rule_overrides(spark, d):
    """A stored setting replaces the known default where it is valid for its rule: a number, or a pattern with closed brackets."""
    part = table(spark, d, "part")
    numeric = F.length("p_type") % 2 == 0
    known = part.select("p_type").distinct().select(F.col("p_type").alias("name"), numeric.alias("numeric"), F.when(numeric, "25").otherwise("[A-Za-z0-9]+").alias("known"))
    setting = F.when(numeric & F.col("p_type").startswith("PROMO"), "oops").when(numeric, F.max("p_size").cast("string")).when(F.col("p_type").endswith("TIN"), "[A-Z").otherwise(F.col("p_type"))
    stored = part.groupBy("p_type").agg(setting.alias("stored")).withColumnRenamed("p_type", "name")
    closed = F.length(F.regexp_replace("stored", r"[^\[]", "")) == F.length(F.regexp_replace("stored", r"[^\]]", ""))
    valid = F.when(F.col("numeric"), F.col("stored").try_cast("double").isNotNull()).otherwise(closed)
    return known.join(stored, "name", "left").select("name", F.coalesce(F.when(valid, F.col("stored")), "known").alias("config"))


@register("join_positional", "SELECT a.c_custkey, b.s_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) a JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) b USING (k)")
def join_positional(spark, d):
    """Batch rows and results by place: batches of 200 by a distributed ordinal, joined on batch and place."""

    def placed(name, key):
        at = F.col("ordinal")
        return rk.ordinals(table(spark, d, name), key).withColumn("batch", F.floor(at / 200)).withColumn("place", at % 200)

    a = placed("customer", "c_custkey").select("batch", "place", "c_custkey")
    b = placed("supplier", "s_suppkey").select("batch", "place", "s_name")
    return a.join(b, ["batch", "place"]).select("c_custkey", "s_name")


@register("join_ref_id", "SELECT 'q' || n_nationkey AS reference_id, count(c_custkey) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def join_ref_id(spark, d):
    asked = table(spark, d, "nation").select(F.concat(F.lit("q"), F.col("n_nationkey").cast("string")).alias("reference_id"))
    replies = table(spark, d, "customer").groupBy(F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("reference_id")).agg(F.count(F.lit(1)).alias("total"))
    return asked.join(replies, "reference_id", "left").select("reference_id", F.coalesce("total", F.lit(0)).alias("total"))


@register("dml_status_tag", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Succeeded' WHEN 'O' THEN 'Queued' ELSE 'Failed' END AS status FROM orders")
def dml_status_tag(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderkey") % 2 == 0, "processing").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", mg.status_of(F.when(F.col("o_orderstatus") == "P", "x").otherwise(raw)).alias("status"))


@register("dml_batching", "SELECT c_custkey, CASE WHEN k > 150 THEN 'Queued' WHEN k <= 60 THEN 'Succeeded' ELSE 'Failed' END AS status FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer)")
def dml_batching(spark, d):
    rows = table(spark, d, "customer").select("c_custkey")
    return mg.import_batches(rows, "c_custkey", 30, F.col("c_custkey") > 60).select("c_custkey", "status")


def small(spark, d):
    return customers(spark, d, "c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment")


def changes(spark, d):
    return customers(spark, d, "c_custkey % 3 = 0").select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), F.lit("new").alias("c_name"))


@register("dml_create", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def dml_create(spark, d):
    new = changes(spark, d).select((-F.col("c_custkey")).alias("c_custkey"), "c_name")
    return small(spark, d).select("c_custkey", "c_name").unionByName(new)


@register("dml_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0")
def dml_update(spark, d):
    return mg.upsert(small(spark, d).select("c_custkey", "c_name"), changes(spark, d).select("c_custkey", "c_name"), "c_custkey", insert=False)


@register("dml_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def dml_upsert(spark, d):
    return mg.upsert(small(spark, d).select("c_custkey", "c_name"), changes(spark, d).select("c_custkey", "c_name"), "c_custkey")


@register("dml_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def dml_delete(spark, d):
    return small(spark, d).join(changes(spark, d).select("c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@register("dml_undelete", "SELECT c_custkey, c_custkey % 5 = 0 AND c_custkey % 3 <> 0 AS is_deleted FROM customer")
def dml_undelete(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5 == 0).alias("is_deleted"))
    back = changes(spark, d).select("c_custkey", F.lit(True).alias("_back"))
    return rows.join(back, "c_custkey", "left").select("c_custkey", (F.col("is_deleted") & F.col("_back").isNull()).alias("is_deleted"))


@register("dml_fields_to_null", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def dml_fields_to_null(spark, d):
    blank = customers(spark, d, "c_custkey % 3 = 0").select("c_custkey", F.lit("  ").alias("c_mktsegment"))
    return mg.upsert(small(spark, d).select("c_custkey", "c_mktsegment"), blank, "c_custkey", insert=False)


@register("dml_ext_id_ref", "SELECT o_orderkey, c_custkey AS parent FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def dml_ext_id_ref(spark, d):
    """A column that names the parent by an external field is looked up to its key."""
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_name").alias("ext"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("ext"))
    rows = table(spark, d, "orders").join(names, "o_custkey").select("o_orderkey", "ext")
    return rows.join(parents, "ext", "left").select("o_orderkey", "parent")


HEADERS_SQL = """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Owner' END, CASE WHEN o_orderkey % 7 = 0 THEN 'CustomerId' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Buyer__c' END) AS nulls,
       CASE WHEN o_orderkey % 7 > 0 THEN CAST(a.c_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS VARCHAR) END AS buyer, CAST(n_nationkey AS VARCHAR) AS nation,
       CASE WHEN n_nationkey IS NULL THEN 'Nation:nation:n_name=Nowhere' ELSE '' END AS unresolved
FROM orders LEFT JOIN customer AS a ON o_custkey = a.c_custkey LEFT JOIN nation ON o_orderkey % 26 = n_nationkey
"""


@register("dml_reference_headers", HEADERS_SQL)
def dml_reference_headers(spark, d):
    """An import of all orders whose header names parents in three ways."""
    k, nations = F.col("o_orderkey"), table(spark, d, "nation")
    names = nations.select((F.col("n_nationkey")).alias("_nation"), "n_name")
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("_name"))
    rows = table(spark, d, "orders").join(named, "o_custkey", "left").join(names, k % 26 == F.col("_nation"), "left").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 11 == 0, "").otherwise("x").alias("Owner.Name"),
        F.when(k % 7 == 0, "  ").otherwise(F.col("_name")).alias("Customer:customer:c_name"), F.when(k % 5 == 0, None).otherwise(F.col("o_custkey").cast("string")).alias("Buyer__r:customer:c_custkey"),
        F.coalesce("n_name", F.lit("Nowhere")).alias("Nation:nation:n_name"), F.lit("note").alias("_status"),
    )
    out = im.resolve_references(rows, "o_orderkey", {"customer": table(spark, d, "customer"), "nation": nations}, {"customer": "c_custkey", "nation": "n_nationkey"})
    return out.select("o_orderkey", F.array_join("nulls", ",").alias("nulls"), F.col("CustomerId").alias("customer"), F.col("Buyer__c").alias("buyer"), F.col("NationId").alias("nation"), F.array_join("unresolved", ",").alias("unresolved"))


@register("dml_result_map", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Failed' ELSE 'Succeeded' END AS status, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderkey % 2 = 0 THEN 'Inserted' ELSE 'Updated' END AS action, CASE WHEN o_orderstatus = 'P' THEN 'E1: locked [o_orderstatus]' ELSE '' END AS errors FROM orders")
def dml_result_map(spark, d):
    ok = F.col("o_orderstatus") != "P"
    action = F.when(~ok, "").when(F.col("o_orderkey") % 2 == 0, "Inserted").otherwise("Updated")
    return table(spark, d, "orders").select("o_orderkey", F.when(ok, "Succeeded").otherwise("Failed").alias("status"), action.alias("action"), F.when(ok, "").otherwise("E1: locked [o_orderstatus]").alias("errors"))


@register("dml_retry_failed", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Succeeded' ELSE 'Queued' END AS status FROM orders")
def dml_retry_failed(spark, d):
    return dml_status_tag(spark, d).select("o_orderkey", F.when(F.col("status") == "Failed", "Queued").otherwise(F.col("status")).alias("status"))


OPTIONS_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CASE c_custkey % 2 WHEN 0 THEN 'update' ELSE 'up sert' END END AS action, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS object, c_custkey % 3 > 0 AS has_options FROM customer"


@register("dml_options_header", OPTIONS_SQL)
def dml_options_header(spark, d):
    """The options in the first row of each text, where it holds some."""
    k = F.col("c_custkey")
    options = F.concat(F.lit("import-options=1&action=x&action="), F.when(k % 2 == 0, "update").otherwise("up+sert"), F.lit("&object="), "c_mktsegment")
    text = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(options, F.lit("\n"))), F.lit("Id,Name\n1,x"))
    m = mg.header_options(text, "import-options")
    return table(spark, d, "customer").select("c_custkey", m["action"].alias("action"), m["object"].alias("object"), m.isNotNull().alias("has_options"))


VALIDATE_SQL = (
    "SELECT n_nationkey, unnest(CASE n_nationkey % 5 WHEN 0 THEN ['Na*me: Invalid field name', 'c_custkey: Required field'] WHEN 1 THEN ['c_nothing: Unknown field'] "
    "WHEN 2 THEN ['batch size: Must be positive'] WHEN 3 THEN ['threads: More than 6 may be slower'] ELSE ['c_custkey: Required field'] END) AS problem FROM nation"
)


@register("dml_validate", VALIDATE_SQL)
def dml_validate(spark, d):
    """What is wrong with the header and settings of each import."""
    k = F.col("n_nationkey") % 5
    header = F.get(F.array(*map(F.lit, ("c_name,Na*me", "C_CUSTKEY,c_nothing", "c_custkey,_note", "c_custkey", "c_name"))), k)
    known = [f.name for f in table(spark, d, "customer").schema]
    problems = mg.import_problems(F.split(header, ","), known, ["c_custkey"], F.when(k == 2, 0).otherwise(200), F.when(k == 3, 7).otherwise(6))
    return table(spark, d, "nation").select("n_nationkey", F.explode(problems).alias("problem"))


@register("dml_bulk_delete", "SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 200 AS BIGINT) AS chunk FROM events WHERE event_type = 'view'")
def dml_bulk_delete(spark, d):
    return rk.batches(table(spark, d, "events").filter("event_type = 'view'").select("event_id", "event_type"), "event_id", 200, ["event_type"]).select("event_id", F.col("batch").alias("chunk"))


@register("dml_purge_versions", f"WITH v AS (SELECT *, version > (max(version) OVER (PARTITION BY o_custkey)) - 3 OR version = 2 AS keep FROM ({VERSIONS})) SELECT l_orderkey, count(*) AS children FROM lineitem JOIN v ON l_orderkey = o_orderkey WHERE NOT keep GROUP BY 1")
def dml_purge_versions(spark, d):
    gone = rk.keep_latest(versions(spark, d), "o_custkey", "version", "active", 2).filter("NOT keep").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("children"))


@register("dml_patch_diff", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c_name' ELSE '' END AS edited FROM customer")
def dml_patch_diff(spark, d):
    """The names of the fields whose value an edit changes."""
    rows = table(spark, d, "customer").withColumn("new", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_name")))
    changed = [F.when(~F.col("c_name").eqNullSafe(F.col("new")), F.lit("c_name"))]
    return rows.select("c_custkey", F.concat_ws(",", *changed).alias("edited"))


EDITS_SQL = """
SELECT c_custkey, c_custkey % 2 = 0 AS created, concat_ws(',', CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'c_name=' || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_name END END,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 > 0 THEN 'c_mktsegment=' || c_mktsegment END WHEN c_custkey % 5 = 0 THEN 'c_mktsegment=null' END) AS sent FROM customer
"""


@register("dml_patch_values", EDITS_SQL)
def dml_patch_values(spark, d):
    """What saving sends for records that are changed and for copies that are created."""
    k, fields = F.col("c_custkey"), ("c_name", "c_mktsegment")
    new = F.struct(F.when(k % 3 == 0, "x").otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", F.struct(*fields).alias("old"), new.alias("new"))
    created = F.col("c_custkey") % 2 == 0
    sent = F.when(created, im.edits(fields, "old", "new", create=True)).otherwise(im.edits(fields, "old", "new"))
    text = F.transform(sent, lambda e: F.concat(e["field"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return rows.select("c_custkey", created.alias("created"), F.array_join(text, ",").alias("sent"))
