"""Queries of text functions, table shaping, sources and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from opalgrid.catalog import CATALOG
from opalgrid.functions import text as tx
from opalgrid.operators import json_family as jf
from opalgrid.operators import ranking as rk
from opalgrid.operators import tables as tb
from opalgrid.operators.snapshots import SnapshotCache
from opalgrid.plans.dialect import table
from opalgrid.plans.registry import register
from opalgrid.shared import shared_folder
from opalgrid.sources import text as src

ID18 = "CASE WHEN o_orderkey % 3 = 0 THEN '006' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') WHEN o_orderkey % 3 = 1 THEN '000' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE 'abcdefghijklmno' END"


def ids(spark, d):
    k = F.col("o_orderkey")
    six, zero = F.concat(F.lit("006"), F.lpad(k.cast("string"), 15, "0")), F.concat(F.lit("000"), F.lpad(k.cast("string"), 12, "0"))
    return table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, six).when(k % 3 == 1, zero).otherwise("abcdefghijklmno").alias("rid"))


@register("fn_is_record_id", f"SELECT o_orderkey, regexp_matches(r, '^[a-zA-Z0-9]{{15,18}}$') AND regexp_matches(r, '[0-9]') AND NOT starts_with(r, '000') AS ok FROM (SELECT o_orderkey, {ID18} AS r FROM orders)")
def fn_is_record_id(spark, d):
    return ids(spark, d).select("o_orderkey", tx.is_record_id(F.col("rid")).alias("ok"))


@register("fn_cell_to_string", "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.10f', p_retailprice), '\\.?0+$', '') END AS price, '[Part]' AS record, coalesce(nullif(p_brand, 'Brand#11'), '') AS brand FROM part")
def fn_cell_to_string(spark, d):
    rows = table(spark, d, "part").withColumn("record", F.struct("p_name")).withColumn("b", F.nullif(F.col("p_brand"), F.lit("Brand#11")))
    return rows.select("p_partkey", tx.cell_text(F.col("p_retailprice"), "double").alias("price"), tx.cell_text(F.col("record"), "record", "Part").alias("record"), tx.cell_text(F.col("b"), "string").alias("brand"))


URL_SQL = "'/services/data/v66.0/' || CASE WHEN event_id % 2 = 0 THEN 'query/01g' || event_id || '?x=1' ELSE 'sobjects/Account/001' || lpad(CAST(event_id AS VARCHAR), 15, '0') || '?cache=0.1' END"


def call_urls(spark, d):
    k = F.col("event_id")
    odd = F.concat(F.lit("sobjects/Account/001"), F.lpad(k.cast("string"), 15, "0"), F.lit("?cache=0.1"))
    return table(spark, d, "events").withColumn("url", F.concat(F.lit("/services/data/v66.0/"), F.when(k % 2 == 0, F.concat(F.lit("query/01g"), k.cast("string"), F.lit("?x=1"))).otherwise(odd)))


@register("fn_simplify_url", f"SELECT event_id, regexp_replace(regexp_replace(split_part({URL_SQL}, '?', 1), '(/query/).*$', '\\1'), '[a-zA-Z0-9]{{18}}', '{{id}}', 'g') AS url FROM events")
def fn_simplify_url(spark, d):
    return call_urls(spark, d).select("event_id", tx.simplify_url(F.col("url")).alias("url"))


@register("fn_humanize", "SELECT regexp_replace(replace(p_type, ' ', ''), '([A-Z])', ' \\1', 'g') AS name FROM part")
def fn_humanize(spark, d):
    return table(spark, d, "part").select(tx.humanize(F.replace("p_type", F.lit(" "))).alias("name"))


def _duration_sql() -> str:
    left, parts = "m", []
    for name, size in tx.UNITS:
        parts.append(f"CASE WHEN {left} // {size} > 0 THEN ({left} // {size}) || ' {name}' || CASE WHEN {left} // {size} > 1 THEN 's' ELSE '' END END")
        left = f"({left} % {size})"
    return f"SELECT o_orderkey, CASE WHEN v < 1 THEN 'Less than a minute' ELSE concat_ws(' ', {', '.join(parts)}) END AS words FROM (SELECT o_orderkey, v, CAST(floor(v + 0.5) AS BIGINT) AS m FROM (SELECT o_orderkey, o_orderkey * 7.5::DOUBLE - 7.0 AS v FROM orders))"


@register("fn_format_duration", _duration_sql())
def fn_format_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.format_duration(F.col("o_orderkey") * 7.5 - 7.0).alias("words"))


BYTES_SQL = (
    "SELECT doc_id, CASE WHEN n <= 0 THEN '0 B' ELSE CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.1f', v) END || u END AS size FROM (SELECT doc_id, n, "
    "round(n / CASE WHEN n < 1024 THEN 1.0 WHEN n < 1048576 THEN 1024.0 WHEN n < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END::DOUBLE, 1) AS v, "
    "CASE WHEN n < 1024 THEN ' B' WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS u FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents))"
)


@register("fn_format_bytes", BYTES_SQL)
def fn_format_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


ACTION_SQL = "CASE event_type WHEN 'click' THEN 'Aura/' || event_id WHEN 'view' THEN 'VF:Page:' || event_id WHEN 'error' THEN 'CODE_UNIT_STARTED' WHEN 'signup' THEN NULL ELSE 'Batch' END"


def operations(spark, d):
    k, t = F.col("event_id").cast("string"), F.col("event_type")
    return table(spark, d, "events").withColumn("op", F.when(t == "click", F.concat(F.lit("Aura/"), k)).when(t == "view", F.concat(F.lit("VF:Page:"), k)).when(t == "error", "CODE_UNIT_STARTED").when(t == "signup", F.lit(None)).otherwise("Batch"))


@register("fn_parse_action", f"SELECT event_id, CASE WHEN coalesce(o, '') IN ('', 'CODE_UNIT_STARTED') THEN '-' WHEN len(regexp_split_to_array(o, '[/:]')) > 1 THEN regexp_split_to_array(o, '[/:]')[1] || ' · ' || regexp_split_to_array(o, '[/:]')[2] ELSE o END AS action FROM (SELECT event_id, {ACTION_SQL} AS o FROM events)")
def fn_parse_action(spark, d):
    return operations(spark, d).select("event_id", tx.parse_action(F.col("op")).alias("action"))


#: One log per kind, by event_id % 12: what follows the debug line ({k} is the id), and the action it stands for.
LOG_KINDS = (
    ("CODE_UNIT_STARTED|[EXTERNAL]|apex://Ctl{k}/ACTION$run", "Ctl{k}.run"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|01p|Svc{k}.call(String)", "Svc{k}.call"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|01q|AccTrg on Account trigger event BeforeInsert|__sfdc_trigger/AccTrg", "Trigger · AccTrg (BeforeInsert)"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|Handler{k}", "Handler{k}"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|01p000000000001|VFRemote: Rem{k} invoke(go)", "VFRemote · Rem{k}.go"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|01p000000000001|Svc{k}.Svc{k}(Integer)", "Svc{k} (constructor)"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|01p000000000001|Queue job {k}", "Queue job {k}"),
    ("METHOD_ENTRY|[1]|01p|ns.Cls{k}.go(Integer)", "Cls{k}.go"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|Class.ns.Cls{k}.act", "Cls{k}.act"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|Flow:Onboard{k}", "Flow · Onboard{k}"),
    ("CODE_UNIT_STARTED|[EXTERNAL]|Ord{k} on Account trigger event AfterUpdate", "Trigger · Ord{k} (AfterUpdate)"),
    ("FLOW_START_INTERVIEW_BEGIN|Flow_{k}", "Flow · Flow_{k}"),
)


def log_bodies(spark, d):
    """Log bodies of twelve kinds made from the events."""
    kinds = F.array(*[F.lit(line) for line, _ in LOG_KINDS])
    own = F.replace(F.get(kinds, (F.col("event_id") % len(LOG_KINDS)).cast("int")), F.lit("{k}"), F.col("event_id").cast("string"))
    head = F.lit("64.0 APEX_CODE,FINEST\n09:00:00.0 (1)|EXECUTION_STARTED\n09:00:00.1 (2)|USER_DEBUG|[1]|DEBUG|value ")
    return table(spark, d, "events").select("event_id", F.concat(head, "event_type", F.lit("\n09:00:00.2 (3)|"), own).alias("body"), "event_type")


@register("fn_derive_action", "SELECT event_id, replace(CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{label}'" for i, (_, label) in enumerate(LOG_KINDS)) + " END, '{k}', CAST(event_id AS VARCHAR)) AS action FROM events")
def fn_derive_action(spark, d):
    return log_bodies(spark, d).select("event_id", tx.derive_action(F.col("body"), F.lit("Api")).alias("action"))


@register("fn_local_time", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' -0500' AS local FROM events")
def fn_local_time(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000+0000'")
    good = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}\+\d{4}$")
    at = F.convert_timezone(F.lit("UTC"), F.lit("-05:00"), F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return table(spark, d, "events").select("event_id", F.when(good, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" -0500"))).alias("local"))


@register("fn_api_name", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_type, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part")
def fn_api_name(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.api_name(F.col("p_type")).alias("name"))


@register("fn_api_name_pascal", "SELECT p_partkey, replace(p_type, ' ', '') AS name FROM part")
def fn_api_name_pascal(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.api_name(F.col("p_type"), pascal=True).alias("name"))


@register("fn_convert_value", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' WHEN 3 THEN 'number' ELSE 'string' END AS kind, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN '1.50' WHEN 3 THEN '1.5' ELSE '007' END AS value FROM part")
def fn_convert_value(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("", "TRUE", "1.50", "1.5", "007")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    typed = tx.convert_value(raw)
    return table(spark, d, "part").select("p_partkey", typed["kind"].alias("kind"), typed["text"].alias("value"))


@register("fn_set_nested", "SELECT c_custkey, c_name AS owner_name FROM customer")
def fn_set_nested(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.struct(F.struct(F.lit(None).cast("string").alias("name")).alias("owner")).alias("r"))
    rows = rows.withColumn("r", F.col("r").withField("owner.name", F.col("c_name")))
    return rows.select("c_custkey", F.col("r.owner.name").alias("owner_name"))


@register("fn_guess_column", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'c_name' WHEN 1 THEN 'o_orderkey' ELSE 'x.' || c_mktsegment END AS guess FROM customer")
def fn_guess_column(spark, d):
    """Headers that name a field with its object take the field; others stay, trimmed."""
    known = [(o, f.name) for o in ("customer", "orders") for f in table(spark, d, o).schema]
    names = spark.createDataFrame(known, "object string, field string")
    k = F.col("c_custkey") % 3
    heads = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "customer.C_NAME").when(k == 1, " o_orderkey ").otherwise(F.concat(F.lit("x."), "c_mktsegment")).alias("header"))
    fits = (F.lower(F.substring_index("header", ".", 1)) == F.col("object")) & (F.lower(F.substring_index("header", ".", -1)) == F.col("field"))
    return heads.join(F.broadcast(names), fits & F.contains("header", F.lit(".")), "left").select("c_custkey", F.coalesce("field", F.trim("header")).alias("guess"))  # the fields of two tables


@register("fn_column_valid", "SELECT c_custkey, c_custkey % 6 IN (0, 2, 4, 5) AS ok FROM customer")
def fn_column_valid(spark, d):
    """Header names: plain, with a wrong sign, a relation, half a relation, dotted, not to be imported."""
    stem = F.get(F.array(*map(F.lit, ("Name", "Na*me", "Rel:Type:Ext", "a:b", "Owner.Name", "_x"))), (F.col("c_custkey") % 6).cast("int"))
    name = F.concat(stem, F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", name.rlike(r"^[a-zA-Z_][\w.\-]*(:\w+:\w+)?$").alias("ok"))


@register("fn_field_type_desc", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'string (' || length(c_name) || ')' ELSE 'currency (16, 2)' END || CASE WHEN c_custkey % 3 = 0 THEN ' required' ELSE '' END AS descr FROM customer")
def fn_field_type_desc(spark, d):
    k = F.col("c_custkey")
    size = F.when(k % 2 == 0, F.concat(F.lit("string ("), F.length("c_name").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("currency ("), (F.lit(18) - 2).cast("string"), F.lit(", 2)")))
    return table(spark, d, "customer").select("c_custkey", F.concat(size, F.when(k % 3 == 0, " required").otherwise("")).alias("descr"))


@register("fn_record_label", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name, CAST(c_custkey AS VARCHAR)) AS label, concat_ws(' | ', nullif(c_mktsegment, 'BUILDING'), c_name) AS meta FROM customer")
def fn_record_label(spark, d):
    seg = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(seg, "c_name", F.col("c_custkey").cast("string")).alias("label"), F.concat_ws(" | ", seg, "c_name").alias("meta"))


@register("fn_escape_like", r"SELECT p_partkey, replace(replace(replace(p_brand || '_%\', '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM part")
def fn_escape_like(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.concat("p_brand", F.lit("_%\\")), r"([\\%_])", r"\\$1").alias("escaped"))


@register("fn_url_record_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '001' || lpad(CAST(page_id AS VARCHAR), 15, '0') WHEN page_id % 3 = 1 THEN '006' || lpad(CAST(page_id AS VARCHAR), 12, '0') ELSE NULL END AS rid FROM pages")
def fn_url_record_id(spark, d):
    k = F.col("page_id")
    a = F.concat(F.lit("https://x.example.com/lightning/r/Account/001"), F.lpad(k.cast("string"), 15, "0"), F.lit("/view"))
    b = F.concat(F.lit("https://x.example.com/edit?a=1&id=006"), F.lpad(k.cast("string"), 12, "0"), F.lit("#top"))
    return table(spark, d, "pages").select("page_id", tx.url_record_id(F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(F.col("url"))).alias("rid"))


@register("fn_url_sobject", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Account' END AS object FROM pages")
def fn_url_sobject(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.lit("https://x.example.com/lightning/o/Account/list?filterName=All")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.url_object(url).alias("object"))


@register("fn_channel_label", "SELECT event_id, replace(event_type, '_', ' ') || ' x' AS label FROM events")
def fn_channel_label(spark, d):
    return table(spark, d, "events").select("event_id", tx.channel_label(F.concat("event_type", F.lit("_x__e"))).alias("label"))


@register("fn_api_version", "SELECT n_nationkey, CAST((240 + 2 * n_nationkey) // 2 - 64 AS INTEGER) AS version FROM nation")
def fn_api_version(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.api_version(F.concat((F.col("n_nationkey") * 2 + 240).cast("string"), F.lit(".5.1"))).alias("version"))


@register("fn_dev_name", "SELECT r_name AS name FROM region")
def fn_dev_name(spark, d):
    return table(spark, d, "region").select(tx.developer_name(F.concat(F.lit("ns__"), "r_name", F.lit("__c"))).alias("name"))


@register("fn_display_name", "SELECT o_orderkey, 'order ' || o_orderkey || ' (' || o_orderstatus || ', v' || CAST(o_orderkey % 7 AS VARCHAR) || ')' AS name FROM orders")
def fn_display_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("order %d (%s, v%d)", "o_orderkey", "o_orderstatus", F.col("o_orderkey") % 7).alias("name"))


@register("fn_headers_parse", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS usr, CAST(2 AS BIGINT) AS n FROM events")
def fn_headers_parse(spark, d):
    text = F.concat(F.lit("X-User: 0\nX-Kind: "), "event_type", F.lit("\nbroken\nX-User:"), F.col("user_id").cast("string"))
    m = tx.headers_map(text)
    return table(spark, d, "events").select("event_id", m["X-Kind"].alias("kind"), m["X-User"].alias("usr"), F.size(m).cast("long").alias("n"))


@register("fn_extract_json", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def fn_extract_json(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure. "), "props", F.lit(" Done."))).otherwise("no json here")
    return table(spark, d, "events").select("event_id", F.get_json_object(tx.extract_json(text), "$.k").cast("long").alias("k"))


@register("fn_extract_tag", "SELECT n_name AS q FROM nation")
def fn_extract_tag(spark, d):
    return table(spark, d, "nation").select(tx.extract_tag(F.concat(F.lit("x <soql>"), "n_name", F.lit("</soql> y")), "soql").alias("q"))


@register("fn_plural", "SELECT o_custkey, count(*) || ' order' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS words FROM orders GROUP BY o_custkey")
def fn_plural(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("o_custkey", F.concat(F.col("n").cast("string"), F.lit(" order"), tx.plural(F.col("n"))).alias("words"))


@register("fn_severity_map", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity FROM events")
def fn_severity_map(spark, d):
    t = F.col("event_type")
    raw = F.when(t == "error", "Critical").when(t == "view", "WARNING").when(t == "click", "information").otherwise(t)
    return table(spark, d, "events").select("event_id", tx.severity(raw).alias("severity"))


@register("fn_base64", "SELECT c_custkey, base64(c_name::BLOB) AS packed, c_name AS unpacked FROM customer")
def fn_base64(spark, d):
    packed = F.base64(F.col("c_name").cast("binary"))
    return table(spark, d, "customer").select("c_custkey", packed.alias("packed"), F.unbase64(packed).cast("string").alias("unpacked"))


@register("fn_ttl_valid", "SELECT event_id, TIMESTAMP '2024-01-20' - ts < CASE WHEN event_id % 2 = 0 THEN INTERVAL 48 HOUR ELSE INTERVAL 168 HOUR END AS valid FROM events WHERE ts < '2024-01-20'")
def fn_ttl_valid(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = table(spark, d, "events").filter("ts < timestamp_ntz'2024-01-20 00:00:00'")
    return rows.select("event_id", tx.ttl_valid(F.col("ts").cast("timestamp"), F.when(F.col("event_id") % 2 == 0, 48), now).alias("valid"))


@register("fn_fault_msg", "SELECT p_partkey, 'E' || p_partkey || ': bad [p_name, p_size], W: odd' AS msg FROM part")
def fn_fault_msg(spark, d):
    e = F.array(
        F.struct(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("code"), F.lit("bad").alias("message"), F.array(F.lit("p_name"), F.lit("p_size")).alias("fields")),
        F.struct(F.lit("W").alias("code"), F.lit("odd").alias("message"), F.array().cast("array<string>").alias("fields")),
    )
    return table(spark, d, "part").select("p_partkey", tx.fault_message(e).alias("msg"))


RANDOM_SQL = (
    "SELECT p_partkey, n % 10000 AS i, round(n % 100000 / 100.0::DOUBLE, 2) AS m, n % 2 = 0 AS b, CASE n % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS p, substr(h, 1, CAST(5 + n % 15 AS INTEGER)) AS s "
    "FROM (SELECT p_partkey, h, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS n FROM (SELECT p_partkey, md5('7:' || p_partkey) AS h FROM part))"
)


@register("fn_random_value", RANDOM_SQL)
def fn_random_value(spark, d):
    """Seeded values by field type, from a hash of seed and key: a retried task makes the same ones."""
    value = lambda kind, *choices: tx.random_value(F.col("p_partkey"), kind, 7, choices)
    return table(spark, d, "part").select("p_partkey", value("int").alias("i"), value("double").alias("m"), value("boolean").alias("b"), value("picklist", "red", "green", "blue").alias("p"), value("string").alias("s"))


@register("fn_initials", "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: x[1]), '') AS letters FROM part")
def fn_initials(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.initials(F.col("p_type")).alias("letters"))


@register("fn_linear_color", "SELECT p_partkey, CASE WHEN p_size - 10 <= 0 THEN '' ELSE printf('rgb(%d, %d, %d)', CAST(round(46 + s * 185) AS INTEGER), CAST(round(204 - s * 128) AS INTEGER), CAST(round(113 - s * 53) AS INTEGER)) END AS color FROM (SELECT p_partkey, p_size, (least(greatest(p_size - 10, 1), 50) - 1) / 49.0::DOUBLE AS s FROM part)")
def fn_linear_color(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.linear_color(F.col("p_size") - 10).alias("color"))


def nested_orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left")
    return rows.select("o_orderkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("market")).alias("customer"), "o_orderstatus")


FLAT = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@register("tbl_flatten_records", f"SELECT o_orderkey, '[customer]' AS customer, c_name AS \"customer.name\", '[market]' AS \"customer.market\", c_mktsegment AS \"customer.market.segment\", o_orderstatus {FLAT}")
def tbl_flatten_records(spark, d):
    return tb.flatten_records(nested_orders(spark, d))


@register("tbl_props_flatten", f"SELECT o_orderkey, c_name AS \"customer.name\", c_mktsegment AS \"customer.market.segment\", o_orderstatus {FLAT}")
def tbl_props_flatten(spark, d):
    return tb.flatten_records(nested_orders(spark, d), parents=False)


@register("tbl_hide_relations", "SELECT o_orderkey, o_orderstatus FROM orders")
def tbl_hide_relations(spark, d):
    return tb.hide_relations(nested_orders(spark, d))


@register("tbl_filter_any", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'promo') OR contains(lower(p_brand), 'promo') OR contains(lower(p_type), 'promo')")
def tbl_filter_any(spark, d):
    return tb.filter_any(table(spark, d, "part"), "PROMO").select("p_partkey")


@register("tbl_filter_cols", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#2')")
def tbl_filter_cols(spark, d):
    return tb.filter_any(table(spark, d, "part"), "#2", ["p_brand", "no_such_column"]).select("p_partkey")


@register("tbl_multi_term_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'o') AND contains(lower(p_type), 'e') AND contains(lower(p_brand), '1')")
def tbl_multi_term_filter(spark, d):
    return tb.filter_terms(table(spark, d, "part"), {"p_type": "O E", "p_brand": "1"}).select("p_partkey")


@register("tbl_multi_term_all", "SELECT p_partkey FROM part WHERE (contains(lower(p_type), 'e') OR contains(lower(p_brand), 'e')) AND (contains(lower(p_type), '#1') OR contains(lower(p_brand), '#1'))")
def tbl_multi_term_all(spark, d):
    return tb.filter_all_terms(table(spark, d, "part"), "e #1", ["p_type", "p_brand"]).select("p_partkey")


@register("tbl_available_columns", "SELECT DISTINCT event_type AS name FROM events")
def tbl_available_columns(spark, d):
    return tb.available_columns(table(spark, d, "events").select(F.create_map("event_type", "value").alias("m")), "m")


@register("tbl_csv_parse", "SELECT CAST(n_nationkey AS VARCHAR) AS key, CAST(i AS INTEGER) AS row, CASE WHEN i = 0 THEN 'a|b' ELSE n_name || ',1|y\"z' END AS cells FROM nation, (VALUES (0), (1)) t(i)")
def tbl_csv_parse(spark, d):
    text = F.concat(F.lit('a,b\n"'), "n_name", F.lit(',1","y""z"\n'))
    rows = src.parse_csv_text(table(spark, d, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t")
    return rows.select("key", "row", F.array_join("cells", "|").alias("cells"))


@register("tbl_json_to_tables", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def tbl_json_to_tables(spark, d):
    """The child table of an order document, with its parents' columns."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))).alias("items"))
    docs = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.struct(F.col("o_orderkey").alias("key"), "items").alias("doc"))
    child = tb.json_tables(docs)["@.items.*"]
    return child.agg(F.count(F.lit(1)).alias("n"), F.sum("`@.key`").alias("keys"), F.sum("`@.items.*.line`").alias("lines"))


def order_texts(spark, d):
    """Orders with their lines as JSON texts, written once; ``extra`` holds a number, an object or an array."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("qty"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))  # the lines of an order
    k = F.col("o_orderkey")
    extra = F.when(k % 3 == 0, F.lit("7")).when(k % 3 == 1, F.lit('{"deep":{"n":1}}')).otherwise(F.lit('[1,{"z":"x"},null]'))
    text = F.concat(F.lit('{"key":'), k.cast("string"), F.lit(',"head":{"status":"'), "o_orderstatus", F.lit('"},"extra":'), extra, F.lit(',"items":'), F.to_json("items"), F.lit("}"))
    path = shared_folder(spark, "order-texts")
    table(spark, d, "orders").join(items, k == F.col("l_orderkey")).select("o_orderkey", text.alias("text")).write.parquet(path)
    return spark.read.parquet(path)


LINES_SQL = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(trunc(l_quantity) AS BIGINT), l_returnflag, l_linestatus) - 1 AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@register("tbl_json_unknown", f"""SELECT unnest([l_returnflag, l_linestatus]) AS flag, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) AS qty, CAST(item AS INTEGER) AS item,
'[Array 2]' AS flags, CASE o_orderkey % 3 WHEN 0 THEN '7' WHEN 2 THEN '[Array 3]' END AS extra, CASE WHEN o_orderkey % 3 = 1 THEN '1' END AS deep, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS key, o_orderkey FROM ({LINES_SQL})""")
def tbl_json_unknown(spark, d):
    """The innermost table of texts without a schema, with the columns of all its parents."""
    t = jf.json_family(order_texts(spark, d), "text", ["o_orderkey"])["@.items.*.flags.*"]
    names = {
        "@.items.*.flags.*": "flag", "@.items.*.line": "line", "@.items.*.qty": "qty", "@.items.*.#": "item", "@.items.*.flags": "flags", "@.extra": "extra", "@.extra.deep.n": "deep", "@.head.status": "status", "@.key": "key", "@.items": "",
        "o_orderkey": "o_orderkey",
    }
    return t.frame.toDF(*[names[c] or c for c in t.columns]).drop("@.items")


FAMILY_SQL = """
WITH o AS (SELECT DISTINCT o_orderkey, o_orderkey % 3 AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT count(*) AS every, count(*) FILTER (r = 0) AS zero, count(*) FILTER (r = 1) AS one, count(*) FILTER (r = 2) AS two FROM o),
l AS (SELECT count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT unnest(['@', '@', '@', '@', '@', '@.extra.*', '@.extra.*', '@.extra.*', '@.items.*', '@.items.*', '@.items.*', '@.items.*', '@.items.*.flags.*']) AS name,
       unnest(['@.extra', '@.extra.deep.n', '@.head.status', '@.items', '@.key', '@.extra.*', '@.extra.*.z', '@.extra.*.#', '@.items.*.flags', '@.items.*.line', '@.items.*.qty', '@.items.*.#', '@.items.*.flags.*']) AS "column",
       unnest([zero + two, one, every, every, every, two, two, two, lines, lines, lines, lines, 2 * lines]) AS filled FROM n, l
"""


@register("tbl_json_family", FAMILY_SQL)
def tbl_json_family(spark, d):
    """All tables and columns that the texts turn out to have, with the number of filled cells."""
    return jf.filled(jf.json_family(order_texts(spark, d), "text"))


@register("tbl_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def tbl_json_props(spark, d):
    t = jf.json_family(table(spark, d, "events"), "props", ["event_id"])["@"]
    return t.frame.select("event_id", F.col("`@.k`").cast("long").alias("k"))


@register("tbl_resource_links", f"SELECT event_id, {URL_SQL} AS link FROM events")
def tbl_resource_links(spark, d):
    docs = call_urls(spark, d).select(F.struct("event_id", F.struct("url", "event_type").alias("ref")).alias("doc"))
    leaves = tb.json_tables(docs)["@"]
    return leaves.filter(F.col("`@.ref.url`").startswith("/services/data/")).select(F.col("`@.event_id`").alias("event_id"), F.col("`@.ref.url`").alias("link"))


@register("tbl_layout_flatten", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS item, CAST(l_linenumber AS INTEGER) AS value FROM lineitem WHERE l_returnflag <> 'zz'")
def tbl_layout_flatten(spark, d):
    part = F.struct(F.col("l_linenumber").alias("value"), F.lit("Field").alias("type"))
    sections = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(F.sort_array(F.collect_list(part))).alias("rows"))
    each = sections.select("l_orderkey", F.posexplode("rows").alias("row", "items")).select("l_orderkey", "row", F.posexplode("items").alias("item", "c"))
    return each.filter("c.type = 'Field'").select("l_orderkey", "item", F.col("c.value").alias("value"))


LAYOUT_SQL = """
SELECT l_orderkey, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS section, CAST(CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS row, item, c AS component,
       CAST(trunc(CASE c WHEN 0 THEN l_linenumber ELSE l_quantity END) AS BIGINT) AS value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_quantity) - 1 AS INTEGER) AS item FROM lineitem), (VALUES (0), (2)) t(c)
WHERE l_returnflag IN ('A', 'N', 'R') AND l_linestatus IN ('F', 'O')
"""


@register("tbl_layout_levels", LAYOUT_SQL)
def tbl_layout_levels(spark, d):
    """Sections, rows, items and components of a layout per order, flattened to its fields."""
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # the lines of an order
    part = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.cast("long").alias("value"))
    item = lambda x: F.struct(F.array(part("Field", x["l_linenumber"]), part("Separator", F.lit(None)), part("Field", x["l_quantity"])).alias("components"))
    row = lambda flag, status: F.struct(F.transform(F.filter("lines", lambda x: (x["l_returnflag"] == flag) & (x["l_linestatus"] == status)), item).alias("items"))
    sections = F.array(*[F.struct(F.array(row(flag, "F"), row(flag, "O")).alias("rows")) for flag in "ANR"])
    return tb.layout_fields(lines.select("l_orderkey", sections.alias("sections")), "l_orderkey", "sections")


NO_NULLS_SQL = (
    "SELECT o_orderkey, '{\"k\":' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',\"s\":\"' || o_orderstatus || '\"' END || ',\"in\":{\"a\":1' || "
    "CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',\"s\":\"' || o_orderstatus || '\"' END || '},\"items\":[{\"n\":1},null,{' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '\"s\":\"' || o_orderstatus || '\"' END || '}]}' AS doc FROM orders"
)


@register("tbl_remove_nulls", NO_NULLS_SQL)
def tbl_remove_nulls(spark, d):
    """Null keys go at every depth, elements of arrays stay."""
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    item = lambda n, v: F.struct(F.lit(n).cast("int").alias("n"), v.cast("string").alias("s"))
    items = F.array(item(1, F.lit(None)), F.lit(None), item(None, s))
    doc = F.struct(F.col("o_orderkey").alias("k"), s.alias("s"), F.struct(F.lit(1).alias("a"), s.alias("s")).alias("in"), items.alias("items"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(doc, {"ignoreNullFields": "true"}).alias("doc"))


#: A limit per event type, in the form that a service replies with: as many as there were, twice the dear ones used.
LIMITS_SQL = "SELECT event_type AS name, CASE WHEN event_type = 'view' THEN 0 ELSE count(*) END AS mx, CASE WHEN event_type = 'view' THEN 0 ELSE count(*) END - 2 * count(*) FILTER (value > 20) AS remaining FROM events GROUP BY event_type"


@register("tbl_limits_unpivot", LIMITS_SQL)
def tbl_limits_unpivot(spark, d):
    return limits(spark, d)


def limits(spark, d):
    """(name, mx, remaining) from JSON replies of one limit per name."""
    mx = F.when(F.col("event_type") == "view", 0).otherwise(F.count(F.lit(1)))
    reply = F.to_json(F.create_map("event_type", F.struct(mx.alias("Max"), (mx - 2 * F.count_if(F.col("value") > 20)).alias("Remaining"))))
    replies = table(spark, d, "events").groupBy("event_type").agg(reply.alias("reply"))
    m = F.from_json("reply", "map<string,struct<Max:bigint,Remaining:bigint>>")
    return replies.select(F.explode(m).alias("name", "v")).select("name", F.col("v.Max").alias("mx"), F.col("v.Remaining").alias("remaining"))


@register("tbl_log_grep", "SELECT event_id, '09:00:00.1 (2)|USER_DEBUG|[1]|DEBUG|value ' || event_type AS hit FROM events WHERE event_type IN ('error', 'view')")
def tbl_log_grep(spark, d):
    """Lines that hold any of the patterns, in their case."""
    wanted = [p.strip() for p in " value error | value view|".split("|") if p.strip()]
    lines = log_bodies(spark, d).select("event_id", F.explode(F.split("body", "\n")).alias("line"))
    hit = F.lit(False)
    for p in wanted:
        hit = hit | F.contains("line", F.lit(p))
    return lines.filter(hit).select("event_id", F.col("line").alias("hit"))


@register("tbl_log_search", "SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_type = 'purchase'")
def tbl_log_search(spark, d):
    rows = log_bodies(spark, d).withColumn("body", F.when(F.col("event_id") % 5 != 0, F.col("body")))
    return rows.filter(F.col("body").isNull() | F.contains(F.lower("body"), F.lit("value purchase"))).select("event_id")


@register("tbl_log_users", "SELECT DISTINCT user_id, coalesce(c_name, CAST(user_id AS VARCHAR)) AS name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 2 = 0")
def tbl_log_users(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    named = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return users.join(named, "user_id", "left").select("user_id", F.coalesce("c_name", F.col("user_id").cast("string")).alias("name")).orderBy("name")


@register("tbl_user_search", "SELECT c_custkey FROM customer WHERE (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def tbl_user_search(spark, d):
    rows = table(spark, d, "customer").filter((F.col("c_name").ilike("%1%") | F.col("c_mktsegment").ilike("%1%")) & (F.col("c_acctbal") > 0))
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey")


FIELD_SQL = (
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Invalid type \"Blob\" on line 4' END AS error, CASE WHEN c_custkey % 5 > 0 THEN label END AS label, CASE WHEN c_custkey % 5 > 0 THEN name END AS name, "
    "CASE WHEN c_custkey % 5 > 0 THEN type END AS type FROM (SELECT c_custkey, 'Name' AS label, 'n' || c_custkey AS name, 'Text' AS type FROM customer "
    "UNION ALL SELECT c_custkey, 'Flag', 'f' || c_custkey, 'Checkbox' FROM customer WHERE c_custkey % 5 > 0)"
)


@register("tbl_field_import", FIELD_SQL)
def tbl_field_import(spark, d):
    """Texts of label, name and type lines: the fields of each, or its error and none of its fields."""
    k = F.col("c_custkey").cast("string")
    last = F.when(F.col("c_custkey") % 5 == 0, "Blob").otherwise("Checkbox")
    text = F.concat(F.lit("Name , n"), k, F.lit(",Text\n\nno type,x,\nFlag,f"), k, F.lit(", "), last, F.lit("\n"))
    text = F.when(F.col("c_custkey") % 2 == 1, F.replace(text, F.lit(","), F.lit(";"))).otherwise(text)
    read = table(spark, d, "customer").select("c_custkey", src.import_fields(text).alias("r"))
    rows = read.select("c_custkey", F.col("r.error").alias("error"), F.explode_outer("r.fields").alias("f"))
    return rows.select("c_custkey", "error", "f.label", "f.name", "f.type")


@register("tbl_field_def", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Number' ELSE 'Text' END AS type, CASE WHEN p_partkey % 2 = 0 THEN 18 + 2 END AS precision, CASE WHEN p_partkey % 2 = 1 THEN 255 END AS length FROM part")
def tbl_field_def(spark, d):
    even = F.col("p_partkey") % 2 == 0
    f = F.struct(F.when(even, "Number").otherwise("Text").alias("type"), F.when(even, F.lit(18) + 2).alias("precision"), F.when(~even, F.lit(255)).alias("length"))
    return table(spark, d, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


@register("tbl_field_search", "SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_name ILIKE 'cold w%') AND p_brand NOT ILIKE '%5'")
def tbl_field_search(spark, d):
    part = table(spark, d, "part")
    labels = part.filter(F.col("p_name").ilike("cold w%")).select("p_type")
    return part.filter(~F.col("p_brand").ilike("%5")).join(labels, "p_type", "left_semi").select("p_partkey")


@register("tbl_component_list", "SELECT CASE WHEN starts_with(lower(p_type), 'small') THEN 'Settings' ELSE p_brand END AS kind, count(DISTINCT p_name) AS members FROM part WHERE p_size > 5 GROUP BY 1")
def tbl_component_list(spark, d):
    kind = F.when(F.lower("p_type").startswith("small"), "Settings").otherwise(F.col("p_brand"))
    return table(spark, d, "part").filter("p_size > 5").groupBy(kind.alias("kind")).agg(F.count_distinct("p_name").alias("members"))


@register("tbl_managed_filter", "SELECT p_partkey FROM part WHERE nullif(p_brand, 'Brand#11') IS NULL")
def tbl_managed_filter(spark, d):
    return table(spark, d, "part").filter(F.nullif(F.col("p_brand"), F.lit("Brand#11")).isNull()).select("p_partkey")


@register("tbl_fullname", "SELECT p_partkey, p_brand || '.' || p_name AS full_name FROM part")
def tbl_fullname(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_name").alias("full_name"))


@register("tbl_catalog_delta", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def tbl_catalog_delta(spark, d):
    cache = table(spark, d, "customer").filter("c_custkey % 4 <> 0 OR c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("old"))
    delta = table(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("new"))
    return cache.join(delta, "c_custkey", "full_outer").select("c_custkey", F.coalesce("new", "old").alias("name"))


@register("tbl_ttl_cache", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def tbl_ttl_cache(spark, d):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    rows = table(spark, d, "nation").withColumn("written", F.when(F.col("n_nationkey") % 2 == 0, F.lit("2024-01-19 00:00:00")).otherwise(F.lit("2023-12-01 00:00:00")).cast("timestamp"))
    return rows.filter(tx.ttl_valid(F.col("written"), F.lit(None).cast("int"), now)).select("n_nationkey", "n_name")


@register("tbl_catalog_snapshots", "SELECT 'before' AS reader, c_custkey, c_name AS name FROM customer UNION ALL SELECT 'after', c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 <> 0")
def tbl_catalog_snapshots(spark, d):
    """A reader who began before a refresh, and one a week later for whom only the refreshed entries are alive."""
    start, customer = datetime(2024, 1, 1), table(spark, d, "customer")
    cache = SnapshotCache(spark, shared_folder(spark, "catalog"), hours=168)
    cache.write(customer.select("c_custkey", F.col("c_name").alias("name")), start)
    before = cache.read(start + timedelta(hours=50))
    delta = customer.filter("c_custkey % 3 = 0 OR c_custkey % 11 = 0").select("c_custkey", F.upper("c_name").alias("name"), (F.col("c_custkey") % 11 == 0).alias("gone"))
    cache.refresh(delta, "c_custkey", start + timedelta(hours=100), gone="gone")
    after = cache.read(start + timedelta(hours=200))
    return before.select(F.lit("before").alias("reader"), "*").unionByName(after.select(F.lit("after").alias("reader"), "*"))


@register("tbl_metric_query", "SELECT event_type, round(sum(value), 4) AS total FROM events WHERE ts > TIMESTAMP '2024-01-28' - INTERVAL 24 HOUR AND ts <= '2024-01-28' GROUP BY event_type")
def tbl_metric_query(spark, d):
    rows = table(spark, d, "events").filter("ts > timestamp_ntz'2024-01-28 00:00:00' - INTERVAL 24 HOURS AND ts <= timestamp_ntz'2024-01-28 00:00:00'")
    return rows.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@register("sink_csv", "SELECT '\"' || n_nationkey || '\",\"' || replace(n_name, '\"', '\"\"') || '\",\"' || coalesce(CAST(nullif(n_regionkey, 1) AS VARCHAR), '') || '\"' AS line FROM nation")
def sink_csv(spark, d):
    return tb.csv_text(table(spark, d, "nation").select("n_nationkey", "n_name", F.nullif(F.col("n_regionkey"), F.lit(1)).alias("r")))


@register("sink_tsv", "SELECT '\"' || r_regionkey || '\"' || chr(9) || '\"' || r_name || '\"' AS line FROM region")
def sink_tsv(spark, d):
    return tb.csv_text(table(spark, d, "region"), "\t")


@register("sink_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS doc FROM region")
def sink_json(spark, d):
    return table(spark, d, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("doc"))


@register("sink_csv_bom", """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, CASE WHEN row_number() OVER (ORDER BY c_custkey) = 1 THEN chr(65279) ELSE '' END || '"' || c_custkey || '","' || c_name || '"' || chr(13) AS line FROM customer""")
def sink_csv_bom(spark, d):
    """Numbered lines for a text sink: the first begins with the byte order mark, each ends with a carriage return."""
    rows = rk.ordinals(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "place")
    line = tb.csv_line([F.col("c_custkey").cast("string"), F.col("c_name")])
    return rows.select("place", F.concat(F.when(F.col("place") == 0, "\ufeff").otherwise(""), line, F.lit("\r")).alias("line")).orderBy("place")


@register("sink_table_tsv", "SELECT p_partkey || chr(9) || p_brand AS line FROM part")
def sink_table_tsv(spark, d):
    return tb.csv_text(table(spark, d, "part").select("p_partkey", "p_brand"), "\t", quoted=False)


@register("sink_violations_csv", "SELECT '\"' || event_type || '\",\"' || CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END || '\",\"' || count(*) || '\"' AS line FROM events GROUP BY event_type")
def sink_violations_csv(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return tb.csv_text(rows.select("event_type", tx.severity(F.col("event_type")).alias("s"), "n"))


@register("sink_manifest", """SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Package xmlns="http://soap.sforce.com/2006/04/metadata">' || chr(10) || string_agg('    <types>' || chr(10) || m || '        <name>' || k || '</name>' || chr(10) || '    </types>' || chr(10), '' ORDER BY k) || '    <version>62.0</version>' || chr(10) || '</Package>' AS xml FROM (SELECT r_name AS k, string_agg('        <members>' || n_name || '</members>' || chr(10), '' ORDER BY n_name) AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def sink_manifest(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return tb.manifest(n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name"), "r_name", "n_name")


MANIFEST_LINES_SQL = """
WITH m AS (SELECT DISTINCT p_brand AS kind, p_name AS name FROM part)
SELECT 1 AS part, kind, 1 AS place, name, '        <members>' || name || '</members>' AS line FROM m
UNION ALL SELECT 1, kind, p, '', CASE p WHEN 0 THEN '    <types>' WHEN 2 THEN '        <name>' || kind || '</name>' ELSE '    </types>' END FROM (SELECT DISTINCT kind FROM m), (VALUES (0), (2), (3)) t(p)
UNION ALL SELECT * FROM (VALUES (0, '', 0, '', '<?xml version="1.0" encoding="UTF-8"?>'), (0, '', 1, '', '<Package xmlns="http://soap.sforce.com/2006/04/metadata">'), (2, '', 0, '', '    <version>62.0</version>'), (2, '', 1, '', '</Package>')) h
ORDER BY 1, 2, 3, 4
"""


@register("sink_manifest_lines", MANIFEST_LINES_SQL)
def sink_manifest_lines(spark, d):
    """The manifest of all parts by brand, a row per line."""
    return tb.manifest_lines(table(spark, d, "part"), "p_brand", "p_name")


@register("src_manifest_parse", "SELECT r_name AS kind, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def src_manifest_parse(spark, d):
    return src.manifest_members(sink_manifest(spark, d), "xml").select("kind", F.array_join("members", ",").alias("members"))


@register("src_csv", "SELECT n_nationkey, n_name FROM nation")
def src_csv(spark, d):
    line = tb.csv_text(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return line.select(F.from_csv("line", "n_nationkey int, n_name string", {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


@register("src_tsv_excel", "SELECT r_regionkey, r_name FROM region")
def src_tsv_excel(spark, d):
    line = tb.csv_text(table(spark, d, "region"), "\t")
    return line.select(F.from_csv("line", "r_regionkey int, r_name string", {"sep": "\t", "quote": '"', "escape": '"'}).alias("r")).select("r.*")


@register("src_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("src_format_sniff", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'excel' WHEN 3 THEN 'csv' WHEN 4 THEN '' ELSE 'csv' END AS format FROM events")
def src_format_sniff(spark, d):
    """The format of pasted texts: objects, arrays, tabs, commas, a word, and what only begins like JSON."""
    user = F.col("user_id").cast("string")
    kinds = F.array(F.col("props"), F.concat(F.lit(" ["), user, F.lit(", 2]")), F.concat("event_type", F.lit("\t"), user, F.lit(",x")), F.concat("event_type", F.lit(","), user), F.col("event_type"), F.concat(F.lit("{broken, "), user))
    return table(spark, d, "events").select("event_id", src.sniff_format(F.get(kinds, (F.col("event_id") % 6).cast("int"))).alias("format"))


@register("src_separator_detect", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ',' END AS s FROM customer")
def src_separator_detect(spark, d):
    """The separator of the first line with text; a tie goes to the earlier one, none to a comma."""
    line = lambda *marks: F.concat(F.lit("\n "), *[x for m in marks for x in (F.lit(m), F.col("c_name"))], F.lit("\n;;;;;"))
    kinds = F.array(line("", ";", ";", ","), line("", ",", ";"), line("", "\t", "\t", ";"), line("", "|"), line(""))
    return table(spark, d, "customer").select("c_custkey", src.detect_separator(F.get(kinds, (F.col("c_custkey") % 5).cast("int"))).alias("s"))


@register("src_content_type", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'csv' WHEN 3 THEN 'text' ELSE 'log' END AS k FROM events")
def src_content_type(spark, d):
    """How replies are read; one that says JSON and is none is text."""
    at = (F.col("event_id") % 5).cast("int")
    types = F.get(F.array(*map(F.lit, ("application/json", "text/xml", "text/csv", "application/json", "text/plain"))), at)
    body = F.get(F.array(F.col("props"), F.lit("<a/>"), F.lit("a,b"), F.concat(F.lit("oops "), "props"), F.lit("x")), at)
    url = F.when(at == 4, F.concat(F.lit("/tooling/ApexLog/"), F.col("event_id").cast("string"), F.lit("/Body"))).otherwise("/x")
    return table(spark, d, "events").select("event_id", src.content_kind(types, url, body).alias("k"))


@register("src_xml_parse", "SELECT n_nationkey AS key, n_name AS name, CAST(2 AS BIGINT) AS tags FROM nation")
def src_xml_parse(spark, d):
    xml = F.concat(F.lit("<row><key>"), F.col("n_nationkey").cast("string"), F.lit("</key><name>"), "n_name", F.lit("</name><tag>a</tag><tag>b</tag></row>"))
    rows = src.parse_xml(table(spark, d, "nation").select(xml.alias("x")), "x", "key int, name string, tag array<string>")
    return rows.select("record.key", "record.name", F.size("record.tag").cast("long").alias("tags"))


@register("src_event_log_file", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def src_event_log_file(spark, d):
    """A CSV blob held in a row, exploded to its records."""
    blob = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat_ws(",", "o_orderkey", "o_orderstatus")), "\n").alias("blob"))
    each = blob.select("o_custkey", F.explode(F.split("blob", "\n")).alias("line")).select("o_custkey", F.from_csv("line", "k bigint, s string").alias("r"))
    return each.filter("r.k is not null").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@register("catalog_rows", "SELECT 'data' AS namespace, 'region' AS name, '0r0' AS key_prefix")
def catalog_rows(spark, d):
    return CATALOG.rows(spark).filter("name = 'region'").select("namespace", "name", "key_prefix")
