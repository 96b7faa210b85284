"""Results of rules: thresholds with an operator, nested results as rows, and which types are looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.functions.text import severity


def breaks_threshold(value: Column, wanted: Column) -> Column:
    """Whether a number breaks an expression such as ``>=58``; an operator that is not known counts as ``>=``.

    A null value breaks equalities alone, and a null expression is never broken.
    """
    number = F.regexp_replace(wanted, "[^0-9]", "").try_cast("bigint")
    sign = F.trim(F.regexp_replace(wanted, "[0-9]", ""))
    kept = {">=": value >= number, "<": value < number, ">": value > number, "<=": value <= number}
    broken = F.when(sign.isin("=", "=="), ~value.eqNullSafe(number))
    for op, fits in kept.items():
        broken = broken.when(sign == op, ~fits)
    return F.coalesce(broken.otherwise(value < number), F.lit(False))


def flatten_results(scans: DataFrame, elements: DataFrame) -> DataFrame:
    """A row per violation: flow, rule, description, severity, element_name, element_label, element_type, expression.

    ``scans``: flow, flow_label, error, results (rule, label, description, severity, occurs, details (name, label, type,
    expression)); ``elements``: flow, name, label. A detail that names an element of its flow is a violation of the element,
    any other is one of the flow, with the detail's name and condition as its expression; a result without details
    stands for the flow with its description; a scan that failed is a violation of its own. Results that do not occur are left out.
    """
    failed = scans.filter("error IS NOT NULL").select(
        "flow", F.lit("Scan Error").alias("rule"), F.concat(F.lit("Failed to scan flow: "), "error").alias("description"), severity(F.lit("error")).alias("severity"),
        F.col("flow").cast("string").alias("element_name"), F.lit("Flow").alias("element_label"), F.lit("Unknown").alias("element_type"), F.col("error").alias("expression"),
    )
    each = scans.filter("error IS NULL").select("flow", "flow_label", F.explode("results").alias("r")).filter("r.occurs")
    each = each.select("flow", "flow_label", F.coalesce("r.label", "r.rule").alias("rule"), F.coalesce("r.description", F.lit("No description available")).alias("description"), severity(F.col("r.severity")).alias("severity"), F.explode_outer("r.details").alias("d"))
    known = elements.select(F.col("flow").alias("_flow"), F.col("name").alias("_name"), F.col("label").alias("_label"))
    rows = each.join(known, (F.col("flow") == F.col("_flow")) & (F.col("d.name") == F.col("_name")), "left")
    own, detailed = F.col("_name").isNotNull(), F.col("d").isNotNull()
    condition = F.regexp_replace(F.coalesce("d.expression", F.lit("")), "([<>=!]+)", "$1 ")
    said = F.trim(F.concat_ws(" ", F.nullif(F.coalesce("d.name", F.lit("")), F.lit("")), F.nullif(condition, F.lit(""))))
    return failed.unionByName(rows.select(
        "flow", "rule", "description", "severity", F.when(own, F.col("d.name")).otherwise(F.col("flow").cast("string")).alias("element_name"),
        F.when(own, F.coalesce("d.label", "_label")).otherwise(F.col("flow_label")).alias("element_label"), F.when(own, F.coalesce("d.type", F.lit("Unknown"))).otherwise("Flow").alias("element_type"),
        F.when(own, F.coalesce("d.expression", F.lit(""))).when(detailed, said).otherwise(F.col("description")).alias("expression"),
    ))


def type_support(kind: Column, screens: Column, supported: Sequence[str], unsupported: Sequence[str]) -> Column:
    """(supported, shown, reason) of a type by its lists; a ``Flow`` with screens is supported, unless that type is denied."""
    screen = (kind == "Flow") & F.coalesce(screens, F.lit(False))
    denied, allowed = F.coalesce(kind.isin(*unsupported), F.lit(False)), F.coalesce(kind.isin(*supported) | screen, F.lit(False))
    reason = F.when(denied, "explicitly_unsupported").when(~allowed, "not_in_supported_list")
    return F.struct((~denied & allowed).alias("supported"), F.when(screen, "Screen Flow").otherwise(kind).alias("shown"), reason.alias("reason"))
