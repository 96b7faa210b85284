"""Headers of imported tables: which cells set null, and references that name a parent by one of its other fields.

A header is a field (``Status``), a dotted path (``Owner.Name``) or a reference ``Relationship:Type:Field``, whose cells name
a parent of that type by that field. A reference writes ``RelationshipId``, or ``Name__c`` where the relationship is called
``Name__r``. Headers that begin with an underscore are not imported.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    """``field``: what a cell of the column writes; ``kind`` and ``by``: type and field of the parent, for references."""

    column: str
    field: str
    kind: str | None = None
    by: str | None = None


def parse_header(column: str) -> Header:
    name, *rest = column.split(":")
    if len(rest) == 2:
        return Header(column, f"{name[:-3]}__c" if name.endswith("__r") else f"{name}Id", *rest)
    return Header(column, name.split(".")[0])


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))) == ""


def null_fields(columns: Sequence[str], key: str) -> Column:
    """The fields that a row's blank cells set to null, in the order of the columns; the key is never among them."""
    heads = [parse_header(c) for c in columns if c.lower() != key.lower() and not c.startswith("_")]
    return F.array_compact(F.array(*[F.when(_blank(h.column), F.lit(h.field)) for h in heads]).cast("array<string>"))


def resolve_references(rows: DataFrame, key: str, parents: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    """``rows`` with a column per reference in place of its cells: the parent's key; with ``nulls`` and ``unresolved``.

    The cells of all reference columns go into one long table, the parents into another, and a single join on type,
    field and value finds them all, however many columns there are; conditional aggregates bring a row's parents
    together again. Values that name no parent, or several, leave the field null and are listed. ``key`` is a column whose
    values are unique in ``rows``; rows without a key are left as they are, their references unresolved.
    """
    heads = [parse_header(c) for c in rows.columns if not c.startswith("_")]
    refs = [h for h in heads if h.kind is not None and h.column != key]
    plain = [c for c in rows.columns if c not in {h.column for h in refs}]
    nulls = null_fields(rows.columns, key).alias("nulls")
    if not refs:
        return rows.select(*[F.col(f"`{c}`") for c in plain], nulls, F.array().cast("array<string>").alias("unresolved"))
    unknown = {h.kind for h in refs} - set(parents)
    if unknown:
        raise LookupError(f"no parents of type {', '.join(sorted(unknown))}")
    cells = [F.struct(F.lit(i).alias("_at"), F.lit(h.kind).alias("_kind"), F.lit(h.by).alias("_by"), F.col(f"`{h.column}`").cast("string").alias("_value")) for i, h in enumerate(refs)]
    long = rows.select(F.col(f"`{key}`").alias("_row"), F.inline(F.array(*cells))).filter(F.trim("_value") != "")
    named = None
    for kind in sorted({h.kind for h in refs}):
        fields = sorted({h.by for h in refs if h.kind == kind})
        pairs = F.array(*[F.struct(F.lit(f).alias("_by"), F.col(f"`{f}`").cast("string").alias("_value")) for f in fields])
        one = parents[kind].select(F.lit(kind).alias("_kind"), F.col(f"`{keys[kind]}`").cast("string").alias("_parent"), F.inline(pairs)).filter("_value IS NOT NULL")
        named = one if named is None else named.unionByName(one)
    named = named.groupBy("_kind", "_by", "_value").agg(F.min("_parent").alias("_parent"), F.count(F.lit(1)).alias("_n"))
    found = long.join(named, ["_kind", "_by", "_value"], "left").withColumn("_parent", F.when(F.col("_n") == 1, F.col("_parent")))
    picked = [F.max(F.when(F.col("_at") == i, F.col("_parent"))).alias(f"_r{i}") for i in range(len(refs))]
    missed = [F.max(F.when((F.col("_at") == i) & F.col("_parent").isNull(), F.concat(F.lit(f"{h.column}="), "_value"))).alias(f"_m{i}") for i, h in enumerate(refs)]
    back = found.groupBy("_row").agg(*picked, *missed)
    out = rows.select("*", nulls).join(back, F.col(f"`{key}`") == F.col("_row"), "left")
    unresolved = F.array_compact(F.array(*[f"_m{i}" for i in range(len(refs))])).alias("unresolved")
    return out.select(*[F.col(f"`{c}`") for c in plain], *[F.col(f"_r{i}").alias(h.field) for i, h in enumerate(refs)], "nulls", unresolved)


def edits(fields: Sequence[str], old: str, new: str, create: bool = False) -> Column:
    """What saving a form sends, as an array of (field, value): ``old`` and ``new`` are structs with the fields as texts.

    Only fields that were edited are sent; blank and null are alike. A field made blank is sent as null by an update, and
    a blank field is left out when a record is created.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    entries = []
    for f in fields:
        before, after = F.col(f"{old}.`{f}`").cast("string"), F.col(f"{new}.`{f}`").cast("string")
        sent = F.struct(F.lit(f).alias("field"), F.nullif(blank(after), F.lit("")).alias("value"))
        entries.append(F.when(blank(after) != "", sent) if create else F.when(blank(before) != blank(after), sent))
    return F.array_compact(F.array(*entries))
