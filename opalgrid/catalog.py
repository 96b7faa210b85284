"""The catalog of objects and their relationships, and queries that follow relationship paths.

A path such as ``Customer.Nation.n_name`` is a chain of left outer equi-joins on foreign keys; each relationship of a
query is joined once, whatever number of its fields is named. Filters, groupings and orders are ordinary DataFrame
operations on the result, so that Catalyst pushes predicates and prunes columns down to the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``name``: of the relationship; ``target``: the object; ``own`` and ``other``: the key columns on both sides."""

    name: str
    target: str
    own: str
    other: str


@dataclass(frozen=True)
class ObjectDef:
    name: str
    label: str
    key_prefix: str
    parents: tuple[Relation, ...] = ()
    children: tuple[Relation, ...] = ()
    custom: tuple[str, ...] = ()
    deleted: str | None = None
    namespace: str = "data"


class Catalog:
    """Objects by name; names are not case-sensitive. Namespaces keep data and tooling objects apart."""

    def __init__(self, objects: Iterable[ObjectDef]):
        self.objects = {(o.namespace, o.name.lower()): o for o in objects}

    def get(self, name: str, namespace: str = "data") -> ObjectDef:
        try:
            return self.objects[namespace, name.lower()]
        except KeyError:
            raise LookupError(f"no object {name} in {namespace}") from None

    def by_prefix(self, prefix: str) -> ObjectDef | None:
        return next((o for o in self.objects.values() if o.key_prefix == prefix), None)

    def rows(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table: namespace, name, label, key_prefix."""
        return spark.createDataFrame([(n, o.name, o.label, o.key_prefix) for (n, _), o in self.objects.items()], "namespace string, name string, label string, key_prefix string")


CATALOG = Catalog(
    [
        ObjectDef("region", "Region", "0r0", children=(Relation("Nations", "nation", "r_regionkey", "n_regionkey"),)),
        ObjectDef("nation", "Nation", "0n0", (Relation("Region", "region", "n_regionkey", "r_regionkey"),), (Relation("Customers", "customer", "n_nationkey", "c_nationkey"), Relation("Suppliers", "supplier", "n_nationkey", "s_nationkey"))),
        ObjectDef("customer", "Customer", "001", (Relation("Nation", "nation", "c_nationkey", "n_nationkey"),), (Relation("Orders", "orders", "c_custkey", "o_custkey"),), ("c_acctbal", "c_mktsegment")),
        ObjectDef("supplier", "Supplier", "00v", (Relation("Nation", "nation", "s_nationkey", "n_nationkey"),)),
        ObjectDef("part", "Part", "01t", children=(Relation("LineItems", "lineitem", "p_partkey", "l_partkey"),)),
        ObjectDef("orders", "Order", "006", (Relation("Customer", "customer", "o_custkey", "c_custkey"),), (Relation("LineItems", "lineitem", "o_orderkey", "l_orderkey"),), ("o_orderpriority",)),
        ObjectDef("lineitem", "Line Item", "00k", (Relation("Order", "orders", "l_orderkey", "o_orderkey"), Relation("Part", "part", "l_partkey", "p_partkey"), Relation("Supplier", "supplier", "l_suppkey", "s_suppkey"))),
        ObjectDef("events", "Event", "e00"),
        ObjectDef("documents", "Document", "0d0", children=(Relation("Labels", "labels", "doc_id", "doc_id"),)),
        ObjectDef("labels", "Label", "0l0", (Relation("Document", "documents", "doc_id", "doc_id"),)),
        ObjectDef("pages", "Page", "0p0"),
        ObjectDef("events", "Event log", "07L", namespace="tooling"),
        ObjectDef("part", "Layout", "00h", namespace="tooling", custom=("p_type",)),
        ObjectDef("customer", "Customer with closed accounts", "001", deleted="c_acctbal < 0", namespace="archive"),
    ]
)


class ObjectQuery:
    """One object's rows, with fields of its parents and lists of its children as asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, catalog: Catalog = CATALOG, namespace: str = "data", all_rows: bool = False):
        self.spark, self.sf_dir, self.catalog = spark, sf_dir, catalog
        self.object = catalog.get(name, namespace)
        self.frame = self._scan(self.object, all_rows)
        self._joined: dict[str, ObjectDef] = {"": self.object}

    def _scan(self, obj: ObjectDef, all_rows: bool = False) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{obj.name}.parquet")
        return df if all_rows or obj.deleted is None else df.filter(~F.coalesce(F.expr(obj.deleted), F.lit(False)))

    def fields(self, which: str = "ALL") -> list[str]:
        """Own fields: ALL, STANDARD or CUSTOM."""
        own = self._scan(self.object, True).columns
        return [c for c in own if which == "ALL" or (c in self.object.custom) == (which == "CUSTOM")]

    def matching(self, term: str) -> list[str]:
        """Own fields whose name holds the term, in any case."""
        return [c for c in self.fields() if term.lower() in c.lower()]

    def col(self, path: str) -> Column:
        """The column of a path, joining the parents on the way that are not joined yet."""
        *names, field = path.split(".")
        at = ""
        for name in names:
            parent = next((r for r in self._joined[at].parents if r.name.lower() == name.lower()), None)
            if parent is None:
                raise LookupError(f"{self._joined[at].name} has no relationship {name}")
            prefix = f"{at}{parent.name}."
            if prefix not in self._joined:
                target = self.catalog.get(parent.target)
                right = self._scan(target)
                right = right.select([F.col(c).alias(f"{prefix}{c}") for c in right.columns])
                self.frame = self.frame.join(right, F.col(f"`{at}{parent.own}`") == F.col(f"`{prefix}{parent.other}`"), "left")
                self._joined[prefix] = target
            at = prefix
        return F.col(f"`{at}{field}`")

    def cols(self, *paths: str) -> list[Column]:
        return [self.col(p) for p in paths]

    def children(self, name: str, fields: Sequence[str], order: Sequence[Column] = (), limit: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows with an array column, named as the relationship, of each row's children (none: null)."""
        rel = next((r for r in self.object.children if r.name.lower() == name.lower()), None)
        if rel is None:
            raise LookupError(f"{self.object.name} has no child relationship {name}")
        kids = self._scan(self.catalog.get(rel.target))
        kids = kids if where is None else kids.filter(where)
        if limit is not None:
            w = Window.partitionBy(rel.other).orderBy(*(order or [F.col(fields[0])]))
            kids = kids.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit)
        listed = kids.groupBy(F.col(rel.other).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(rel.name))
        return self.frame.join(listed, F.col(rel.own) == F.col("_key"), "left").drop("_key")


def polymorphic(df: DataFrame, key: str, kind: str, targets: dict[str, tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """A parent of several kinds: per kind (frame, its key, its field), the field of whichever parent fits."""
    out, found = df, []
    for k, (frame, own, field) in targets.items():
        right = frame.select(F.col(own).alias(f"_{k}_key"), F.col(field).alias(f"_{k}_value"))
        out = out.join(right, (F.col(kind) == k) & (F.col(key) == F.col(f"_{k}_key")), "left")
        found.append(F.col(f"_{k}_value"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"_{k}_{x}" for k in targets for x in ("key", "value")])


def search(spark: SparkSession, sf_dir: str, term: str, returning: dict[str, Sequence[str]], limit: int | None = None) -> DataFrame:
    """Text search: rows of every named object with a named field that holds the term, in any case, as (object, id, text)."""
    out = None
    for name, fields in returning.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        hit = F.lit(False)
        for f in fields[1:]:
            hit = hit | F.contains(F.lower(F.col(f)), F.lit(term.lower()))
        rows = df.filter(hit).select(F.lit(name).alias("object"), F.col(fields[0]).cast("string").alias("id"), F.concat_ws(" | ", *fields[1:]).alias("text"))
        rows = rows if limit is None else rows.orderBy("id").limit(limit)
        out = rows if out is None else out.unionByName(rows)
    return out


def run_plan(spark: SparkSession, sf_dir: str, plan: Sequence[Mapping], most: int = 8, catalog: Catalog = CATALOG) -> list[tuple[str, DataFrame]]:
    """The queries of a declarative plan, by object name: ``object``, ``fields`` and ``where`` (field: value).

    At most ``most`` (1 to 12) queries are kept. An object that the catalog does not know drops its query, an unknown
    field is left out; a query without known fields has all of them.
    """
    out: list[tuple[str, DataFrame]] = []
    for step in plan:
        try:
            q = ObjectQuery(spark, sf_dir, step["object"], catalog)
        except LookupError:
            continue
        rows, known = q.frame, set(q.fields())
        for name, value in step.get("where", {}).items():
            rows = rows.filter(F.col(name) == value) if name in known else rows
        out.append((step["object"], rows.select(*[f for f in step.get("fields", ()) if f in known] or ["*"])))
    return out[: max(1, min(12, most))]
