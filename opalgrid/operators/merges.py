"""Keyed merges of overlapping sources, and changes to tables as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.text import last_of_each
from opalgrid.operators.ranking import ordinals


def merge_sources(sources: Sequence[DataFrame], key: str, texts: Sequence[str], flags: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """One row per key over ranked sources: of each text the last that is not empty, flags or-ed, source names collected.

    A later source outranks an earlier one. One shuffle by key, whatever the number of sources.
    """
    ranked = None
    for rank, df in enumerate(sources):
        cols = [F.col(key), *[(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in texts]]
        cols += [(F.col(c) if c in df.columns else F.lit(None)).cast("boolean").alias(c) for c in flags]
        one = df.select(*cols, F.lit(rank).alias("_rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    aggs = [F.max(F.when(F.col(c) != "", F.struct("_rank", c)))[c].alias(c) for c in texts]
    aggs += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    return ranked.groupBy(key).agg(*aggs, F.array_sort(F.collect_set("_rank")).alias(name or "sources"))


def full_merge(left: DataFrame, right: DataFrame, key: str, prefer: Mapping[str, str]) -> DataFrame:
    """Full outer merge by key; ``prefer`` says per column whether the ``left`` or the ``right`` value comes first."""
    a, b = left.alias("a"), right.alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c, first in prefer.items():
        sides = [F.col(f"{s}.{c}") for s, df in (("a", left), ("b", right)) if c in df.columns]
        cols.append(F.coalesce(*(sides if first == "left" else sides[::-1])).alias(c))
    return out.select(*cols)


def upsert(current: DataFrame, changes: DataFrame, key: str, insert: bool = True, update: bool = True) -> DataFrame:
    """Rows after an import: changed columns replaced, and new keys added; a blank cell sets null."""
    a, b = current.alias("a"), changes.withColumn("_is", F.lit(True)).alias("b")
    out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer" if insert else "left")
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    old = F.col(f"a.{key}").isNotNull()
    use = F.col("b._is") & (~old | F.lit(update))
    for c in current.columns:
        if c != key:
            cols.append((F.when(use, F.nullif(F.trim(F.col(f"b.{c}").cast("string")), F.lit("")).cast(current.schema[c].dataType)).otherwise(F.col(f"a.{c}")) if c in changes.columns else F.col(f"a.{c}")).alias(c))
    return out.select(*cols)


def status_of(c: Column) -> Column:
    """The status of an imported row: blank, queued and (when idle) processing wait; unknown words have failed."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.isin("", "queued", "processing"), "Queued").when(low == "succeeded", "Succeeded").otherwise("Failed")


def header_options(text: Column, mark: str) -> Column:
    """The URL-encoded options of a text whose first row begins with ``mark=``, as a map; null where there are none.

    The last of repeated options counts.
    """
    first = F.trim(F.get(F.split(text, "\r?\n"), F.lit(0)))
    pairs = F.transform(F.split(first, "&"), lambda x: F.struct(F.try_url_decode(F.substring_index(x, "=", 1)).alias("name"), F.try_url_decode(F.regexp_replace(x, "^[^=]*=?", "")).alias("value")))
    return F.when(first.startswith(f"{mark}="), last_of_each(F.filter(pairs, lambda x: x["name"].isNotNull())))


def import_problems(header: Column, known: Sequence[str], required: Sequence[str], batch: Column, threads: Column) -> Column:
    """What keeps an import from running, or slows it: an array of texts, empty if all is well.

    Columns are checked in their order; those that start with an underscore are not imported. Names are compared in
    any case.
    """
    low = [k.lower() for k in known]
    wrong = lambda n: (
        F.when(~n.rlike(r"^[a-zA-Z_][\w.\-]*(:\w+:\w+)?$"), F.concat(n, F.lit(": Invalid field name"))).when(~n.startswith("_") & ~F.lower(n).isin(low), F.concat(n, F.lit(": Unknown field")))
    )
    held = F.transform(header, lambda n: F.lower(n))
    missing = [F.when(~F.array_contains(held, r.lower()), F.lit(f"{r}: Required field")) for r in required]
    settings = [F.when(~(F.coalesce(v, F.lit(0)) > 0), F.lit(f"{name}: Must be positive")) for name, v in (("batch size", batch), ("threads", threads))]
    return F.array_compact(F.concat(F.transform(header, wrong), F.array(*missing, *settings, F.when(threads > 6, F.lit("threads: More than 6 may be slower")))))


def import_batches(rows: DataFrame, order: str, size: int, failed: Column, stop_after: int = 3) -> DataFrame:
    """Queued rows in batches of ``size``; the queue stops after ``stop_after`` failed batches in a row.

    Batches are numbered from the order, a numeric column, by distributed ordinals; the ones behind the stop keep their
    rows queued. The window that looks for the stop runs over one row per batch.
    """
    numbered = ordinals(rows, order, "_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")
    per = numbered.groupBy("batch").agg(F.bool_or(failed).alias("_bad"))
    run = Window.orderBy("batch").rowsBetween(1 - stop_after, 0)
    per = per.withColumn("_stop", (F.sum(F.col("_bad").cast("int")).over(run) == stop_after).cast("int"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_stopped", F.coalesce(F.max("_stop").over(before), F.lit(0)) == 1)
    out = numbered.join(per, "batch")
    return out.withColumn("status", F.when(F.col("_stopped"), "Queued").when(F.col("_bad"), "Failed").otherwise("Succeeded")).drop("_bad", "_stop", "_stopped")
