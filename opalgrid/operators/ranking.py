"""Windows, ranked search and typed sorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_latest(df: DataFrame, entity: str, version: str, active: str, history: int | None) -> DataFrame:
    """Versions with a ``keep`` flag: the newest ``history`` + 1 of each entity and its active one; no history keeps all."""
    if history is None or history < 0:
        return df.withColumn("keep", F.lit(True))
    w = Window.partitionBy(entity).orderBy(F.desc(version))
    return df.withColumn("keep", (F.row_number().over(w) <= history + 1) | F.coalesce(F.col(active), F.lit(False)))


def grouped_members(df: DataFrame, level: str, levels: Sequence[str], rule: str, *order: str) -> DataFrame:
    """Rows sorted by level (in the order of ``levels``, others last), rule and ``order``: place, level, rule, n, order's columns.

    ``n`` is the size of the group. Counts are made before rows are shuffled and joined to the rows, so that no group is gathered;
    a group that holds much of the table is split by the join, as any skewed key is.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col(level)), F.lit(0)).cast("int") - 1
    rows = df.withColumn("place", F.when(place < 0, len(levels)).otherwise(place))
    sizes = rows.groupBy(F.col(level).alias("_level"), F.col(rule).alias("_rule")).agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(sizes, F.col(level).eqNullSafe(F.col("_level")) & F.col(rule).eqNullSafe(F.col("_rule")))
    return out.select("place", level, rule, "n", *order).orderBy("place", rule, *order)


def recent_history(df: DataFrame, owner: str, key: str, at: str, most: int) -> DataFrame:
    """A bounded history per owner: equal entries once, newest first, at most ``most``."""
    last = df.groupBy(owner, key).agg(F.max(at).alias(at))
    w = Window.partitionBy(owner).orderBy(F.desc(at), key)
    return last.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def _ranged(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``_range``, the number of the range that their numeric key falls into (nulls: the first), ``_part`` and ``_tie``.

    The driver sees the ends of the ranges only, so that counts and numbers rest on the same ends. A key that fills
    a range or more is the end of several ranges: its rows are the last of their range and are split into parts by a hash of
    the whole row, which orders equal keys.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000), F.count(F.lit(1)), F.count(key)).first()
    ends, nulls = ends[0] or [], ends[1] - ends[2] > ends[1] / n
    heavy = sorted({e for e, nxt in zip(ends, ends[1:], strict=False) if e == nxt})
    ends = sorted(set(ends))
    # a key's range is the number of ends below it
    at = F.coalesce(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(key))), F.lit(-1)) if ends else F.lit(0)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    many = (F.col(key).isin(heavy) if heavy else F.lit(False)) | (F.col(key).isNull() & F.lit(bool(nulls)))
    return df.withColumn("_range", at).withColumn("_tie", tie).withColumn("_part", F.when(F.coalesce(many, F.lit(False)), F.pmod("_tie", F.lit(n)) + 1).otherwise(0))


def ordinals(df: DataFrame, key: str, name: str = "ordinal", within: Sequence[str] = ()) -> DataFrame:
    """Rows with their place from 0 in the order of a numeric key (nulls first), without gathering them.

    With ``within``, places start anew in each group, null being one; a group as large as the table is still split by
    ranges, and rows with one key by a hash. Equal keys are ordered by that hash of the row, so that a rerun gives the same
    places; only rows that are equal in every column are told apart by chance. Ranges are counted, running offsets go over
    one row per range and group, and a window numbers each range.
    """
    ranged = _ranged(df, key)
    per = ranged.groupBy(*within, "_range", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_range").alias("_r"), F.col("_part").alias("_q"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*within, "_range", "_part").orderBy(key, "_tie")) - 1
    same = (F.col("_range") == F.col("_r")) & (F.col("_part") == F.col("_q")) & reduce(and_, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)], F.lit(True))
    offsets = offsets if within else F.broadcast(offsets)  # without groups a row per range and part
    out = ranged.withColumn("_place", place).join(offsets, same)
    return out.select(*df.columns, (F.col("_offset") + F.col("_place")).alias(name))


def batches(df: DataFrame, key: str, size: int, within: Sequence[str]) -> DataFrame:
    """Rows with the number of their batch of ``size`` within each group, in the order of a numeric key."""
    return ordinals(df, key, "batch", within).withColumn("batch", F.floor(F.col("batch") / size))


#: Letters in the order of the Unicode root, in any case and with any accent.
ANY_CASE_AND_ACCENT = "UNICODE_CI_AI"


def match_tier(value: Column, title: Column, term: str, collation: str | None = None) -> Column:
    """1 to 8: equal value, equal title, value prefix, title prefix, after two underscores, after one, a later word, other.

    Compared in any case, or under a collation.
    """
    fold = (lambda c: F.collate(c, collation)) if collation else F.lower
    v, t, x = fold(value), fold(title), term if collation else term.lower()
    inside = lambda c, mark: F.contains(c, fold(F.lit(mark + x)))
    tests = (v == x, t == x, F.startswith(v, fold(F.lit(x))), F.startswith(t, fold(F.lit(x))), inside(v, "__"), inside(v, "_"), inside(t, " "))
    out = F.lit(8)
    for i, test in reversed(list(enumerate(tests))):
        out = F.when(test, F.lit(i + 1)).otherwise(out)
    return out


def locale_sort(df: DataFrame, column: str, *ties: str, locale: str = "UNICODE", descending: bool = False) -> DataFrame:
    """Sorted as a reader of a language expects; null counts as empty. Texts that the locale holds equal go by ``ties``."""
    text = F.collate(F.coalesce(F.col(column), F.lit("")), locale)
    return df.orderBy(text.desc() if descending else text.asc(), *ties)


def object_tier(prefix: Column, name: Column, label: Column, apis: Column, term: str) -> Column:
    """2 to 10 for a searched object: key prefix, name, label, their prefixes, inner parts; 20 more where no API serves it."""
    p, n, t, x = F.lower(prefix), F.lower(name), F.lower(label), term.lower()
    tests = (p == x[:3], n == x, t == x, n.startswith(x), t.startswith(x), F.contains(n, F.lit("__" + x)), F.contains(n, F.lit("_" + x)), F.contains(t, F.lit(" " + x)))
    out = F.lit(10)
    for i, test in reversed(list(enumerate(tests))):
        out = F.when(test, F.lit(i + 2)).otherwise(out)
    return out + F.when(F.size(apis) > 0, 0).otherwise(20)


def search_score(name: Column, label: Column, term: str) -> Column:
    """4 equal, 3 prefix, 2 inside, else 0: the better of name and label."""
    def one(c: Column) -> Column:
        low, x = F.lower(c), term.lower()
        return F.when(low == x, 4).when(low.startswith(x), 3).when(F.contains(low, F.lit(x)), 2).otherwise(0)

    return F.greatest(one(name), one(label))


def auto_sort(df: DataFrame, column: str, descending: bool = False, locale: str | None = None) -> DataFrame:
    """Sorted as numbers if every value is blank, ``Error`` or a number and one is a number; else as text, by a locale if
    one is given.

    One aggregate decides. Blanks are last in both directions as numbers; as text null counts as empty.
    """
    c = F.col(column)
    number = F.regexp_extract(c, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    blank = c.isNull() | c.isin("", "Error")
    kind = df.agg(F.bool_and(blank | number.isNotNull()), F.bool_or(number.isNotNull())).first()
    if kind[0] and kind[1]:
        return df.orderBy(number.desc_nulls_last() if descending else number.asc_nulls_last())
    text = F.collate(F.coalesce(c, F.lit("")), locale) if locale else F.coalesce(c, F.lit(""))
    return df.orderBy(text.desc() if descending else text.asc())
