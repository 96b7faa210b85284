"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected copies are its source's target over its source's
size (times its own relative weight, if one is given). The whole part is allocated outright; the fraction is the
inclusion probability p of one more copy. Documents are ranked by the Pareto key

    (u / (1 - u)) / (p / (1 - p)),      u uniform, from a digest of the seed and the id,

and taken in that order until the words that the source still lacks are filled: a sample of fixed size (in words) with
unequal inclusion probabilities. One closing document, the one whose size is nearest to what is left, ends the fill.

The order is never a window over a whole source. The key, mapped to (0, 1), is cut into fixed bins; the bins' sums
find the bin in which the fill ends, and only that bin's documents are ordered one by one. DataFrame operations only.

Rows that share id, source, size and weight are alike: they are counted first and dealt out again with a number each,
which enters the key of all but the first, so that repeated or null ids are ranked apart however many rows bear them.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of size 0 adds
nothing; ties are broken by id, size and number; repeated rows, and rows with a null id, are separate documents; texts of
any length are counted whole; an empty table gives an empty mix. Columns other than the named ones are not read, and
``apply_mix`` passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm.common import HOT_SHARE, WORD, free_name, lookup, materialize

BINS = 16384
MAX_COPIES = 2
#: Alike rows that are dealt out in one place.
TOGETHER = 4096
#: Parts of the rows of an id that holds over 1/HOT_SHARE of all.
SALTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, id_col: str, number: Column | None = None) -> Column:
    """A number in (0, 1) that depends on the seed, the id and, where it is not null, a further number."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own = own if number is None else F.concat(own, F.coalesce(F.concat(F.lit(":"), number), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, share: float, weights: Sequence[int]) -> DataFrame:
    """A row per source: source_size, documents, target.

    ``share`` of all words is dealt to the sources by weight; a target stops at MAX_COPIES times its source's size
    and the excess is dealt again. Sorted by the ratio at which a source is full, the full sources are a prefix, so
    the fixed point is the first level that its own source does not exceed. The window runs over one row per source.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_fill = Window.orderBy((MAX_COPIES * F.col("source_size") / F.col("_w")), F.col("_rank"))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = sizes.groupBy("_key", "_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    per = per.withColumn("_rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(MAX_COPIES * F.col("source_size")).over(before), F.lit(0))) / F.sum("_w").over(after)
    per = per.withColumn("_level", level).withColumn("_cap", MAX_COPIES * F.col("source_size"))
    per = per.withColumn("_place", F.row_number().over(by_fill))
    free = F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct("_place", "_level"))
    per = per.withColumn("_level", F.min(free).over(every)["_level"])
    return per.select("_key", "source_size", "_docs", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")), F.col("_cap").cast("double")).alias("target"))


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    seed: str = "mix",
) -> DataFrame:
    """A row per document: id, size, source_size, target (its source's), copies, taken (copies times size).

    ``weight_col`` names an optional positive relative weight; null counts as 1. No document gets more than
    MAX_COPIES copies.
    """
    done = _mixed(docs, share, weights, id_col, text_col, source_col, weight_col, seed)
    return done.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def source_key(source_col: str) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """The rows with ``_k``, their number among the rows that are alike, from 0; many alike rows are spread over tasks."""
    alike = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("_n"))
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df, first, rows: df.select(*sizes.columns, F.explode(F.sequence(first, first + rows - 1)).alias("_k"))
    few = deal(alike.filter(F.col("_n") <= TOGETHER), F.lit(0).cast("long"), F.col("_n"))
    many = alike.filter(F.col("_n") > TOGETHER).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / TOGETHER)))).repartition(n)
    return few.unionByName(deal(many, F.col("_block") * TOGETHER, F.least(F.lit(TOGETHER), F.col("_n") - F.col("_block") * TOGETHER)))


def _mixed(docs: DataFrame, share: float, weights: Sequence[int], id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: str) -> DataFrame:
    """A row per document: _id, _key (its source), size, source_size, target, copies."""
    source = F.col(source_col).cast("string")
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    sizes = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        source.alias("_source"),
        source_key(source_col).alias("_key"),
        word_count(F.col(text_col)).alias("size"),
        weight.alias("_weight"),
    )
    sizes = materialize(_numbered(sizes), "sizes")
    total = sizes.count()
    targets = materialize(source_targets(sizes, share, weights), "targets")
    means = sizes.groupBy("_key").agg((F.try_divide(F.sum(F.col("size") * F.col("_weight")), F.sum("size"))).alias("_mean"))
    targets = materialize(targets.join(means, "_key"), "means")

    rows = lookup(sizes, targets, "_key", "_docs", total)
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")) * F.try_divide(F.col("_weight"), F.col("_mean")), F.lit(0.0))
    rows = rows.withColumn("_expected", F.least(expected, F.lit(float(MAX_COPIES))))
    rows = rows.withColumn("_whole", F.floor("_expected")).withColumn("_p", F.col("_expected") - F.floor("_expected"))
    u = uniform(seed, "_id", F.when(F.col("_k") > 0, F.concat_ws(":", F.col("size").cast("string"), F.col("_k").cast("string"))))
    ratio = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_place", F.when(F.col("_p") > 0, ratio / (1 + ratio)).otherwise(F.lit(1.0)))
    rows = rows.withColumn("_bin", F.least(F.floor(F.col("_place") * BINS), F.lit(BINS)).cast("int"))
    rows = materialize(rows.select("_id", "_key", "_k", "_weight", "size", "source_size", "_docs", "target", "_whole", "_place", "_bin"), "ranked")

    whole = rows.groupBy("_key").agg(F.sum(F.col("size") * F.col("_whole")).alias("_given"))
    lack = F.greatest(F.col("target") - F.col("_given"), F.lit(0.0))
    open_rows = F.col("_whole") < MAX_COPIES
    bins = rows.filter(open_rows).groupBy("_key", "_bin").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bin"))
    bins = bins.withColumn("_upto", upto).join(targets.select("_key", "target", "_docs").join(whole, "_key").withColumn("_lack", lack), "_key")
    inside = F.col("_upto") <= F.col("_lack")
    ends = bins.groupBy("_key").agg(
        F.coalesce(F.min(F.when(~inside, F.col("_bin"))), F.lit(BINS + 1)).alias("_end"),
        F.coalesce(F.max(F.when(inside, F.col("_upto"))), F.lit(0)).alias("_before"),
        F.first("_lack").alias("_lack"),
        F.first("_docs").alias("_n"),
    )
    ends = materialize(ends, "ends")
    marked = lookup(rows.drop("_docs"), targets.select("_key", "_docs").join(ends.drop("_n"), "_key", "left").withColumn("_end", F.coalesce("_end", F.lit(-1))), "_key", "_docs", total)
    last = marked.filter(open_rows & (F.col("_bin") == F.col("_end")))
    running = F.sum("size").over(Window.partitionBy("_key", "_bin").orderBy("_place", "_id", "size", "_k", "_weight").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_extra", (F.col("_before") + running <= F.col("_lack")).cast("int"))
    rest = marked.filter(~(open_rows & (F.col("_bin") == F.col("_end"))))
    rest = rest.withColumn("_extra", (open_rows & (F.col("_bin") < F.col("_end"))).cast("int"))
    marked = materialize(last.unionByName(rest), "marked")

    filled = marked.groupBy("_key").agg((F.first("_lack") - F.sum(F.col("size") * F.col("_extra"))).alias("_left"))
    per = filled.join(targets.select("_key", "_docs"), "_key")
    left_over = lookup(marked.drop("_docs"), per, "_key", "_docs", total)
    gap = F.abs(F.col("size") - F.col("_left"))
    fits = open_rows & (F.col("_extra") == 0) & (gap < F.abs(F.col("_left")))
    closing = left_over.filter(fits).groupBy("_key").agg(F.min(F.struct(gap.alias("gap"), "_place", "_id", "size", "_k", "_weight")).alias("_close"))
    closing = per.join(closing, "_key", "left").select("_key", "_docs", "_close")
    done = lookup(marked.drop("_docs"), closing, "_key", "_docs", total)
    same = [F.col(c).eqNullSafe(F.col(f"_close.{c}")) for c in ("_id", "size", "_k", "_weight")]
    is_closing = (F.col("_extra") == 0) & open_rows & F.col("_close").isNotNull() & reduce(and_, same)
    copies = F.col("_whole") + F.col("_extra") + is_closing.cast("int")
    return done.select("_id", "_key", "size", "source_size", "target", copies.cast("long").alias("copies"))


def apply_mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: each document's row as often as it was taken, with its columns unchanged, whatever their names.

    Rows that share id, source and size are dealt the copies that were taken of them together. The rows of an id that
    very many rows bear (null, say) are dealt by their sizes and by parts, a part being the rows with like hashes of
    their texts; the parts' numbers of rows say where each begins.
    """
    given, key, size, rows, total, place, copy, salt, part, first = (free_name(docs, x) for x in ("id", "key", "size", "rows", "total", "place", "copy", "salt", "part", "first"))
    mixed = _mixed(docs, share, weights, id_col, text_col, source_col, weight_col, seed)
    named = lambda c: F.coalesce(F.concat(F.lit("d"), F.col(c).cast("long").cast("string")), F.lit("n"))
    taken = mixed.groupBy(named("_id").alias(given), F.col("_key").alias(key), F.col("size").alias(size)).agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(total))
    taken = materialize(taken, "taken")
    every = taken.agg(F.sum(rows)).first()[0] or 0
    hot = [r[given] for r in taken.groupBy(given).agg(F.sum(rows).alias(rows)).filter(F.col(rows) * HOT_SHARE > max(every, HOT_SHARE * TOGETHER)).collect()]  # at most HOT_SHARE
    is_hot = F.col(given).isin(hot) if hot else F.lit(False)
    rows_of = docs.withColumn(given, named(id_col)).withColumn(key, source_key(source_col))
    # a hot id's rows know their size before they are joined; the sizes of others are counted only where an id has several
    rows_of = rows_of.withColumn(part, F.when(is_hot, word_count(F.col(text_col))).otherwise(F.lit(-1)))
    rows_of = rows_of.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(text_col), F.lit(SALTS))).otherwise(F.lit(0)))
    alone = F.count(F.lit(1)).over(Window.partitionBy(given, key)) == 1
    cold = taken.filter(~is_hot).withColumn(place, alone).filter(F.col(total) > 0).select("*", F.lit(-1).cast("long").alias(part), F.lit(0).cast("long").alias(salt), F.lit(0).cast("long").alias(first))
    dealt = cold
    if hot:
        parts = rows_of.filter(is_hot).groupBy(given, key, part, salt).agg(F.count(F.lit(1)).alias(copy))
        before = Window.partitionBy(given, key, part).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(given, key, part, salt, F.coalesce(F.sum(copy).over(before), F.lit(0)).alias(first)).withColumn(size, F.col(part))
        dealt = cold.unionByName(taken.filter(is_hot).filter(F.col(total) > 0).withColumn(place, F.lit(True)).join(parts, [given, key, size]).select(cold.columns))
    joined = rows_of.join(dealt, [given, key, part, salt])
    joined = joined.filter(F.col(place) | (F.col(size) == word_count(F.col(text_col))))
    at = F.col(first) + F.row_number().over(Window.partitionBy(given, key, part, salt, size).orderBy(F.xxhash64(text_col)))
    joined = joined.withColumn(place, at)
    times = F.floor(F.col(total) / F.col(rows)) + (F.col(place) <= F.col(total) % F.col(rows)).cast("int")
    repeated = F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))).alias(copy)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], repeated).drop(copy)
