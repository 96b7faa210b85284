"""URL filters: longest matching rule, and a Bloom filter cascade for a list of keys.

The cascade answers exactly, for every key of a known universe, whether the key is listed. Level 1 is a Bloom filter of
the listed keys; level 2 one of the unlisted keys that pass level 1; level 3 one of the listed keys that pass level 2;
and so on until nothing passes wrongly. The universe is cut into shards by key hash, each of about ``shard_keys`` keys; a
group task builds a shard's levels. Cascades of up to ``max_broadcast`` bytes together are broadcast; beyond that the
distinct keys meet their shard's cascade in a co-group and the pages then look their key up.

Defined results: a null url, or one without ``://``, has an empty host and path and meets no rule; repeated urls get
equal verdicts; null ids are passed on; an empty table gives no rows, an empty list blocks nothing by itself. Only the id
and the url are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.llm.common import LOWER, UPPER, lookup, materialize

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHARD_KEYS = 500_000
MAX_BROADCAST = 64 << 20
CASCADE = "shard int, level int, bits long, hashes int, filter binary"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host from the first ``://``, A-Z lower-cased."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _places(h1: Any, h2: Any, level: int, bits: int, hashes: int) -> Any:
    """Bit positions, one row per hash: double hashing of two hashes that are mixed anew for every level, so that keys
    that collide on one level do not on the next."""
    import numpy as np

    def mixed(h: Any, salt: int) -> Any:
        h = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    with np.errstate(over="ignore"):
        both = mixed(h1, 2 * level) ^ h2
        first, step = mixed(both, 2 * level + 1) >> np.uint64(1), mixed(both, 2 * level + 2) >> np.uint64(1)
        return np.array([(first + step * np.uint64(i)) % np.uint64(bits) for i in range(hashes)])


def _passes(filter_bits: Any, places: Any) -> Any:
    import numpy as np

    return np.logical_and.reduce((filter_bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1, axis=0).astype(bool)


def build_levels(h1: Any, h2: Any, listed: Any) -> list[tuple[int, int, int, bytes]]:
    """The levels (level, bits, hashes, filter) of one shard, from unsigned hashes and flags of distinct keys."""
    import numpy as np

    inside, outside, out, level = np.flatnonzero(listed), np.flatnonzero(~listed), [], 1
    while len(inside):
        rate = min(0.5, max(1e-6, len(inside) / max(1, len(outside)) / 2**0.5)) if level == 1 else 0.5
        bits = max(64, ceil(-len(inside) * log(rate) / log(2) ** 2))
        hashes = max(1, round(bits / len(inside) * log(2))) if len(inside) * 16 > bits else 8
        array = np.zeros((bits + 7) // 8, dtype=np.uint8)
        at = _places(h1[inside], h2[inside], level, bits, hashes).ravel()
        np.bitwise_or.at(array, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        out.append((level, bits, hashes, array.tobytes()))
        wrong = outside[_passes(array, _places(h1[outside], h2[outside], level, bits, hashes))] if len(outside) else outside
        inside, outside, level = wrong, inside, level + 1
        if level > 200:
            raise ValueError("two keys of a shard have equal hashes but differ in being listed")
    return out


def ask_levels(h1: Any, h2: Any, levels: list[tuple[int, int, int, bytes]]) -> Any:
    """Whether each key, of the universe that the levels were built for, is listed."""
    import numpy as np

    answer, still = np.zeros(len(h1), dtype=bool), np.arange(len(h1))
    for level, bits, hashes, raw in sorted(levels):
        array = np.frombuffer(raw, dtype=np.uint8)
        still = still[_passes(array, _places(h1[still], h2[still], level, bits, hashes))] if len(still) else still
        answer[still] = level % 2 == 1
    return answer


def _hashed(key: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(key)), F.xxhash64(F.lit("second"), F.col(key))


def build_cascades(universe: DataFrame, shards: int) -> DataFrame:
    """The levels of all shards. ``universe``: distinct ``key`` with ``listed``."""
    h1, h2 = _hashed("key")
    rows = universe.select(h1.alias("h1"), h2.alias("h2"), "listed").withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(group["h1"].to_numpy().view("uint64"), group["h2"].to_numpy().view("uint64"), group["listed"].to_numpy(dtype=bool))
        return pd.DataFrame([(group["shard"].iloc[0], *x) for x in levels], columns=["shard", "level", "bits", "hashes", "filter"])

    return rows.groupBy("shard").applyInPandas(build, CASCADE)


def listed_flags(pages: DataFrame, universe: DataFrame, key: str, shard_keys: int = SHARD_KEYS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``pages`` with a boolean ``listed`` for ``key``. ``universe``: distinct ``key``, ``listed`` and its ``pages``."""
    universe = materialize(universe, "universe")
    shards = max(1, ceil(universe.count() / shard_keys))
    cascades = materialize(build_cascades(universe.select("key", "listed"), shards), "cascades")
    size = cascades.agg(F.sum(F.length("filter"))).first()[0] or 0
    if size > max_broadcast:
        return _flags_by_cogroup(pages, universe, cascades, key, shards)
    levels: dict[int, list] = {}
    for r in cascades.collect():
        levels.setdefault(r["shard"], []).append((r["level"], r["bits"], r["hashes"], bytes(r["filter"])))
    shared = pages.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf(T.BooleanType())
    def ask(h1: pd.Series, h2: pd.Series) -> pd.Series:
        import numpy as np

        a, b = h1.to_numpy(dtype="int64").view("uint64"), h2.to_numpy(dtype="int64").view("uint64")
        out, shard = np.zeros(len(a), dtype=bool), (h1.to_numpy(dtype="int64") % shards)
        for s, own in shared.value.items():
            at = np.flatnonzero(shard == s)
            out[at] = ask_levels(a[at], b[at], own)
        return pd.Series(out)

    return pages.withColumn("listed", ask(*_hashed(key)))


def _flags_by_cogroup(pages: DataFrame, universe: DataFrame, cascades: DataFrame, key: str, shards: int) -> DataFrame:
    h1, h2 = _hashed("key")
    keys = universe.select("key", "pages", h1.alias("h1"), h2.alias("h2"), F.pmod(h1, F.lit(shards)).cast("int").alias("shard"))

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        levels = list(right[["level", "bits", "hashes", "filter"]].itertuples(index=False, name=None))
        found = ask_levels(left["h1"].to_numpy(dtype="int64").view("uint64"), left["h2"].to_numpy(dtype="int64").view("uint64"), levels)
        return pd.DataFrame({"key": left["key"], "pages": left["pages"], "listed": found})

    known = keys.groupBy("shard").cogroup(cascades.groupBy("shard")).applyInPandas(ask, "key string, pages long, listed boolean")
    known = materialize(known, "known").withColumnRenamed("key", key)
    return lookup(pages, known, key, "pages", pages.count()).drop("pages")


def covered_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct ``key`` of the hosts that a listed key (A-Z lower-cased) names, or whose parent domain it names.

    Only parents with as many labels as some listed key has are looked up, so that the top domains, under which nearly
    all hosts lie, are no keys of the join unless one of their length is listed. The driver sees those lengths alone.
    """
    named = listed.select(F.translate("key", UPPER, LOWER).alias("_named")).filter("_named IS NOT NULL").distinct()
    lengths = [r[0] for r in named.select(F.size(F.split("_named", r"\."))).distinct().collect()]
    labels = F.split("key", r"\.")
    starts = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (F.size(labels) - i + 1).isin(lengths))
    parents = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("key", F.explode(parents).alias("_named")).join(named, "_named", "left_semi").select("key").distinct()


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", **how: int) -> DataFrame:
    """A row per page: id, host, path, rule, verdict.

    ``listed`` is a table with a column ``key`` of hosts, each standing for its subdomains too; where no rule fits, a
    listed host is blocked. The list is joined with the distinct hosts once, when the cascade is built.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hosts = materialize(rows.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("pages")), "hosts")
    covered = covered_hosts(hosts, listed).withColumn("listed", F.lit(True))
    universe = hosts.join(covered, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = listed_flags(rows, universe, "host", **how)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
