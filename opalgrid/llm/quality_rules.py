"""Quality rules: decision lists learned by sequential covering from labelled statistics.

Statistics of each text are computed by SQL functions. Rules that reject are grown one by one on two thirds of the
labelled rows: a conjunction gains the threshold with the best FOIL gain until it covers no good row; on the other
third its tail is pruned; it is accepted if it is precise enough there. What an accepted rule covers is removed and the
next one is grown. The list is applied as one ordered CASE expression. Each step is an aggregate; the driver sees only
counts per feature, threshold and label. DataFrame operations only.

Defined results: a null text has no words and fails the base rule; a null label is not learned from; an id labelled
twice counts with its largest label; with no labels no rule is learned and the base rule alone decides; repeated rows
get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import GAP, doc_crc, materialize, text_of

SPAN = 8
FEATURES = ("symbol_rate", "upper_rate", "dup_line_rate", "repeat_rate", "word_length", "n_words")
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99)
MAX_RULES, MAX_CONDITIONS, PRECISION, LEAST = 8, 3, 0.95, 5


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: _id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines, _upper."""
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    df = df.select(
        "_id",
        F.array_remove(F.split(text, GAP), "").alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("_upper"),
    )
    n = F.size("_w")
    windows = F.when(n >= SPAN, F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.xxhash64(F.slice("_w", i, SPAN)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "_id", "word_chars", "n_symbols", "_upper", n.cast("long").alias("n_words"), F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), windows.alias("_h"),
    )
    placed = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", placed).drop("_h")
    # walking the sorted windows, a run of equal hashes keeps all its places
    twice = F.filter("_s", lambda s, k: (F.get("_s", k - 1)["h"].eqNullSafe(s["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(s["h"])))
    places = F.sort_array(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-SPAN).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(SPAN), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), covered), F.lit(0).cast("long"))).drop("_s")


def with_rates(stats: DataFrame) -> DataFrame:
    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return (
        stats.withColumn("symbol_rate", rate("n_symbols", "word_chars"))
        .withColumn("upper_rate", rate("_upper", "word_chars"))
        .withColumn("dup_line_rate", rate("n_dup_lines", "_lines"))
        .withColumn("repeat_rate", rate("n_repeat_words", "n_words"))
        .withColumn("word_length", rate("word_chars", "n_words"))
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_rules(rows: DataFrame) -> list[Rule]:
    """Rules that reject, in order. ``rows``: FEATURES, ``bad`` (boolean), ``grow`` (boolean)."""
    edges = {f: sorted(set(e)) for f, e in zip(FEATURES, rows.approxQuantile(list(FEATURES), list(QUANTILES), 0.001), strict=True)}
    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(MAX_RULES):
        rule: Rule = ()
        for _ in range(MAX_CONDITIONS):
            best, clean = _best_condition(rows.filter(left & F.col("grow") & holds(rule)), edges)
            if clean or best is None:
                break
            rule += (best,)
        if not rule:
            break
        counts = rows.filter(left & ~F.col("grow")).agg(
            *[F.count_if(holds(rule[:k]) & (F.col("bad") == b)).alias(f"{name}{k}") for k in range(1, len(rule) + 1) for name, b in (("p", True), ("n", False))]
        ).first()
        worth = {k: ((p := counts[f"p{k}"]) - (n := counts[f"n{k}"])) / max(1, p + n) for k in range(1, len(rule) + 1)}
        k = max(worth, key=lambda k: (worth[k], -k))
        p, n = counts[f"p{k}"], counts[f"n{k}"]
        if p < LEAST or p < PRECISION * (p + n):
            break
        rules.append(rule[:k])
        left = left & ~holds(rule[:k])
    return rules


def _best_condition(rows: DataFrame, edges: dict[str, list[float]]) -> tuple[Condition | None, bool]:
    """The threshold with the best FOIL gain over ``rows``; and whether these hold no good row already."""
    bins = [
        F.struct(F.lit(f).alias("f"), sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)).alias("bin"))
        for f in FEATURES
    ]
    table = rows.select("bad", F.explode(F.array(*bins)).alias("_b")).groupBy("_b.f", "_b.bin", "bad").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {(r["f"], r["bin"], r["bad"]): r["n"] for r in table}
    bad, good = (sum(v for (f, _, b), v in count.items() if f == FEATURES[0] and b == want) for want in (True, False))
    best, most = None, 0.0
    if not bad or not good:
        return None, True
    for f in FEATURES:
        for i, e in enumerate(edges[f]):
            for above in (True, False):
                p, n = (sum(v for (g, k, b), v in count.items() if g == f and b == want and (k > i) == above) for want in (True, False))
                gain = p * (log2(p / (p + n)) - log2(bad / (bad + good))) if p else 0.0
                if gain > most + 1e-9:
                    best, most = Condition(f, above, e), gain
    return best, False


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per document: id, the statistics, base_failed, kept, and the number of the rule that rejected it."""
    stats = materialize(with_rates(text_statistics(docs, id_col, text_col)), "statistics")
    known = labels.filter(F.col(label_col).isNotNull() & (doc_crc(id_col) % 4 != 2)).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 0).alias("bad"))
    grow = F.pmod(F.xxhash64(F.lit("grow"), F.col("_id")), F.lit(3)) != 0
    rows = materialize(stats.join(known, "_id").select(*FEATURES, "bad", grow.alias("grow")), "labelled")
    verdict = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(learn_rules(rows)))):
        verdict = F.when(holds(rule), F.lit(i)).otherwise(verdict)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict.isNull()).alias("kept"), verdict.alias("rule"),
    )
