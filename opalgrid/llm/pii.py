"""Personal data and secrets: base patterns, and boosted candidates beyond them.

Base spans come from four fixed patterns with their checks. High-recall generators then propose further spans, which may
overlap: addresses spelled out with and without brackets, separated number groups, unseparated runs of 7 to 19 digits as
phone and as card numbers, cards and IPs with other separators, and runs of 16 or more letters, digits and dashes as
secrets (kind ``secret``). Matches of a base pattern that failed their check are candidates too. Boosted regression trees
score a candidate from its format (digits, groups, separators, changes between letters and digits, checksum, failed
check) and its context (cue words and neighbouring characters); per-kind thresholds are calibrated on rows set apart, and
candidates above their threshold that touch no base span are added.

No labels exist for personal data, so the trees learn from what the corpus says of itself. Positives are the base spans,
and again with their give-away marks taken off (the plus and brackets of a phone number, the at sign of an address), so
that the rest of the format and the context must carry the decision; and runs that a text assigns to a name such as
password or token, again without that cue, or that have a published format of access keys. Negatives are candidates that failed the base checks and long runs of one
case of letters alone. Another candidate of the further generators takes its label from what it overlaps: a base span of
its own kind makes it a positive, any other base candidate a negative. One that overlaps nothing has no label: it is what
the model decides on. It counts as a negative of the small weight UNLABELLED, and not at all when thresholds are
calibrated. The features of a number's format are zero for an address, whose digits and letters say nothing about it.

Everything is a DataFrame expression or an aggregate. Patterns are scanned once per text; all later steps see the
candidates only. Possessive quantifiers keep the scans linear and off the stack in texts of any length.

Defined results: a null text has no span; repeated rows each get their row; a null id is passed on; where a corpus has
no positives or no negatives nothing is added; an empty table gives no rows; columns other than the id and the text are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm.common import materialize, text_of

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
NEAR = 24
LOCAL = r"[A-Za-z0-9._%+-]"
#: name -> (kind, pattern, cheap test that a text must pass first)
BASE = {
    "email": ("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": ("card", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9][0-9 -]{11,}[0-9]"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
EXTRA = {
    "spelled": ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]++(?: ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]++)++", r"[(\[] ?at ?[)\]]"),
    "groups": ("phone", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}+(?![0-9A-Za-z])", r"[0-9][ .)-][ (]?[0-9]"),
}
EXTRA |= {
    "worded": ("email", r"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", " at [A-Za-z0-9-]+ dot "),
    "run": ("phone", r"(?<![0-9A-Za-z+.])[0-9]{7,15}+(?![0-9A-Za-z])", "[0-9]{7}"),
    "long": ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])", "[0-9]{13}"),
    "quads": ("card", r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_:][0-9]{4}){3}+(?![0-9A-Za-z])", "[0-9][./_:][0-9]{4}[./_:]"),
    "octets": ("ip", r"(?<![0-9A-Za-z])[0-9]{1,3}(?: ?(?:[(\[]\.[)\]]|[(\[]?dot[)\]]?|[,_]) ?[0-9]{1,3}){3}+(?![0-9A-Za-z])", r"[0-9] ?(?:[(\[]\.|[(\[]?dot|[,_])"),
    "secret": ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+", "[A-Za-z0-9_-]{16}"),
}
#: A name before a run that says that the run is a secret; ``left`` is in lower case.
ASSIGNED = r"(?:passw(?:or)?d|pwd|token|secret|api[_-]?key)[\"' ]{0,3}[:=][\"' ]{0,3}$"
#: Published formats of access keys.
KEY_FORMAT = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})$"
FEATURES = (
    "digits", "groups", "longest", "separators", "plus", "bracket", "letters", "capitals", "changes", "luhn", "octets", "failed",
    "cue_phone", "cue_mail", "cue_card", "cue_net", "cue_key", "glued", "at", "address", "secret",
)
TREES, RATE, RIDGE = 8, 0.5, 1.0
PRECISION = 0.98
UNLABELLED = 0.1


ITEM = "struct<name:string,i:int,gap:int,hit:string,left:string,right:string>"


def _items(name: str) -> Column:
    """The hits of one generator, each with the length of the text since the hit before and both neighbourhoods."""
    parts, hits = F.col(f"_p_{name}"), F.col(f"_h_{name}")

    def item(hit: Column, i: Column) -> Column:
        left, right = F.right(F.get(parts, i), F.lit(NEAR)), F.left(F.get(parts, i + 1), F.lit(NEAR))
        return F.struct(F.lit(name).alias("name"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), hit.alias("hit"), F.lower(left).alias("left"), F.lower(right).alias("right"))

    return F.transform(hits, item)


def _proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document: _uid, its id, and ``_found``: generator, ordinal, gap before, hit, and text on both sides."""
    rows = docs.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
    every = BASE | EXTRA
    for name, (_, pattern, test) in every.items():
        may = F.contains("_text", F.lit(test)) if test == "@" else F.col("_text").rlike(test)
        rows = rows.withColumn(f"_p_{name}", F.when(may, F.split("_text", pattern, -1))).withColumn(f"_h_{name}", F.when(may, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))))
    found = [F.coalesce(_items(name), F.array().cast(f"array<{ITEM}>")) for name in every]
    rows = rows.select("_doc", F.monotonically_increasing_id().alias("_uid"), F.concat(*found).alias("_found"))
    return materialize(rows.select("_uid", "_doc", F.when(F.size("_found") > 0, F.col("_found")).alias("_found")), "proposals")


def _spans(proposals: DataFrame) -> DataFrame:
    """A row per proposed span: _uid, name, kind, start, end, hit, its digits, both sides, and whether base checks hold."""
    each = proposals.select("_uid", F.inline("_found"))
    before = Window.partitionBy("_uid", "name").orderBy("i")
    size = F.length("hit")
    start = F.sum(F.col("gap") + size).over(before) - size
    kind = F.lit(None).cast("string")
    for name, (k, _, _) in (BASE | EXTRA).items():
        kind = F.when(F.col("name") == name, F.lit(k)).otherwise(kind)
    each = each.select("_uid", "name", kind.alias("kind"), start.cast("long").alias("start"), (start + size).cast("long").alias("end"), "hit", "left", "right")
    each = each.withColumn("_d", F.regexp_replace("hit", "[^0-9]", ""))
    n = F.length("_d")
    # a leading-zero-safe reading of 0..255
    octets = (F.col("name") == "ip") & F.forall(F.split("hit", r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    luhn = F.when(n.between(13, 19), F.call_function("luhn_check", F.col("_d"))).otherwise(F.lit(False))
    holds = (
        F.when(F.col("name") == "email", F.lit(True))
        .when(F.col("name") == "ip", octets)
        .when(F.col("name") == "card", luhn)
        .when(F.col("name") == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )
    each = each.withColumn("base", holds).withColumn("luhn", luhn.cast("int")).withColumn("octets", octets.cast("int"))
    return each.filter((F.col("name") != "card") | F.col("base") | n.between(13, 19)).filter((F.col("name") != "groups") | n.between(7, 15))


def _meets(rows: DataFrame) -> DataFrame:
    """Adds ``_same`` and ``_other``: whether a base span of the row's kind, or another candidate of the base
    generators, overlaps the row. Two running extremes over a document's spans in order; no pairs are made."""
    order = Window.partitionBy("_uid").orderBy("start", "end", "name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    plain = F.col("name").isin(*BASE)

    def met(which: Column) -> Column:
        ahead = F.max(F.when(which, F.col("end"))).over(before) > F.col("start")
        behind = F.min(F.when(which, F.col("start"))).over(after) < F.col("end")
        return F.coalesce(ahead, F.lit(False)) | F.coalesce(behind, F.lit(False))

    same = other = F.lit(False)
    for kind in ALL_KINDS:
        good = F.col("base") & (F.col("kind") == kind)
        same = F.when(F.col("kind") == kind, met(plain & good)).otherwise(same)
        other = F.when(F.col("kind") == kind, met(plain & ~good)).otherwise(other)
    return rows.withColumn("_same", same).withColumn("_other", other)


def _featured(spans: DataFrame) -> DataFrame:
    sides = F.concat("left", F.lit(" "), "right")
    glued = F.col("left").rlike("[a-z0-9_=\"]$") | F.col("right").rlike("^[a-z0-9_\"]")
    address = F.col("kind") == "email"
    hit = F.when(address, F.lit("")).otherwise(F.col("hit"))
    return spans.select(
        "_uid", "name", "kind", "start", "end", "base", "luhn", "octets",
        (F.col("name").isin(*BASE) & ~F.col("base")).cast("int").alias("failed"),
        (F.col("left").rlike(ASSIGNED) | F.col("hit").rlike(KEY_FORMAT)).alias("assigned"),
        F.least(F.length(F.regexp_replace(hit, "[^0-9]", "")), F.lit(24)).alias("digits"),
        F.least(F.size(F.array_remove(F.split(hit, "[^0-9]+"), "")), F.lit(9)).alias("groups"),
        F.least(F.array_max(F.transform(F.split(hit, "[^0-9]+"), F.length)), F.lit(20)).alias("longest"),
        F.least(F.length(F.regexp_replace(hit, "[^ ().-]", "")), F.lit(9)).alias("separators"),
        F.contains("hit", F.lit("+")).cast("int").alias("plus"),
        F.contains(hit, F.lit("(")).cast("int").alias("bracket"),
        F.least(F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), F.lit(20)).alias("letters"),
        F.least(F.length(F.regexp_replace(hit, "[^A-Z]", "")), F.lit(9)).alias("capitals"),
        F.least(F.regexp_count(hit, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")), F.lit(9)).alias("changes"),
        sides.rlike("phone|tel|call|fax|mobile").cast("int").alias("cue_phone"),
        sides.rlike("mail|contact|write to").cast("int").alias("cue_mail"),
        sides.rlike("card|visa|iban|account").cast("int").alias("cue_card"),
        sides.rlike("server|host|addr|login| ip").cast("int").alias("cue_net"),
        sides.rlike("passw|pwd|token|secret|api.?key|auth").cast("int").alias("cue_key"),
        glued.cast("int").alias("glued"),
        F.contains("hit", F.lit("@")).cast("int").alias("at"),
        address.cast("int").alias("address"),
        (F.col("kind") == "secret").cast("int").alias("secret"),
    )


@dataclass(frozen=True)
class Tree:
    """One split, and one more on either side; ``None`` where a side is a leaf."""

    feature: str
    cut: int
    sides: tuple[tuple[str, int] | None, tuple[str, int] | None]
    leaves: tuple[float, float, float, float]  # left low, left high, right low, right high

    def column(self) -> Column:
        def side(split: tuple[str, int] | None, low: float, high: float) -> Column:
            return F.lit(low) if split is None else F.when(F.col(split[0]) <= split[1], F.lit(low)).otherwise(F.lit(high))

        return F.when(F.col(self.feature) <= self.cut, side(self.sides[0], *self.leaves[:2])).otherwise(side(self.sides[1], *self.leaves[2:]))


def _split(sums: dict[tuple[str, int], tuple[float, float]]) -> tuple[tuple[str, int] | None, float, float, float]:
    """The best (feature, cut) of one node, with the leaf values of both sides and of the whole."""
    one = FEATURES[0]
    g, h = (sum(v[i] for (f, _), v in sums.items() if f == one) for i in (0, 1))
    best, gain, low, high = None, 1e-6, -g / (h + RIDGE), -g / (h + RIDGE)
    for f in FEATURES:
        values = sorted(v for (x, v) in sums if x == f)
        gl = hl = 0.0
        for v in values[:-1]:
            gl, hl = gl + sums[f, v][0], hl + sums[f, v][1]
            gr, hr = g - gl, h - hl
            won = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - g * g / (h + RIDGE)
            if won > gain:
                best, gain, low, high = (f, v), won, -gl / (hl + RIDGE), -gr / (hr + RIDGE)
    return best, low, high, -g / (h + RIDGE)


def boost(rows: DataFrame, trees: int = TREES) -> Column | None:
    """The boosted log-odds as a column. ``rows``: FEATURES (small integers), y, w. None without both classes.

    A tree costs two aggregates of gradients per feature value; the driver sees these sums only.
    """
    totals = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    score = F.lit(0.0)
    for _ in range(trees):
        p = 1 / (1 + F.exp(-score))
        graded = rows.withColumn("_g", (p - F.col("y")) * F.col("w")).withColumn("_h", p * (1 - p) * F.col("w"))

        def sums(of: DataFrame, node: Column) -> dict[int, dict[tuple[str, int], tuple[float, float]]]:
            each = of.select(node.alias("node"), "_g", "_h", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in FEATURES])).alias("x"))
            out: dict[int, dict] = {}
            for r in each.groupBy("node", "x.f", "x.v").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                out.setdefault(r["node"], {})[r["f"], r["v"]] = (r["g"], r["h"])
            return out

        root, _, _, _ = _split(sums(graded, F.lit(0))[0])
        if root is None:
            break
        below = sums(graded, F.when(F.col(root[0]) <= root[1], F.lit(0)).otherwise(F.lit(1)))
        sides = [_split(below[k]) for k in (0, 1)]
        leaves = [RATE * x for s in sides for x in ((s[3], s[3]) if s[0] is None else (s[1], s[2]))]
        score = score + Tree(*root, (sides[0][0], sides[1][0]), tuple(leaves)).column()
    return score


def _training(rows: DataFrame) -> DataFrame:
    """Rows with y, w and ``known`` (whether y is a label); positives also without their give-away marks."""
    rows = _meets(rows)
    plain = F.col("name").isin(*BASE)
    # a run that is assigned to a name such as password is a secret, one of small letters alone is a word
    secret = (F.col("kind") == "secret") & ~F.col("_other")
    given, word = secret & F.col("assigned"), secret & ~F.col("assigned") & (F.col("digits") + F.col("capitals") == 0)
    known = plain | F.col("_same") | F.col("_other") | given | word
    rows = rows.withColumn("y", F.when(plain, F.col("base")).otherwise(F.col("_same") | given).cast("int"))
    rows = rows.withColumn("known", known).withColumn("w", F.when(known, F.lit(1.0)).otherwise(F.lit(UNLABELLED))).drop("_same", "_other")
    good = rows.filter("y = 1")
    bare = good.withColumn("plus", F.lit(0)).withColumn("at", F.lit(0)).withColumn("cue_key", F.lit(0))
    open_ = good.filter("bracket = 1").withColumn("plus", F.lit(0)).withColumn("bracket", F.lit(0))
    return rows.unionByName(bare).unionByName(open_)


def _thresholds(rows: DataFrame, score: Column) -> dict[str, float]:
    """Per kind the lowest score from which on the calibration rows are right at PRECISION; infinite if there is none."""
    bins = rows.select("kind", "y", F.least(F.greatest(F.floor((score + 8) * 4), F.lit(0)), F.lit(63)).alias("bin")).groupBy("kind", "bin").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for kind in ALL_KINDS:
        p = n = 0
        out[kind] = float("inf")
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            p, n = p + r["p"], n + r["n"]
            if p >= PRECISION * n and p >= 5:
                out[kind] = r["bin"] / 4 - 8
    return out


def added_spans(spans: DataFrame) -> DataFrame:
    """The candidates beyond the base that the model selects: _uid, kind, start, end."""
    rows = materialize(_featured(spans), "candidates")
    labelled = _training(rows).withColumn("_fold", F.pmod(F.xxhash64("_uid", F.lit("fold")), F.lit(4)))
    labelled = materialize(labelled.drop("_uid", "start", "end"), "training")
    score = boost(labelled.filter("_fold <> 0"))
    if score is None:
        return rows.filter("false").select("_uid", "kind", "start", "end")
    limits = _thresholds(labelled.filter("_fold = 0 AND known"), score)
    limit = F.lit(float("inf"))
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(value)).otherwise(limit)
    # numbers beyond 255 make no address, however much their context speaks for one
    chosen = rows.filter((F.col("name") != "ip") | F.col("base")).select("_uid", "kind", "start", "end", "base", score.alias("_score")).filter(F.col("base") | (F.col("_score") >= limit))
    # spans that overlap form an island; an island with a base span gets nothing, another its best candidate
    by_start = Window.partitionBy("_uid").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = chosen.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("_uid", "_island").orderBy(F.desc("base"), F.desc("_score"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    return islands.withColumn("_rank", F.row_number().over(best)).filter((F.col("_rank") == 1) & ~F.col("base")).select("_uid", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted (place, start, end) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), and
    the number of all spans and of those of kind ``secret``."""
    proposals = _proposals(docs, id_col, text_col)
    spans = materialize(_spans(proposals.filter(F.col("_found").isNotNull())), "spans")
    base = spans.filter("base").select("_uid", "kind", "start", "end", F.lit(True).alias("base"))
    every = base.unionByName(added_spans(spans).withColumn("base", F.lit(False)))
    place = F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), F.col("kind")).cast("int") - 1
    item = F.struct(place.alias("place"), "start", "end")
    per = every.groupBy("_uid").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        _joined(F.collect_list(F.when(F.col("base"), item))).alias("_base"),
        _joined(F.collect_list(item)).alias("_all"),
        F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("kind") == "secret").alias("n_secret"),
    )
    out = proposals.select("_uid", "_doc").join(per, "_uid", "left")
    return out.select(
        F.col("_doc").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("_base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_spans", "n_secret")],
    )
