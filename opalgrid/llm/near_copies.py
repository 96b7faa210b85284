"""The filtering variant of the SimHash operator: texts whose sets of five-word shingles have a cosine of 0.8 or more.

Cosine, shared shingles over the root of the product of both sizes, is what SimHash fingerprints estimate. Pairs with a
Jaccard resemblance of 0.8 or more all have it. At the limit 13 of 64 bits differ, so that the two-bit links of
``simhash`` and its pivot keys miss nearly all such copies. Candidates therefore come from BANDS bands of ROWS smallest
hashes (a pair at the limit shares no band with probability (1 - (2/3)**4)**24, half a percent). The named method
discards: each fingerprint of 256 bits has a table of distances to pivots, and a pair whose distances differ by more than
FAR bits in any coordinate, or whose fingerprints do, is dropped; at the limit that is four standard deviations. Survivors
are verified on their whole shingle sets (32 bits a shingle).

Keys that at most CROWD nodes share are compared member by member. A larger crowd is not paired up:

1. Every member is compared with the crowd's hub, the member whose shingles are common among crowded texts in the
   largest part. Members that end in the hub's component are done with each other.
2. A member that stands apart from its hub can be near to another one in two ways only. Either both share a shingle that
   at most CROWD crowded texts have; then, by the prefix principle, the rarest shingle they share is among the first
   n - ceil(0.64 n) + 1 of both in ascending frequency, and lists of these, no longer than CROWD, hold the pair. Or all
   that they share is common; then both need enough common shingles for the cosine, which texts that merely share a
   passage lack, and their key holds the pair.

So no link between members of a crowd is lost, and groups that share a passage or one near-copied text cost in
proportion to their members unless many of them lie just under the limit of each other and of their hub.

Bands and bits find nearly all links at little cost, but not every one. An exact pass finds the rest (``_rest``): texts that
are near share at least 0.64 of either set. Texts that hold more than 0.36 of their set alone are done, which shows in the share
FIRST of all shingles for most. Of the others, those stay that share 0.64 of their set with texts of other components, until few
more go; lists of their rarest shingles (the prefix principle again) hold every pair that is still missing, and pairs are
verified on their sets alone. So the components are those of all pairs.

Defined results: a null text is empty; texts without a word are copies of each other; fewer than five words make one
shingle; texts of any length are read whole; repeated rows and ties share a node; of a component the smallest id stays
(repeated rows of that id and text stay together); documents with null ids are neither linked nor dropped; an empty
table gives no rows; other columns are passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm.common import HOT_SHARE, free_name, freed_shuffles, lookup, materialize, text_of
from opalgrid.llm.simhash import components, pivots

SEED = 43
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Fingerprints: 64-bit words, and the bits that may differ. Sets under SMALL shingles are not judged by their bits.
WORDS, FAR, SMALL = 4, 78, 16
CROWD = 32
#: Shingles below it are counted first: 45 of 100, of which few texts share so many that they are looked at whole.
FIRST = -(1 << 31) + (1 << 32) * 45 // 100
CHUNK = 1 << 13
#: Partners of one node that are verified in one place; a node with more is repeated.
PARTNERS = 2048
SKETCH = "id long, texthash long, node binary, n int, fp array<long>, keys array<long>, shingles array<int>"


def shingle_hashes(text: bytes) -> Any:
    """The distinct five-word shingles of a text as sorted 64-bit hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), dtype=np.uint64, count=len(words) - SHINGLE + 1))


def majority(hashes: Any) -> Any:
    """SimHash as WORDS signed 64-bit words: the bits that are set in over half the hashes, each hash mixed anew for every word."""
    import numpy as np

    total = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None] * np.array([2 * SEED**k + 1 for k in range(1, WORDS + 1)], dtype=np.uint64)
        part ^= part >> np.uint64(32)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64 * WORDS)
        total += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")


def band_keys(hashes: Any, factors: Any) -> Any:
    """A 64-bit key for every band."""
    import numpy as np

    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK // 8):
        np.minimum(low, (hashes[at : at + CHUNK // 8, None] * factors).min(axis=0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.astype(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per document with an id: its node (digest of the shingle set), fingerprint, band keys and shingles."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        factors = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [field.split()[0] for field in SKETCH.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for i, h, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    own = shingle_hashes(text.encode("utf-8", "surrogatepass"))
                    short = np.unique((own >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    node = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    rows.append((i, h, node, len(short), majority(own), band_keys(own, factors) if len(own) else [], short))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    text = text_of(text_col)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("texthash"), text.alias("text"))
    return rows.mapInArrow(run, SKETCH)


def _bits(fp: Column, other: Column) -> Column:
    return sum((F.bit_count(F.get(fp, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(1, WORDS)), F.bit_count(F.get(fp, F.lit(0)).bitwiseXOR(F.get(other, F.lit(0)))))


def _vector(fp: Column) -> Column:
    """Hamming distances to the pivots; every word of a pivot is the same number."""
    return F.array(*[_bits(fp, F.array(*[F.lit(p)] * WORDS)).cast("short") for p in pivots()])


def _near(pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the cheap tests: sizes, pivot distances (triangle inequality), bits."""
    pairs = materialize(pairs.distinct(), "pairs")
    counts = pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    left = materialize(traits.join(counts, "node").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa"), F.col("v").alias("va"), "_n"), "traits")
    both = lookup(pairs, left, "a", "_n", pairs.count()).drop("_n")
    both = both.join(traits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fp").alias("fb"), F.col("v").alias("vb")), "b")
    sizes = F.least("na", "nb") >= _least(F.greatest("na", "nb"))
    widest = F.greatest(*[F.abs(F.get("va", F.lit(j)) - F.get("vb", F.lit(j))) for j in range(len(pivots()))])
    alike = (widest <= FAR) & (_bits(F.col("fa"), F.col("fb")) <= FAR)
    return both.filter(sizes & ((F.least("na", "nb") < SMALL) | alike)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are near. The set of b travels once a pair, that of a once in PARTNERS pairs."""
    pairs = materialize(pairs, "candidates")
    counts = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "partners")
    spread = lookup(pairs, counts, "a", "_n", pairs.count())
    places = F.ceil(F.col("_n") / PARTNERS).cast("int")
    spread = spread.select("a", "b", F.pmod(F.xxhash64("b"), places).cast("int").alias("_place"))
    left = counts.join(sets, F.col("a") == F.col("node")).select("a", F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), places - 1)).alias("_place"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = spread.join(right, "b").join(left, ["a", "_place"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.filter(25 * shared * shared >= 16 * F.size("sa").cast("long") * F.size("sb")).select("a", "b")  # whole numbers: the limit itself is near


def _close(pairs: DataFrame, sets: DataFrame, traits: DataFrame) -> DataFrame:
    return materialize(_verified(_near(pairs, traits), sets), "edges")


def _unlike(la: str, lb: str, na: str, nb: str, ga: str, gb: str) -> Column:
    """In different components, and with enough common shingles on either side to be near by these alone."""
    need = 16 * F.col(na).cast("long") * F.col(nb)
    return (F.col(la) != F.col(lb)) & (25 * F.col(ga).cast("long") * F.col(ga) >= need) & (25 * F.col(gb).cast("long") * F.col(gb) >= need)


def _least(n: Column | str) -> Column:
    """Shingles of a set of ``n`` that a near one has too, at least: ceil(0.64 n)."""
    return F.floor((16 * (F.col(n) if isinstance(n, str) else n).cast("long") + 24) / 25)


def _rest(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) that link all near nodes of different components; every pair of them is verified."""
    first = F.filter("shingles", lambda s: s < FIRST)
    each = rows.select(F.xxhash64("node").alias("h"), F.explode(first).alias("s"))
    sizes = materialize(rows.select(F.xxhash64("node").alias("h"), "n", F.size(first).alias("_n")), "sizes")
    met = each.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high")
    met = materialize(met.select("s", "_n"), "met").hint("shuffle_hash")
    shared = lookup(each, met, "s", "_n", sizes.agg(F.sum("_n")).first()[0] or 0).groupBy("h").agg(F.count(F.lit(1)).alias("g"))
    kept = sizes.join(materialize(shared, "shared"), "h", "left").filter(F.col("_n") - F.coalesce("g", F.lit(0)) <= F.col("n") - _least("n"))
    touched = kept.filter("n > 0").select("h").distinct()
    own = nodes.select("node", F.col("first").alias("id"), F.xxhash64("node").alias("h")).join(touched, "h").join(labels, "node", "left")
    own = own.select("node", "id", F.xxhash64(F.coalesce("label", "node")).alias("l"))
    sets = rows.select("node", "id", "n", "shingles").join(own, ["node", "id"]).dropDuplicates(["node", "id"]).drop("id")
    sets = live = materialize(sets, "touched")
    left, before = live.count(), None
    while left and (before is None or 2 * left < before):
        each = live.select("node", F.explode("shingles").alias("s"), "l")
        mixed = each.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.min("l").alias("low"), F.max("l").alias("high")).filter("low <> high")
        mixed = materialize(mixed.select("s", "_n"), "mixed")
        shared = lookup(each.select("node", "s"), mixed, "s", "_n", live.agg(F.sum("n")).first()[0])
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("g"))
        live = live.drop("g").join(enough, "node").filter(F.col("g") >= _least("n"))
        before, live = left, materialize(live, "live")
        left = live.count()
    if not left:
        return labels.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    each = live.select("node", "n", "g", "l", F.explode("shingles").alias("s"))
    mixed = each.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.min("l").alias("low"), F.max("l").alias("high")).filter("low <> high")
    known = lookup(each, materialize(mixed.select("s", "_n"), "mixed"), "s", "_n", live.agg(F.sum("n")).first()[0])
    # shingles of one component come first, as no missing pair shares them; then the others from the rarest on
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    place = alone + F.row_number().over(Window.partitionBy("node").orderBy("_n", "s"))
    size = F.floor(F.log("n") / F.log(F.lit(SIMILARITY**-2)))
    listed = known.withColumn("_at", place).filter(F.col("_at") <= F.col("n") - _least("n") + 1).withColumn("_class", size)
    # where this is the first shingle that two texts share, they share no more than follows it
    listed = materialize(listed.select("s", "node", "n", F.least("g", F.col("n") - F.col("_at") + 1).alias("g"), "l", "_class"), "listed")
    # of two texts of different components one at least is not of the list's largest component
    home = listed.groupBy("s", "l").agg(F.count(F.lit(1)).alias("_n")).groupBy("s").agg(F.max(F.struct("_n", "l")).alias("home"), F.sum("_n").alias("_n"))
    home = materialize(home.select("s", "_n", F.col("home.l").alias("home")), "homes")
    apart = lookup(listed, home, "s", "_n", listed.count()).filter("l <> home")
    apart = apart.select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"), F.col("l").alias("la"), "_class")
    classes = F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)
    every = listed.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("l").alias("lb"), F.explode(classes).alias("_class"))
    pairs = apart.join(every, ["s", "_class"]).filter(_unlike("la", "lb", "na", "nb", "ga", "gb"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(_verified(pairs, sets), "edges")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row with an id: id, texthash, keep_id (the smallest id of its component)."""
    with freed_shuffles(docs.sparkSession):
        return _near_groups(docs, id_col, text_col)


def _near_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = materialize(sketches(docs, id_col, text_col), "sketches")
    own = rows.select("id", "texthash", "node")
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("_n")), "nodes")

    keyed = materialize(rows.select("node", F.explode("keys").alias("_key")).distinct(), "bands")
    shared = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "keys")
    members = materialize(lookup(keyed, shared, "_key", "_n", keyed.count()), "members")
    # one row holds a node's set: that of its smallest id, so that copies spread over the tasks of the join
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("first").alias("id")), "node")
    sets = rows.select("node", "id", "n", "fp", "shingles").join(wanted, ["node", "id"]).dropDuplicates(["node", "id"])
    sets = materialize(sets.withColumn("v", _vector(F.col("fp"))).drop("id"), "sets")
    traits = sets.select("node", "n", "fp", "v")

    few = members.filter(F.col("_n") <= CROWD)
    pairs = few.select("_key", F.col("node").alias("a")).join(few.select("_key", F.col("node").alias("b")), "_key").filter("a < b").select("a", "b")

    crowd = members.filter(F.col("_n") > CROWD)
    each = sets.join(crowd.select("node").distinct(), "node").select("node", "n", F.explode("shingles").alias("s"))
    each = materialize(each, "crowded")
    often = materialize(each.groupBy("s").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("only")), "often")
    # how often a shingle occurs is looked up for rare ones alone: those met once are named by their aggregate, the rest is common
    hot = [r["s"] for r in often.filter((F.col("_n") > CROWD) & (F.col("_n") * HOT_SHARE > max(each.count(), HOT_SHARE))).select("s").collect()]  # at most HOT_SHARE
    rare = each.filter(~F.col("s").isin(hot)).join(often.filter(F.col("_n").between(2, CROWD)).select("s", "_n"), "s")
    rare = materialize(rare, "rare")
    once = often.filter("_n = 1").groupBy(F.col("only").alias("node")).agg(F.count(F.lit(1)).alias("once"))
    common = sets.select("node", "n").join(crowd.select("node").distinct(), "node").join(once, "node", "left").join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("few")), "node", "left")
    common = common.select("node", "n", F.coalesce("once", F.lit(0)).alias("once"), (F.col("n") - F.coalesce("once", F.lit(0)) - F.coalesce("few", F.lit(0))).alias("g"))
    common = materialize(common, "common")
    crowd = materialize(crowd.join(common, "node"), "crowd")
    hubs = crowd.groupBy("_key", "_n").agg(F.max(F.struct((F.col("g") / F.col("n")).alias("part"), "node")).alias("hub"))
    hubs = materialize(hubs.select("_key", "_n", F.col("hub.node").alias("hub")), "hubs")
    stars = lookup(crowd.drop("_n"), hubs, "_key", "_n", crowd.count()).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    edges = _close(pairs.unionByName(stars), sets, traits)
    labels = components(edges)

    label_of = traits.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    label_of = materialize(label_of, "labels")
    hubs = materialize(hubs.join(label_of.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub"), "hubs")
    known = materialize(lookup(crowd.drop("_n").join(label_of, "node"), hubs, "_key", "_n", crowd.count()), "known")
    apart = known.filter("label <> hub_label")

    # shingles met once come first, then the rare ones; both are within the prefix or not by their place
    place = F.col("once") + F.row_number().over(Window.partitionBy("node").orderBy("_n", "s"))
    first = rare.join(common.select("node", "once"), "node").withColumn("_at", place).filter(F.col("_at") <= F.col("n") - _least("n") + 1)
    first = materialize(first.select("node", "s").join(label_of, "node"), "first")
    left = first.join(apart.select("node").distinct(), "node").select("s", F.col("node").alias("a"), F.col("label").alias("la"))
    lists = left.join(first.select("s", F.col("node").alias("b"), F.col("label").alias("lb")), "s").filter("la <> lb")
    # sizes of near texts differ by less than one class, so a text is also listed in both neighbouring ones
    size = F.floor(F.log("n") / F.log(F.lit(SIMILARITY**-2)))
    left = apart.select("_key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("g").alias("ga"), size.alias("_class"))
    left = left.filter(F.col("ga") >= _least("na"))
    right = known.filter(F.col("g") >= _least("n"))
    right = right.select("_key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.explode(F.array(size - 1, size, size + 1)).alias("_class"))
    core = left.join(right, ["_key", "_class"]).filter(_unlike("la", "lb", "na", "nb", "ga", "gb"))
    more = lists.select("a", "b").unionByName(core.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _close(more, sets, traits)
    if more.limit(1).count():
        edges = materialize(edges.unionByName(more).distinct(), "edges")
        labels = components(edges)
    more = _rest(rows, nodes, labels)
    if more.limit(1).count():
        labels = components(edges.unionByName(more))

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named, "named")
    keep = named.groupBy("label").agg(F.min("first").alias("keep_id"), F.count(F.lit(1)).alias("_m"))
    found = lookup(named, materialize(keep, "keep"), "label", "_m", named.count()).select("node", "_n", "keep_id")
    return lookup(own, materialize(found, "found"), "node", "_n", own.count()).select("id", "texthash", "keep_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each component the one with the smallest id."""
    gone_id, gone_hash = free_name(docs, "id"), free_name(docs, "hash")
    gone = near_groups(docs, id_col, text_col).filter("id <> keep_id").select(F.col("id").alias(gone_id), F.col("texthash").alias(gone_hash)).distinct()
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (F.xxhash64(text_of(text_col)) == F.col(gone_hash))
    return docs.join(gone, same, "left_anti")
