"""The corpus operators against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opalgrid.llm import exact_dedup, license_scan, mixing, near_copies, ngram_model, packing, pii, quality_classifier, quality_rules, queries, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, kept string, copies int, fp string, label int"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def make_rows() -> list[tuple]:
    texts = [prose(rng.randint(3, 120)) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [texts[6] + " x", texts[6] + " y", texts[7]]
    texts += [None, "", "   \n\t", "one", "two words", "a" * 200_000, "1 " * 40_000, prose(30_000), "*** " * 40, "Released under the MIT License."]
    texts += ["mail bob.x@mail.example.com now", "call +1 (017) 555-7713 ok", "ip 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111!", "Ärger ÄRGER\n" * 30]
    rows = [(i, t, "en", ("s1", "s2", None)[i % 3] if i % 2 else "hot", 1, "d", 1, "k", 2, "f", 3) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id", None, None, None, None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(not (t or "").startswith("*")), 0) for i, t in ((r[0], r[1]) for r in ROWS) if i is not None]
    return spark.createDataFrame([*rows, (5, None, None), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def runs(labels):
    return {
        "packing": packing.pack_documents, "license": license_scan.scan_licenses, "dedup": exact_dedup.dedup_report, "drop": exact_dedup.drop_exact_copies, "mix": mixing.mix_sources, "apply": mixing.apply_mix,
        "ngram": ngram_model.score_documents, "classifier": lambda d: quality_classifier.score_documents(d, labels), "good": lambda d: quality_classifier.keep_good(d, labels),
        "rules": lambda d: quality_rules.judge_documents(d, labels), "simhash": simhash.near_duplicates, "near": simhash.drop_near_copies, "alike": near_copies.drop_near_copies, "pii": pii.find_personal_data,
    }


PER_DOCUMENT = {"dedup", "mix", "ngram", "classifier", "rules", "simhash", "pii"}
FILTERS = {"drop", "apply", "good", "near", "alike"}


@pytest.mark.parametrize("name", sorted(runs(None)))
def test_odd_rows_and_empty_tables(docs, labels, name):
    run = runs(labels)[name]
    out = run(docs)
    n = out.count()
    if name in PER_DOCUMENT:
        assert n == len(ROWS)
    if name in FILTERS:
        assert out.columns == docs.columns
    assert run(docs.limit(0)).count() == 0


def test_packing_is_an_exact_cut(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, block_tokens=20_000).toPandas()
    for doc_id, text in {(r[0], r[1]) for r in ROWS if r[0] not in (3, None)}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = rows[rows.doc_id == doc_id].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        size = seq.length.sum()
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and size <= 2048 and size & (size - 1) == 0


def test_exact_dedup_and_its_index(spark, docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_report(docs).collect()}
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups: dict[str, list] = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = {(i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    assert got == want
    index = exact_dedup.DigestIndex(spark, buckets=4)
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), spark.createDataFrame([(3, "X"), (4, "z")], "doc_id long, text string")
    index.add(a)
    index.forget()
    again = exact_dedup.DigestIndex(spark, index.path, buckets=4)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again.add(b).collect()} == {(3, 1, False), (4, 4, True)}
    assert again.read().count() == 3


def test_exact_dedup_of_a_repeated_batch_and_compaction(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), spark.createDataFrame([(3, "X"), (4, "z")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, expected=40_000_000)
    assert index.buckets == 32 and exact_dedup.DigestIndex(spark, index.path, buckets=7).buckets == 32
    first = rows(index.add(a, batch="a"))
    second = rows(index.add(b, batch="b"))
    # as after a crash between the append and the use of the report: the batch comes again
    assert rows(index.add(a, batch="a")) == first and rows(index.add(b, batch="b")) == second and index.read().count() == 3
    assert not any(r["kept"] for r in index.add(a, batch="c").collect())
    small = index.compact()
    assert rows(small.read()) == rows(index.read()) and rows(small.add(b, batch="b")) == second


def test_filters_take_any_column_name(spark):
    odd = ["_id", "__id", "_digest", "_hash", "_key", "_size", "_copy", "__gone", "__hash", "__mixed", "__copies", "__copy"]
    long = " ".join(f"w{k}" for k in range(90))
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " x", "s"), (3, long, "s")], "doc_id long, text string, source string").select("*", *[F.lit(7).alias(c) for c in odd])
    for run in (exact_dedup.drop_exact_copies, simhash.drop_near_copies, near_copies.drop_near_copies, mixing.apply_mix):
        out = run(docs)
        assert out.columns == docs.columns and out.count() and all(r[c] == 7 for r in out.collect() for c in odd)


def test_mix_deals_copies_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i // 2, "w " * (1 + i % 7), "s") for i in range(60)] + [(5, "w w w", "s")] * 3, "doc_id long, text string, source string")
    want = {(r["doc_id"], r["size"]): r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).filter("n > 0").collect()}
    out = mixing.apply_mix(docs).groupBy("doc_id", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size")).count().collect()
    assert {(r["doc_id"], r["size"]): r["count"] for r in out} == want


def test_exact_dedup_keeps_ids_that_two_texts_share(spark):
    docs = spark.createDataFrame([(5, "a"), (9, "A"), (5, "unique text"), (9, "A"), (None, "a"), (None, "alone")], "doc_id long, text string")
    left = map(tuple, exact_dedup.drop_exact_copies(docs).collect())
    assert sorted(left, key=str) == sorted([(9, "A"), (9, "A"), (5, "unique text"), (None, "a"), (None, "alone")], key=str)


def test_mix_reaches_its_targets(docs):
    rows = mixing.mix_sources(docs.filter("doc_id < 60 AND doc_id <> 3")).join(docs.select("doc_id", "source").distinct(), "doc_id").toPandas()
    total = 0
    for _, g in rows.groupby("source", dropna=False):
        # the fill ends within half a document of the target
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 and (g.taken <= 2 * g["size"]).all()
        total += g.target.iloc[0]
    assert abs(total - 1.5 * rows["size"].sum()) < 1e-6


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_mix_with_null_and_repeated_ids(spark, ids, monkeypatch):
    monkeypatch.setattr(mixing, "TOGETHER", 50)
    name = {"null": lambda i: None, "one": lambda i: 7, "few": lambda i: i % 3}[ids]
    rows = [(name(i), "w " * 10, "s") for i in range(300)] + [(name(1), "w " * 13, "s")] + [(1000 + i, "w " * (1 + i % 9), "t") for i in range(200)] + [(name(2), f"w w {i}", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mixing.mix_sources(docs.repartition(n)).collect()), key=str) for n in (1, 7))
    assert one == two and len(one) == len(rows)
    frame = pd.DataFrame(one, columns=["doc_id", "size", "source_size", "target", "copies", "taken"])
    for _, g in frame.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 and g.copies.max() <= 2
    out = mixing.apply_mix(docs.withColumn("_part", F.lit(1))).select("doc_id", "text").collect()
    words = Counter((r["doc_id"], len(r["text"].split())) for r in out)
    want = Counter()
    for r in frame.itertuples():
        want[None if pd.isna(r.doc_id) else int(r.doc_id), r.size] += r.copies
    assert words == +want


@pytest.mark.parametrize("listed", [["com"], ["b.com", "x.y.z", None, "B.Com"], [], [""]])
def test_hosts_that_a_listed_key_covers(spark, listed):
    names = ["com", "a.com", "b.com", "c.b.com", "xb.com", "x.y.z", "w.x.y.z", "y.z", "", ".", "com."]
    hosts = spark.createDataFrame([(n,) for n in names], "key string")
    got = {r["key"] for r in url_filter.covered_hosts(hosts, spark.createDataFrame([(x,) for x in listed], "key string")).collect()}
    keys = {x.lower() for x in listed if x is not None}
    assert got == {n for n in names if any(n == k or n.endswith(f".{k}") for k in keys)}


def test_mix_with_weights_favours_heavy_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 2 * 3 + 1).alias("w"))
    rows = mixing.mix_sources(docs, share=0.5, weight_col="w").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in rows}
    assert n[1] > 1.8 * n[0]


def test_fingerprints_and_components(docs):
    rows = {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    fps = {d: f for d, f, _ in rows}
    assert fps == {r[0]: simhash.fingerprint((r[1] or "").encode()) for r in ROWS if r[0] is not None}
    assert {(d, c) for d, _, c in rows} == components(fps)


def components(fps: dict[int, int]) -> set[tuple[int, int]]:
    up = {d: d for d in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {(d, find(d)) for d in fps}


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 4)
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << i) for i in range(20)] + [base ^ (1 << 3) ^ (1 << 50) ^ (1 << 51) ^ (1 << 52), base ^ (1 << 3) ^ (1 << 50)] + [rng.getrandbits(63) for _ in range(200)]
    nodes = spark.createDataFrame(list(enumerate(values)), "node long, fp long")
    got = {(r["node"], r["label"]) for r in simhash.components(simhash.links(nodes)).collect()}
    want = components(dict(enumerate(values)))
    assert got == {(d, c) for d, c in want if sum(x == c for _, x in want) > 1}


@pytest.mark.parametrize("shuffled", [True, False])
def test_components_of_long_chains(spark, shuffled):
    names = [0, *range(999, 0, -1)]
    if shuffled:
        random.Random(5).shuffle(names)
    edges = [(*sorted(e),) for e in zip(names[:600], names[1:600], strict=False)] + [(*sorted(e),) for e in zip(names[600:], names[601:], strict=False)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["label"]) for r in found} == {(n, min(part)) for part in (names[:600], names[600:]) for n in part}


def resembling(rows: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """(id, smallest id of its component) by comparing all pairs."""
    sets, label = {}, {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i], label[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and label[a] != label[b] and (both or sets[a] == sets[b]) and both * both >= 0.64 * len(sets[a]) * len(sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return set(label.items())


@pytest.mark.parametrize(("partners", "crowd"), [(2048, 32), (3, 4)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, partners, crowd):
    monkeypatch.setattr(near_copies, "PARTNERS", partners)
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    own, rows = random.Random(11), []
    words = [f"w{k}" for k in range(500)]
    for _ in range(6):  # drifting chains: neighbours are near, ends are not
        text = own.choices(words, k=130)
        for _ in range(12):
            rows.append(" ".join(text))
            for at in own.sample(range(130), own.choice((1, 2, 3))):
                text[at] = own.choice(words)
    base = own.choices(words, k=60)
    rows += [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 60, 2)] + ["", " \n", "one two", "ONE  two", "one three"]
    rows += [" ".join(own.choices(words, k=own.randint(1, 80))) for _ in range(40)]
    # a crowd that shares a passage and one that copies a text with more and more changes; few of either are near
    passage = own.choices(words, k=40)
    rows += [" ".join([*own.choices(words, k=own.randint(5, 40)), *passage, *own.choices(words, k=own.randint(0, 20))]) for _ in range(40)]
    for edits in range(40):
        text = list(base) * 2
        for at in own.sample(range(120), edits // 4):
            text[at] = own.choice(words)
        rows.append(" ".join(text))
    own.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = resembling(list(enumerate(rows)))
    assert {(r["id"], r["keep_id"]) for r in near_copies.near_groups(docs).collect()} == want
    assert {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()} == {b for _, b in want}


def test_near_copies_keep_ids_that_two_texts_share(spark):
    long = " ".join(f"w{k}" for k in range(90))
    docs = spark.createDataFrame([(1, long), (2, long + " x"), (2, "another text"), (None, long)], "doc_id long, text string")
    left = {(r["doc_id"], r["text"]) for r in near_copies.drop_near_copies(docs).collect()}
    assert left == {(1, long), (2, "another text"), (None, long)}


def test_language_model_is_kneser_ney(docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(r[0], [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")), "</s>"]) for r in ROWS]
    train = [t for i, t in tokens if not held(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))

    def discounts(counts):
        return (0, *ngram_model.discounts([sum(1 for x in counts if x == k) for k in (1, 2, 3, 4)]))

    left = Counter(b for _, b in pairs)
    d1, d2, s1 = discounts(left.values()), discounts(pairs.values()), sum(left.values())
    g1 = sum(d1[min(x, 3)] for x in left.values()) / s1
    total, gamma = Counter(), Counter()
    for (a, _), x in pairs.items():
        total[a] += x
        gamma[a] += d2[min(x, 3)]

    def p(a, b):
        low = max(left[b] - d1[min(left[b], 3)], 0) / s1 + g1 / (v + 1)
        return max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) / total[a] + gamma[a] / total[a] * low if total[a] else low

    got = {r["doc_id"]: r for r in ngram_model.score_documents(docs, order=2).collect()}
    for i, t in tokens:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held(i))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False)), rel_tol=1e-5)
    assert math.isclose(sum(p("one", w) for w in [*c, "never seen"]), 1, rel_tol=1e-9)


def test_trigram_model_runs_and_gains(docs):
    two, three = (ngram_model.score_documents(docs.filter("doc_id < 60"), order=k).filter("NOT held_out").agg(F.sum("score")).first()[0] for k in (2, 3))
    assert three > two


def test_registered_language_model_is_trigram_kneser_ney(docs, tmp_path):
    docs.filter("doc_id < 60").write.parquet(f"{tmp_path}/documents.parquet")
    tokens = {r[0]: [*r[1].encode().lower().split(), "</s>"] for r in ROWS if r[0] is not None and r[0] < 60}
    train = [t for r in ROWS if r[0] in tokens and zlib.crc32(str(r[0]).encode()) % 10 for t in [tokens[r[0]]]]
    padded = lambda t: list(zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    counts = [Counter(g for t in train for g in padded(t))]
    counts += [Counter(g[1:] for g in counts[0])]
    counts += [Counter(g[1:] for g in counts[1])]
    v, levels = len({w for t in train for w in t}), []
    for found in reversed(counts):
        d, total, gamma = (0, *ngram_model.discounts([sum(x == k for x in found.values()) for k in (1, 2, 3, 4)])), Counter(), Counter()
        for g, x in found.items():
            total[g[:-1]] += x
            gamma[g[:-1]] += d[min(x, 3)]
        levels.append((found, d, total, gamma))

    def p(gram):
        out = 1 / (v + 1)
        for k, (found, d, total, gamma) in enumerate(levels, 1):
            own = gram[3 - k :]
            if total[own[:-1]]:
                out = (max(found[own] - d[min(found[own], 3)], 0) + gamma[own[:-1]] * out) / total[own[:-1]]
        return out

    got = {r["doc_id"]: r["score"] for r in queries.op6_ngram_model(docs.sparkSession, str(tmp_path)).collect()}
    assert got.keys() == tokens.keys()
    for i, t in tokens.items():
        assert math.isclose(got[i], sum(math.log10(p(g)) for g in padded(t)), rel_tol=1e-5)


def test_language_model_is_the_same_in_many_parts(docs, monkeypatch):
    scores = lambda: {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in ngram_model.score_documents(docs.filter("doc_id < 68")).collect()}
    one = scores()
    monkeypatch.setattr(ngram_model, "PART_BYTES", 2048)
    many = scores()
    assert one.keys() == many.keys() and all(np.allclose(one[i], many[i], rtol=1e-9) for i in one)


def test_packed_ngrams_lose_nothing():
    for words in (3, 300, 70_000):
        columns = [np.random.default_rng(k).integers(0, words, 50_000).astype(np.uint64) * np.uint64(15_000_000) for k in range(3)]
        counts = np.arange(50_000) % 3 + 1
        blob = ngram_model._pack(columns, counts, 5)
        back, own = ngram_model._unpack(blob, 5)
        order = np.argsort(counts != 1, kind="stable")
        assert all((a[order] == b).all() for a, b in zip(columns, back, strict=True)) and (counts[order] == own).all()
        back = ngram_model._unpack(ngram_model._pack(columns, counts << 33, 5), 5)[1]
        assert back.max() == 3 << 33
        assert len(blob) < 50_000 * 15 + np.sum(counts > 1) * 4 or words == 70_000


def test_classifier_learns_and_holds_out(spark):
    rows = [(i, prose(60) if i % 3 else " ".join(w + "$$$" for w in prose(60).split())) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    out = quality_classifier.score_documents(docs, labels).filter("held_out").collect()
    assert out and all((r["doc_id"] % 3 > 0) == (r["predicted"] == 1) for r in out)


def test_rules_statistics(docs, labels):
    for r in quality_rules.judge_documents(docs, labels).collect():
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(windows)
        covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_personal_data_base_spans(docs):
    def luhn(s):
        d = [int(x) for x in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for r in pii.find_personal_data(docs).collect():
        text = (next(x[1] for x in ROWS if x[0] == r["doc_id"]) or "") if r["doc_id"] is not None else "no id"
        if len(text) > 100_000:
            continue
        base = [f"{k}:{m.start()}:{m.end()}" for k, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}


def test_personal_data_adds_spans(spark):
    """Numbers without the plus and spelled-out addresses are added; addresses of hosts and number lists are not."""
    own = random.Random(5)
    n = lambda k: "".join(own.choice("0123456789") for _ in range(k))
    octets = lambda: ".".join(str(own.randint(10, 255)) for _ in range(4))
    texts = [own.choice([lambda: f"+1 ({n(3)}) 555-{n(4)}", octets, lambda: f"a.{n(2)}@mail{n(1)}.example.com", lambda: n(16), lambda: prose(9)])() for _ in range(600)]
    texts = [f"{prose(6)} {t} {prose(6)}" for t in texts]
    hexed = lambda k: "".join(own.choice("0123456789abcdef") for _ in range(k))
    texts += [f"{prose(6)} {own.choice(('password=', 'token = '))}{hexed(18)} {prose(6)}" for _ in range(150)] + [prose(9).replace(" ", "") for _ in range(100)]
    extra = ["(415) 555-2671", "anna (at) example (dot) com", f"x1{hexed(16)}9a"]
    clean = [octets(), "999.888.777.666", "12.05.2024", "2024-01-15 10", "7 of 10", n(12)]
    rows = [*enumerate(texts), *((10_000 + i, f"so {t} it") for i, t in enumerate(extra)), *((20_000 + i, f"so {t} it") for i, t in enumerate(clean))]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10_000]["spans"] == f"phone:3:{3 + len(extra[0])}" and got[10_000]["n_phone"] == 0
    assert got[10_001]["spans"] == f"email:3:{3 + len(extra[1])}" and got[10_001]["n_email"] == 0
    assert got[10_002]["spans"] == f"secret:3:{3 + len(extra[2])}" and got[10_002]["n_secret"] == 1
    secret = {i for i, t in enumerate(texts) if "password=" in t or "token = " in t}
    found = {i for i, r in got.items() if i < 10_000 and r["n_secret"]}
    assert found <= secret and len(found) >= 0.95 * len(secret)
    beyond = lambda r: (r["spans"].count(":") // 2) - r["n_email"] - r["n_ip"] - r["n_card"] - r["n_phone"]
    assert {i: r["spans"] for i, r in got.items() if beyond(r) and not 10_000 <= i < 20_000 and i not in secret} == {}


def test_licenses_equal_brute_force(docs):
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs).collect()}
    want = set()
    for name, t in license_scan.TEMPLATES.items():
        own = set(license_scan.shingles(license_scan.scan_words(t)))
        want |= {(r[0], name) for r in ROWS if len(own & set(license_scan.shingles(license_scan.scan_words(r[1] or "")))) >= 0.8 * len(own)}
    assert got == want and got


def test_whole_licenses_and_their_versions(spark):
    own, texts = random.Random(3), license_scan.TEXTS
    rows, want = [], set()
    for i, name in enumerate(texts):
        words = texts[name].split()
        for at in range(20, len(words), 60):
            words[at] = "changed"
        rows.append((i, f"{prose(own.randint(0, 400))} {' '.join(words)} {prose(50)}"))
        want.add((i, name))
    rows += [(100, "Licensed under CC BY 4.0."), (101, "This work is licensed under the GNU General Public License, version 2."), (102, texts["LGPL-2.0-text"] + texts["LGPL-2.1-text"])]
    want |= {(102, "LGPL-2.0-text"), (102, "LGPL-2.1-text")}
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g for g in got if g[1] in texts} == want
    assert {g for g in got if g[0] in (100, 101)} == {(100, "CC-BY-4.0"), (101, "GPL-2.0")}
    assert all(m <= s * n <= max(m + 1, 1.2 * m) for m in range(1, 10_000) for s, n in [license_scan.window(m)])


@pytest.mark.parametrize("room", [64 << 20, 0])
def test_cascade_is_exact(spark, room):
    urls = [f"https://{'spam-farm.' if i % 7 == 0 else ''}h{i}.example.org/x?{i}" for i in range(3000)] + [None, "no scheme", "HTTP://A.NET/fr/1", "http://www.example.com/en/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[0], urls[0]])], "page_id long, url string, host string")
    rules = [("block", "net", "/fr/"), ("allow", "www.example.com", "/en/")]
    listed = spark.createDataFrame([(f"Spam-Farm.h{i}.example.org",) for i in range(0, 3000, 14)] + [("h7.example.org",), ("ample.org",), (None,), ("elsewhere.org",)], "key string")
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages, rules, listed, shard_keys=500, max_broadcast=room).collect()}
    assert len(got) == len(urls) + 2
    for i, u in enumerate(urls[:3000]):
        assert (got[i]["verdict"], got[i]["host"]) == ("block" if i % 14 == 0 or i == 7 else "allow", u.split("/")[2])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(3000, 3004)] == [("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/fr/1", "net/fr/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert url_filter.judge_pages(pages.limit(0), rules, listed).count() == 0


def test_ftrl_is_the_plain_loop():
    own = random.Random(8)
    rows = []
    for _ in range(80):
        at = sorted(own.sample(range(1, 40), 6))
        rows.append((np.array([0, *at]), np.array([1.0, *(own.random() for _ in at)]), int(sum(at) % 3 == 0)))
    z, n = [0.0] * 40, [0.0] * 40
    a, b, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2

    def weight(i: int) -> float:
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(2):
        for at, x, y in rows:
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, x, strict=True))))
            for i, v in zip(at, x, strict=True):
                g, w = (p - y) * v, weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w
                n[i] += g * g
    got = quality_classifier.ftrl(rows, 2)
    assert np.allclose(got[:40], [weight(i) for i in range(40)], atol=1e-6) and not got[40:].any()


def test_rules_are_learned_and_pruned(spark):
    own = random.Random(5)
    rows = []
    for _ in range(900):  # bad: many symbols, or short words in texts with repeats; the rest is noise
        r = {f: own.random() for f in quality_rules.FEATURES}
        r["bad"] = r["symbol_rate"] > 0.8 or (r["repeat_rate"] > 0.7 and r["word_length"] <= 0.3)
        rows.append((*r.values(), own.random() < 0.67))
    data = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in quality_rules.FEATURES) + ", bad boolean, grow boolean").cache()
    rules = quality_rules.learn_rules(data)
    assert {(c.feature, c.above) for c in rules[0]} == {("symbol_rate", True)}  # thresholds are quantiles: two may be needed
    assert {(c.feature, c.above) for c in rules[1]} == {("repeat_rate", True), ("word_length", False)}
    said = F.lit(False)
    for rule in rules:
        said = said | quality_rules.holds(rule)
    counts = {(r["said"], r["bad"]): r["count"] for r in data.groupBy(said.alias("said"), "bad").count().collect()}
    assert counts.get((True, False), 0) <= 0.05 * counts[True, True] and counts.get((False, True), 0) <= 0.25 * counts[True, True]
    assert quality_rules.learn_rules(data.withColumn("bad", F.lit(False))) == []


def test_tiers_gaps_and_steps():
    own = random.Random(2)
    items = [(slot, 0, own.choice((own.randint(1, 200), own.randint(200, 1100), own.randint(1500, 9000)))) for slot in range(400)]
    for last in (False, True):
        windows, rest = packing.pack_block(items, packing.TIERS, last)
        pieces = [p for w in [*windows, rest] for p in w]
        ids = Counter((slot, start + k) for slot, start, n in pieces for k in range(n))
        assert set(ids.values()) == {1} and len(ids) == sum(n for _, _, n in items)  # each id once
        sizes = Counter(sum(n for _, _, n in w) for w in windows)
        assert all(size in packing.TIERS or (last and size < 256 and size & (size - 1) == 0) for size in sizes)
        assert all(sizes[c] for c in packing.TIERS[1:]) and sum(n for _, _, n in rest) < (1 if last else 256)
        # long windows are whole, or a remainder of over half of it whose gap shorter documents fill
        for w in windows:
            if sum(n for _, _, n in w) == 2048 and len(w) > 1:
                assert w[0][2] > 1024 and all(items[slot][2] % 2048 <= 1024 for slot, _, _ in w[1:])
    lengths = [own.choice(packing.TIERS) for _ in range(500)]
    step = packing.step_groups(lengths, 1 << 14)
    cost = Counter()
    for g, n in zip(step, lengths, strict=True):
        cost[g] += n * n
    assert len(cost) == round(sum(lengths) / (1 << 14)) and max(cost.values()) - min(cost.values()) <= 2048**2


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import types as T

    own = random.Random(21)
    words = [f"w{k}" for k in range(600)]
    text = lambda n: " ".join(own.choices(words, k=n))
    good = [text(own.randint(20, 200)) for _ in range(120)]
    good += [good[0].upper(), good[1], good[2] + " more", good[3] + " x"] + [" ".join(["edit", str(k), *good[4].split()]) for k in range(4)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t)) for i, t in enumerate(good)]
    rows += [(1000 + i, " ".join(f"##{w}$$" for w in text(60).split()), "en", "a", 1) for i in range(60)] + [(2000, None, None, None, None), (2001, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(r[0], int(r[0] < 1000), 0) for r in rows if r[0] < 2000]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}, [f.name for f in T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == names
            docs.write.parquet(f"{tmp_path}/{name.replace(' ', '')}.parquet")
            docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}.parquet")
        seen[name] = [tuple(r) for r in docs.collect()]
    # quality: what was labelled bad goes, what was labelled good stays
    kept = {r[0] for r in seen["quality classifier"]}
    assert kept - {2000, 2001} == set(range(len(good)))
    # exact: the largest id of each text
    last = {}
    for r in seen["quality classifier"]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        last[low] = max(last.get(low, -1), r[0])
    assert {r[0] for r in seen["exact dedup"]} == set(last.values()) and len(seen["exact dedup"]) == len(last)
    # near: the smallest id of each component over all pairs
    want = {b for _, b in resembling([(r[0], r[1] or "") for r in seen["exact dedup"]])}
    assert {r[0] for r in seen["simhash near dedup"]} == want and len(want) < len(last)
    # mix: whole copies, at most two of each, near the targets of the weights
    copies, size, source = Counter(r[0] for r in seen["mixing"]), {}, {}
    for r in seen["simhash near dedup"]:
        size[r[0]], source[r[0]] = len(WORD.findall(r[1] or "")), r[3]
    assert set(copies) <= want and max(copies.values()) <= 2
    taken, held = Counter(), Counter()
    for i, n in size.items():
        taken[source[i]] += copies[i] * n
        held[source[i]] += n
    weights, target, open_ = {"a": 3, "b": 1, None: 2}, {}, set(held)
    rest = 1.5 * sum(held.values())
    while open_:
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * held[s]}
        target |= {s: 2.0 * held[s] for s in full} if full else share
        rest -= sum(2.0 * held[s] for s in full)
        open_ = open_ - full if full else set()
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in held)
    # packing: every copy's ids once, in sequences without gaps
    pieces, filled = {}, {}
    for doc, start, length, _, tokens, sequence, offset, *_ in seen["packing"]:
        pieces.setdefault((doc, tokens), []).append((start, length))
        filled.setdefault(sequence, []).append((offset, length))
    for (doc, tokens), own_pieces in pieces.items():
        assert sum(n for _, n in own_pieces) == tokens * copies[doc] and Counter(k for a, n in own_pieces for k in range(a, a + n)) == Counter({k: copies[doc] for k in range(tokens)})
    assert {d for d, _ in pieces} == set(copies)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    # the registered query runs the same stages
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id", "start").count().filter("start = 0").collect()).keys() == copies.keys()


def test_ngram_passes_count_all_and_leave_nothing(docs, monkeypatch):
    few, before = docs.filter("doc_id < 68"), docs.sparkSession.conf.get(ngram_model.FREED, None)
    scores = lambda: {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in ngram_model.score_documents(few).collect()}
    whole = scores()  # one part, one pass
    monkeypatch.setattr(ngram_model, "PART_BYTES", 2048)
    monkeypatch.setattr(ngram_model, "PASSES", 4)
    monkeypatch.setattr(ngram_model, "FLUSH", 500)
    parts = scores()
    assert whole.keys() == parts.keys() and all(np.allclose(whole[i], parts[i], rtol=1e-9) for i in whole)
    left = {name.split("-")[0] for name in os.listdir(ngram_model.train(few).folder)}
    assert left == {"u", "g1", "g2", "g3"}  # no rows between the rounds
    assert docs.sparkSession.conf.get(ngram_model.FREED, None) == before


def test_ngram_words_end_with_texts_and_at_ascii_space():
    import pyarrow as pa

    texts = ["", " ", "a", "b", "  A  b ", "É\x1cx\x00 x", "a\x0b\x0cb\r\nc", "x" * 300 + " " + "x" * 256, "x" * 300, "\n"]
    expected = [[*t.encode().lower().split(), b"\n"] for t in texts]
    tokens, lengths = ngram_model.token_stream(pa.array(["cut off", *texts]).slice(1))
    assert lengths.tolist() == [len(w) for w in expected]
    flat = [w for words in expected for w in words]
    assert len({*zip(flat, tokens.tolist(), strict=True)}) == len({*flat}) == len(np.unique(tokens))


def test_ngram_scoring_opens_a_part_once_for_many_texts(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_model, "PART_BYTES", 2048)
    monkeypatch.setattr(ngram_model, "OPEN_PARTS", 4)
    model = ngram_model.train(docs.filter("doc_id < 68"))
    opened, exists = [], os.path.exists
    monkeypatch.setattr(ngram_model.os.path, "exists", lambda path: opened.append(path) or exists(path))
    texts = [f"{r[1] or ''} {k}" for k in range(40) for r in ROWS if len(r[1] or "") < 1000]
    rows = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([False]), pa.array([t])], names=["doc_id", "held_out", "text"]) for i, t in enumerate(texts)]
    out = pa.Table.from_batches(ngram_model.scored(iter(rows), model))
    calls = -(-sum(out["n_tokens"].to_pylist()) // ngram_model.ROOM)
    assert out["doc_id"].to_pylist() == list(range(len(texts))) and model.bits > 3 and len(texts) > 1000
    # the parts of four kinds, each once a call, and those of the start marks
    assert len(opened) <= calls * 4 * (1 << model.bits) + 4
    alone = ngram_model.Scorer(model)
    for i in (0, 700, len(texts) - 1):
        assert out["score"][i].as_py() == pytest.approx(alone(*ngram_model.token_stream(pa.array([texts[i]])))[2][0])


@pytest.mark.parametrize("far", [78, 0])
def test_near_copies_lose_no_pair_at_the_limit(spark, monkeypatch, far):
    """Pairs at a cosine of exactly 0.8, whatever bands and bits find of them, and pairs just below."""
    monkeypatch.setattr(near_copies, "FAR", far)
    own, rows = random.Random(5), []
    word = iter(range(1 << 30))
    fresh = lambda n: [f"u{next(word)}" for _ in range(n)]
    for k in range(250):  # sets of 25 of which 20 are shared, of 45 (36), 25 and 16 (16: exactly 0.8), and of 45 (35)
        a, b, n = ((25, 25, 20), (45, 45, 36), (25, 16, 16), (45, 45, 35))[k % 4]
        text = fresh(n + 4)
        rows += [" ".join(text + fresh(a - n)), " ".join(fresh(b - n) + text)]
    passage = fresh(44)  # a crowd: all share 40 shingles of 50, a few also lie under the limit
    rows += [" ".join(passage + fresh(own.choice((9, 10, 11)))) for _ in range(45)]
    own.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {(r["id"], r["keep_id"]) for r in near_copies.near_groups(docs).collect()} == resembling(list(enumerate(rows)))
