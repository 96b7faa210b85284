"""Hard negatives, archives and cut documents against brute force, and on odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opalgrid.llm import fill_in_middle, hard_negatives, oracle, queries, warc

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    plain = lambda f: sorted(map(tuple, f[sorted(f)].astype(object).where(f[sorted(f)].notna(), None).map(lambda v: None if v is None else str(int(v)) if isinstance(v, float) else str(v)).values.tolist()), key=str)
    assert plain(queries.QUERIES[name](spark, SMALL).toPandas()) == plain(con.sql(oracle.SQL[name]).df())


# hard negatives


def brute_negatives(rows, every, most=5, k=10):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in rows if j != i]
        for neg, j, _ in sorted(x for x in scored if x[2] == lab)[:most]:
            fits = sorted(x for x in scored if x[2] != lab and 30 * -neg <= 100 * -x[0] <= 90 * -neg)[:k]
            out += [(i, j, rank, n, -neg, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(seed):
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(12, 8))
    rows = [(i, int(gen.integers(0, 4)), [float(np.float32(x)) for x in centres[i % 12] + 0.05 * gen.normal(size=8)]) for i in range(400)]
    same = rows[40][2]
    rows += [(1000 + i, i % 3, same) for i in range(200)]  # a third of all rows bear one vector
    rows += [(7, 2, rows[3][2]), (20, 1, rows[20][2]), (20, 1, rows[20][2]), (601, 1, [0.0] * 8), (602, 2, []), (603, 1, [0.5, -0.25])]
    rows += [(None, 1, same), (604, None, same), (605, 1, None), (620, 1, [None, *same[1:]]), (640, 1, [math.nan, *same[1:]]), (660, 1, [*same[1:], math.inf]), (680, 1, [3000.0] * 8)]
    return rows


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(5)
    frame = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, lab, v in rows], "vec_id long, embedding array<float>, label int, cell string, pivot int, block int").repartition(3)
    got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0).collect()
    want = brute_negatives(rows, 20)
    assert sorted(map(tuple, got)) == want and len(want) > 1000
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(frame, F.col("vec_id") < 0).count() == 0


def test_search_leaves_out_far_cells(spark):
    rows = [(i, i % 2, [float(100 * (i % 40)), float(i // 40)]) for i in range(4000)]
    points = hard_negatives.usable(spark.createDataFrame(rows, "id long, label int, vec array<double>"), "id", "vec", "label")
    index = hard_negatives.build_index(points)
    blocks = hard_negatives.query_blocks(index, points.filter("id = 3999"))
    asked = blocks.select("block", "reach", "vecs", F.array(F.lit(0)).alias("places"), F.array(F.lit(0)).alias("wins"), F.array(F.lit(-hard_negatives.FAR)).alias("lows"), F.array(F.lit(hard_negatives.FAR)).alias("highs"))
    near = hard_negatives._shells(index, asked, index.longest / 16).join(index.cells.select("cell", "pivot", F.col("lo").alias("l"), F.col("hi").alias("h")), "pivot").filter("lo <= h and l <= hi")
    assert 0 < near.count() < index.cells.count() / 2
    assert index.cells.select(F.sum(F.size("ids"))).first()[0] == 4000


def test_vectors_that_are_too_long_are_refused(spark):
    frame = spark.createDataFrame([(0, [0.0] * 9000, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="8192"):
        hard_negatives.mine(frame, F.col("vec_id") == 0)


# archives


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_of_odd_pages(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh <>\n") for _ in range(3_000_000))
    rows = [(1, "http://a/x\r\ny z", "one"), (2, None, "two"), (3, "http://b", "one"), (4, "u", None), (5, "u", ""), (6, "http://é.example", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, "v", long)]
    rows += [(8, "v", "three"), (8, "w", "three"), (8, "w", "four"), (None, "n", "three"), (None, "n", "five"), (None, "n", "five")] + [(100 + i, "hot", "same") for i in range(300)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, archive string, payload string").repartition(5)
    got = sorted(map(tuple, warc.round_trip(frame).collect()), key=str)
    want = []
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        keep = max((j for j in same if j is not None), default=None)
        raw = (html or "").encode()
        want.append((i, len(raw), sha(raw), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_members_stand_alone_and_heads_are_sound(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"http://h/{i}\n{i}", f"<p>{i}</p>" * (i % 50)) for i in range(500)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, f"file://{tmp_path}/in", records=200)
    parts = sorted((tmp_path / "in").glob("*.gz"))
    assert len(parts) == 3
    for p in parts:  # one stream a file
        d = zlib.decompressobj(31)
        d.decompress(p.read_bytes())
        assert d.eof and not d.unused_data
    done = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert sum(r["records"] for r in done) == 500 and not any(r["truncated"] for r in done)
    index = warc.read_index(spark, f"file://{tmp_path}/out").toPandas()
    for name, own in index.groupby("archive"):
        raw = open(name.removeprefix("file://"), "rb").read()
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(raw)
        for _, e in own.iterrows():
            record = gzip.decompress(raw[e.offset : e.offset + e.length])
            head, _, rest = record.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and b"%0A" in head and len(rest) == e.block_bytes + 4 and rest.endswith(b"\r\n\r\n")
    back = warc.read_records(warc.read_index(spark, f"file://{tmp_path}/out")).toPandas()
    shown = {r.record_id: bytes(r.payload) for r in back.itertuples() if r.record_type == "response"}
    assert set(index.refers_to.dropna()) <= set(shown) and all(r.refers_to in shown for r in back.itertuples() if r.record_type == "revisit")
    again = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out2").collect()
    one, two = (sorted(hashlib.sha1(open(r["archive"].removeprefix("file://"), "rb").read()).hexdigest() for r in x) for x in (done, again))
    assert one == two  # a second run writes the same bytes


def records(*blocks: bytes) -> list[bytes]:
    return [b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]


@pytest.mark.parametrize("how", ["plain", "one", "members", "padded", "tiny"])
def test_normaliser_reads_every_kind_of_archive(how, monkeypatch):
    blocks = [b"a", b"", b"\r\n\r\nWARC/1.0\r\n", bytes(range(256)) * 5000, b"end"]
    made = records(*blocks)
    raw = {"plain": b"".join(made), "one": gzip.compress(b"".join(made)), "members": b"".join(map(gzip.compress, made)), "padded": (b"\0" * 100).join(map(gzip.compress, made)) + b"\0" * 9, "tiny": gzip.compress(b"".join(made))}[how]
    if how == "tiny":
        monkeypatch.setattr(warc, "BLOCK", 7)
        blocks = blocks[:3]
        raw = gzip.compress(b"".join(records(*blocks)))
    sink = io.BytesIO()
    entries = list(warc.normalise_stream(io.BytesIO(raw), sink))
    assert [gzip.decompress(sink.getvalue()[e["offset"] : e["offset"] + e["length"]]).partition(b"\r\n\r\n")[2][:-4] for e in entries] == blocks
    assert list(warc.normalise_stream(io.BytesIO(b""), io.BytesIO())) == []


@pytest.mark.parametrize("cut", [3, 40, 200, 2000, 300_000])
def test_normaliser_keeps_what_precedes_a_broken_end(cut):
    gen = np.random.default_rng(3)
    blocks = [b"first", gen.bytes(1000), gen.bytes(900_000)]
    whole = gzip.compress(b"".join(records(*blocks)))
    for raw in (whole[: len(whole) - cut], b"".join(records(*blocks))[:-cut], whole[:-cut] + b"x" * cut):
        sink = io.BytesIO()
        entries = list(warc.normalise_stream(io.BytesIO(raw), sink))
        good = [e for e in entries if "offset" in e]
        assert 2 <= len(good) <= 3 and (entries[-1] == {"truncated": True} or len(good) == 3)
        assert [gzip.decompress(sink.getvalue()[e["offset"] : e["offset"] + e["length"]]).partition(b"\r\n\r\n")[2][:-4] for e in good] == blocks[: len(good)]
        gzip.decompress(sink.getvalue())  # whatever was written is sound


# cut documents


def brute_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(9)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "é\n漢字\n😀x\n", "<P>", "x<S>y\nz", "<\nP>", "<M", ">", "<P", ">\n<S>", "\r\n\r\n", "x" * 300_000, "ab\n" * 100_000]
    return texts + ["".join(rng.choice("ab\né😀 <P>") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_cuts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(5, "other\ntext"), (5, "other\ntext"), (None, "no\nid\nat\nall")]
    frame = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    out = fill_in_middle.transform(frame)
    assert sorted(map(tuple, out.collect()), key=str) == sorted((brute_cut(*r) for r in rows), key=str)
    rebuilt = out.select("doc_id", fill_in_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, rebuilt), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fill_in_middle.report(frame.limit(0)).count() == 0


def test_rates_and_other_marks(spark):
    frame = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    forms = {r["form"]: r["count"] for r in fill_in_middle.transform(frame, rate=40, spm=25, marks=("[pre]", "[suf]", "[mid]")).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2400) < 150 and abs(forms["spm"] - 400) < 80
    out = fill_in_middle.transform(frame, marks=("[pre]", "[suf]", "[mid]")).filter("form = 'psm'").first()["output"]
    assert out.startswith("[pre]") and "[suf]" in out and "[mid]" in out


@pytest.mark.parametrize("chunk", [1, 50, 4 << 20])
def test_kernel_on_slices_and_runs(monkeypatch, chunk):
    monkeypatch.setattr(fill_in_middle, "CHUNK_BYTES", chunk)
    texts = [t or "" for t in odd_texts()][3:]
    for kind in (pa.string(), pa.large_string()):
        n = len(texts)
        h1, h2 = np.arange(n) * 7919, np.arange(n) * 104729
        form = np.array([0 if not t or any(m in t for m in fill_in_middle.MARKS) else 1 + i % 2 for i, t in enumerate(texts)], dtype=np.int32)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts, type=kind), pa.array(form), pa.array(h1), pa.array(h2)], ["id", "text", "form", "h1", "h2"]).slice(2, n - 5)
        out = pd.concat(b.to_pandas() for b in fill_in_middle.transform_batch(batch, [m.encode() for m in fill_in_middle.MARKS]))
        for row in out.itertuples():
            units = re.findall(r"[^\n]*\n|[^\n]+", texts[row.id])
            lo, hi = sorted((int(h1[row.id]) % (len(units) + 1), int(h2[row.id]) % (len(units) + 1)))
            p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
            assert row.n == len(units) and row.output == {"plain": texts[row.id], "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[row.form]
