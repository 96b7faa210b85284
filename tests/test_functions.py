"""Hand-made cases of functions and operators."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opalgrid.catalog import run_plan
from opalgrid.functions import dates
from opalgrid.functions import text as tx
from opalgrid.operators import graph as gr
from opalgrid.operators import merges as mg
from opalgrid.operators import ranking as rk
from opalgrid.operators import tables as tb
from opalgrid.sources import text as src


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("minutes", "words"), [(0.5, "Less than a minute"), (1, "1 minute"), (61, "1 hour 1 minute"), (1500, "1 day 1 hour"), (45000, "1 month 1 day 6 hours")])
def test_duration(spark, minutes, words):
    assert one(spark, tx.format_duration(F.lit(float(minutes)))) == words


@pytest.mark.parametrize(("rid", "ok"), [("001000000000001", True), ("000000000000001", False), ("abcdefghijklmno", False), ("a1b2c3d4e5f6g7h8", True)])
def test_record_id(spark, rid, ok):
    assert one(spark, tx.is_record_id(F.lit(rid))) is ok


@pytest.mark.parametrize(("url", "short"), [("/services/data/v66.0/query/01gABC-2000?x=1", "/services/data/v66.0/query/"), ("/services/data/v66.0/sobjects/Account/001000000000001AAA?cache=0.1", "/services/data/v66.0/sobjects/Account/{id}")])
def test_simplify_url(spark, url, short):
    assert one(spark, tx.simplify_url(F.lit(url))) == short


@pytest.mark.parametrize(("label", "pascal", "name"), [("my field-name 2", True, "myFieldName2"), ("my field-name 2", False, "my_field_name_2")])
def test_api_name(spark, label, pascal, name):
    assert one(spark, tx.api_name(F.lit(label), pascal)) == name


@pytest.mark.parametrize(("op", "action"), [(None, "-"), ("CODE_UNIT_STARTED", "-"), ("Aura/Foo", "Aura · Foo"), ("VF:Bar", "VF · Bar"), ("Batch", "Batch")])
def test_parse_action(spark, op, action):
    assert one(spark, tx.parse_action(F.lit(op).cast("string"))) == action


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('a,b\n"x,1","y""z"\n', [["a", "b"], ["x,1", 'y"z']]), ('"abc', "Quote not closed"), ("", "no data"), ("a,b\n1", "row 2 has 1 cells, expected 2"), ("a\r\nb", [["a"], ["b"]]),
    ],
)
def test_csv(spark, text, rows):
    got = src.parse_csv_text(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("row").collect()
    assert ([r["cells"] for r in got] if isinstance(rows, list) else got[0]["error"]) == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00\r"), max_size=6), min_size=2, max_size=2), min_size=1, max_size=4))
def test_csv_round_trip(cells):
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in row) for row in cells)
    assert [r for _, r, _ in src._rows(text, ",")] == cells


@settings(max_examples=80, deadline=None)
@given(st.dates(date(1990, 1, 1), date(2030, 12, 31)), st.sampled_from(["WEEK", "MONTH", "QUARTER", "YEAR", "FISCAL_QUARTER", "FISCAL_YEAR"]), st.integers(1, 12))
def test_units_adjoin(anchor, unit, start):
    ends = [dates.date_range(f"{w}_{unit}", anchor, fiscal_start=start) for w in ("LAST", "THIS", "NEXT")]
    assert ends[0][1] == ends[1][0] <= anchor < ends[1][1] == ends[2][0]
    assert dates.date_range(f"LAST_N_{unit}S:1", anchor, fiscal_start=start) == ends[0]
    assert dates.date_range("N_DAYS_AGO:1", anchor) == (anchor - timedelta(days=1), anchor)


def test_usage_rounding(spark):
    rows = spark.range(30000).select(F.when(F.col("id") == 0, 1).alias("rare"), F.when(F.col("id") % 3 == 0, 1).alias("third"), F.lit(None).cast("int").alias("none"))
    got = {r["field"]: r["usage"] for r in tb.field_usage(rows).collect()}
    assert got == {"rare": 0.003, "third": 33.0, "none": 0.0}


def test_keep_latest(spark):
    rows = spark.createDataFrame([("f", v, v == 2) for v in range(1, 7)], "e string, v int, a boolean")
    assert {r["v"] for r in rk.keep_latest(rows, "e", "v", "a", 2).filter("keep").collect()} == {6, 5, 4, 2}


def test_history(spark):
    rows = spark.createDataFrame([("u", k, i) for i, k in enumerate("abcad")], "o string, k string, t int")
    assert [r["k"] for r in rk.recent_history(rows, "o", "k", "t", 3).orderBy("place").collect()] == ["d", "a", "c"]


def test_dependencies_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "a string, b string")
    got = {tuple(r) for r in gr.dependencies(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", "b", 1, False), ("a", "c", 1, False), ("b", "c", 2, True), ("c", "a", 2, True)}


def test_flatten_and_json_tables(spark):
    df = spark.sql("SELECT named_struct('id', 1, 'owner', named_struct('name', 'x'), 'rows', array(named_struct('v', 5), named_struct('v', 6))) AS doc")
    assert tb.flatten_records(df.select("doc.id", "doc.owner")).columns == ["id", "owner", "owner.name"]
    child = tb.json_tables(df)["@.rows.*"]
    assert [r["@.rows.*.v"] for r in child.collect()] == [5, 6]


def test_upsert_blank_sets_null(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, " "), (3, "c")], "k int, v string")
    assert {tuple(r) for r in mg.upsert(now, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}


def test_auto_sort(spark):
    numbers = spark.createDataFrame([("10",), ("9",), ("",), (None,)], "v string")
    assert [r["v"] for r in rk.auto_sort(numbers, "v").collect()][:2] == ["9", "10"]
    words = spark.createDataFrame([("10",), ("9",), ("x",)], "v string")
    assert [r["v"] for r in rk.auto_sort(words, "v").collect()] == ["10", "9", "x"]


HEAD = "64.0 APEX_CODE,FINEST\n09:00:00.1 (2)|"


@pytest.mark.parametrize(
    ("body", "action"),
    [
        (None, "Api"), ("no log at all", "Api"), (HEAD + "CODE_UNIT_STARTED|[EXTERNAL]|TRIGGERS", "TRIGGERS"), (HEAD + "METHOD_ENTRY|[1]|01p|alone(x)", "alone"),
        (HEAD + "METHOD_ENTRY|[1]|01p|ns.Cls.Cls(x)", "Cls (constructor)"), (HEAD + "CODE_UNIT_STARTED|[EXTERNAL]|execute_anonymous_apex", "execute_anonymous_apex"),
        (HEAD + "CODE_UNIT_STARTED|[EXTERNAL]|01q|first trigger event AfterInsert|__sfdc_trigger/AccTrg", "Trigger · first (AfterInsert)"),
        (HEAD + "CODE_UNIT_STARTED|[EXTERNAL]|01q|what ever|__sfdc_trigger/AccTrg", "Trigger · AccTrg"), (HEAD + "CODE_UNIT_STARTED|[EXTERNAL]|VF: /apex/page", "VF: /apex/page"),
    ],
)
def test_log_action(spark, body, action):
    assert one(spark, tx.derive_action(F.lit(body).cast("string"), F.lit("Api"))) == action


@pytest.mark.parametrize(
    ("text", "fields", "error"),
    [
        (None, None, None), ("", [], None), ("Field 1,Field1,Text", [(1, "Field 1", "Field1", "Text")], None), ("a;b;Date\r\n\r\nc;d", [(1, "a", "b", "Date")], None),
        ("a,b,Blob\nc,d,Text\ne,f,Bits", None, 'Invalid type "Bits" on line 3'),
    ],
)
def test_field_import(spark, text, fields, error):
    got = one(spark, src.import_fields(F.lit(text).cast("string")))
    assert (None if got["fields"] is None else [tuple(f) for f in got["fields"]], got["error"]) == (fields, error)


@pytest.mark.parametrize(
    ("text", "fields", "error"),
    [
        ("\n \na|b|Text|c,d,e\r\n|\t|x|\n", [(3, "a", "b", "Text")], None), ("a\tb\tUrl\n\nc\td", [(1, "a", "b", "Url")], None),
        (r"a\E;b$1;Email", [(1, r"a\E", "b$1", "Email")], None), ("a;b,c;d,Text", [(1, "a;b", "c;d", "Text")], None),
    ],
)
def test_field_import_of_odd_separators(spark, text, fields, error):
    test_field_import(spark, text, fields, error)


def test_field_import_reads_a_text_once(spark):
    frame = spark.createDataFrame([("a,b,Text",)], "t string").select(src.import_fields(F.col("t")).alias("r")).select("r.error", F.explode_outer("r.fields"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # the lines, the line that shows the separator, four separators, and the cells
    assert plan.count("split(") <= 7


@pytest.mark.parametrize(("text", "mended"), [("select a,, b,from  t", "select a, b from t"), ("x = 'a,,  b'  and y", "x = 'a,,  b' and y"), ("  ", "")])
def test_typos(spark, text, mended):
    assert one(spark, tx.mend_typos(F.lit(text))) == mended


def test_typos_of_a_long_text(spark):
    text = "select a,,  b,from t where x in (" + ",".join("'v,,  w'" for _ in range(100_000)) + ")  and  y = 'it"
    want = "select a, b from t where x in (" + ",".join("'v,,  w'" for _ in range(100_000)) + ")  and  y = 'it"
    got = one(spark, tx.mend_typos(F.lit(text)))
    # the last quote is open, so that what lies before it counts as a literal
    assert got.endswith("'it") and one(spark, tx.mend_typos(F.lit(text + "'"))) == want.replace(")  and  y", ") and y") + "'"


def test_repeated_headers_and_options(spark):
    assert one(spark, tx.headers_map(F.lit("A: 1\nB: 2\r\nA:3\nnone\n: x"))) == {"A": "3", "B": "2"}
    assert one(spark, mg.header_options(F.lit("o=1&a=x&a=y+z&&%zz=1&b"), "o")) == {"o": "1", "a": "y z", "": "", "b": ""}
    assert one(spark, mg.header_options(F.lit("x\no=1"), "o")) is None


def test_csv_quotes_and_long_cells(spark):
    long = "x" * 300_000
    texts = [(1, f'a,b\n"{long}","y""z\n"\n'), (2, 'a\n"b'), (3, 'a"b\nc'), (4, ""), (5, "a,b\nc")]
    rows = {(r["key"], r["row"]): (r["cells"], r["error"]) for r in src.parse_csv_text(spark.createDataFrame(texts, "k long, t string"), "k", "t").collect()}
    assert rows[("1", 1)] == ([long, 'y"z\n'], None) and rows[("2", 0)][1] == rows[("3", 0)][1] == "Quote not closed"
    assert rows[("4", 0)][1] == "no data" and "expected 2" in rows[("5", 0)][1]


def test_batches_within_groups(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 7 else "cold") for i in range(1, 1200)]
    got = rk.batches(spark.createDataFrame(rows, "k long, g string").repartition(5), "k", 100, ["g"]).collect()
    places, want = {}, set()
    for k, g in rows:
        want.add((k, g, places.get(g, 0) // 100))
        places[g] = places.get(g, 0) + 1
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("keys", ["one", "null", "half"])
def test_ordinals_of_one_key_in_all_rows(spark, keys):
    rows = [(5 if keys == "one" else None if keys == "null" else (7 if i % 2 else i), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, v long")
    one, two = (sorted(map(tuple, rk.ordinals(frame.repartition(n), "k").collect()), key=lambda r: r[2]) for n in (1, 6))
    assert one == two and [r[2] for r in one] == list(range(2000)) and [r[0] or 0 for r in one] == sorted(r[0] or 0 for r in rows)
    assert max(r["n"] for r in rk._ranged(frame, "k").groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("n")).collect()) < 1100


def test_secrets_need_what_is_tested_first():
    from opalgrid.plans.graphs import NEEDED, PATTERNS

    for rule, patterns in PATTERNS.items():
        for pattern, words in zip(patterns, NEEDED[rule], strict=True):
            # the pattern names the text itself, its words around an alternative, or one of a class of letters
            bare = pattern.lower().replace("\\", "")
            assert any(w in bare or all(part in bare for part in w.strip("_-=").split("_")) or w.startswith("gh") and "gh[puo]_" in bare for w in words), (pattern, words)


@pytest.mark.parametrize(("most", "names"), [(0, ["region"]), (2, ["region", "nation"]), (40, ["region", "nation", "part"])])
def test_plans_are_bounded(spark, most, names):
    plan = [{"object": "region"}, {"object": "secret"}, {"object": "nation", "fields": ["n_name", "x"]}, {"object": "part", "where": {"x": 1}}]
    got = run_plan(spark, "/root/testdata/sf0.001", plan, most)
    assert [n for n, _ in got] == names and (most < 2 or got[1][1].columns == ["n_name"])
