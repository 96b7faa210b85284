"""Import headers, and sketches that add up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opalgrid.operators import imports as im
from opalgrid.operators import sketches as sk


@pytest.mark.parametrize(("column", "field", "kind"), [("Status", "Status", None), ("Owner.Name", "Owner", None), ("Rel:Type:Ext", "RelId", "Type"), ("Rel__r:Type:Ext", "Rel__c", "Type"), ("a:b", "a", None)])
def test_headers(column, field, kind):
    head = im.parse_header(column)
    assert (head.field, head.kind) == (field, kind)


def test_references_of_odd_cells(spark):
    people = spark.createDataFrame([(1, "ann", "a@x"), (2, "bob", "b@x"), (3, "bob", None)], "id long, name string, mail string")
    rows = spark.createDataFrame([(1, "ann", "b@x", "v", "i"), (2, "bob", None, " ", "i"), (3, "", "zoe", None, "i"), (None, "ann", "a@x", "w", "i")], "Id long, n string, m string, s string, u string")
    rows = rows.toDF("Id", "Boss:person:name", "Peer__r:person:mail", "Status", "_note")
    got = {r["Id"]: (r["BossId"], r["Peer__c"], r["Status"], r["nulls"], r["unresolved"]) for r in im.resolve_references(rows, "Id", {"person": people}, {"person": "id"}).collect()}
    assert got == {
        1: ("1", "2", "v", [], []), 2: (None, None, " ", ["Peer__c", "Status"], ["Boss:person:name=bob"]), 3: (None, None, None, ["BossId", "Status"], ["Peer__r:person:mail=zoe"]), None: (None, None, "w", [], []),
    }
    plain = im.resolve_references(rows.select("Id", "Status"), "Id", {}, {})
    assert plain.columns == ["Id", "Status", "nulls", "unresolved"] and plain.count() == 4
    with pytest.raises(LookupError):
        im.resolve_references(rows, "Id", {}, {})


def test_edits_of_blank_and_equal_fields(spark):
    row = spark.sql("select named_struct('a', 'x', 'b', null, 'c', 'y', 'd', '1') as old, named_struct('a', 'x', 'b', '', 'c', '', 'd', '2') as new")
    got = row.select(im.edits("abcd", "old", "new").alias("u"), im.edits("abcd", "old", "new", create=True).alias("c")).first()
    assert [tuple(e) for e in got["u"]] == [("c", None), ("d", "2")] and [tuple(e) for e in got["c"]] == [("a", "x"), ("d", "2")]


def test_sketches_add_up(spark):
    days = spark.range(0, 60_000).select(F.expr("date'2024-01-01' + cast(id % 30 as int)").alias("d"), (F.col("id") % 20_000).alias("v")).unionByName(spark.createDataFrame([(None,)], "v long").select(F.expr("date'2024-03-01'").alias("d"), "v"))
    sketches = sk.daily_sketches(days, F.col("d"), "v")
    got = {r["m"]: r["estimate"] for r in sk.distinct_over(sketches, F.month("day").alias("m")).collect()}
    assert abs(got[1] - 20_000) <= 3 * sk.ERROR * 20_000 and got[3] == 0
    week = "{} < date'2024-01-08'"
    exact = days.filter(week.format("d")).agg(F.count_distinct("v")).first()[0]
    assert abs(sk.distinct_over(sketches.filter(week.format("day"))).first()["estimate"] - exact) <= 3 * sk.ERROR * exact
