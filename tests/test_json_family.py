"""JSON texts of unknown shape against a plain walk over the parsed texts."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from opalgrid.operators import json_family as jf


def walk(texts):
    """Tables as {name: (columns, rows)}: a row as {column: text}, own columns and inherited ones together."""
    tables: dict[str, list[dict]] = {}

    def shown(v):
        if isinstance(v, list):
            return f"[Array {len(v)}]"
        return {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else None if v is None else str(v)

    def visit(value, name, above, at):
        row, arrays = {}, []

        def cells(v, label):
            if isinstance(v, dict):
                for k, x in v.items():
                    cells(x, f"{label}.{k}")
            else:
                row[label] = shown(v)
                if isinstance(v, list):
                    arrays.append((label, v))

        cells(value, name)
        if at is not None and isinstance(value, dict):
            row[f"{name}.#"] = str(at)
        row |= above
        tables.setdefault(name, []).append(row)
        for label, items in arrays:
            for i, x in enumerate(items):
                visit(x, f"{label}.*", row, i)

    for key, text in texts:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            value = None
        visit(value, "@", {"key": str(key)}, None)
    return tables


def check(spark, values):
    texts = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    got = jf.json_family(spark.createDataFrame(texts, "key long, text string").repartition(2), "text", ["key"])
    want = walk(texts)
    assert {n for n in got} >= set(want)
    for name, table in got.items():
        rows = [dict(zip(table.columns, map(lambda v: None if v is None else str(v), r), strict=True)) for r in table.frame.collect()]
        bare = lambda rs: sorted(json.dumps({k: v for k, v in sorted(r.items()) if v is not None}) for r in rs)
        assert bare(rows) == bare(want.get(name, []))
    return got


def test_tables_columns_and_parents(spark):
    got = check(spark, [{"a": {"b": 1}, "items": [{"x": 1, "tags": ["p", "q"]}, {"x": 2, "tags": []}]}, {"a": {"b": 2}, "items": []}])
    assert list(got) == ["@", "@.items.*", "@.items.*.tags.*"]
    assert got["@.items.*.tags.*"].columns == ["@.items.*.tags.*", "@.items.*.tags", "@.items.*.x", "@.items.*.#", "@.a.b", "@.items", "key"]
    assert got["@.items.*"].parent == "@"


def test_paths_that_hold_different_kinds(spark):
    check(spark, [{"a": 1}, {"a": {"b": 2}}, {"a": [3, {"c": 4}, [5, "six"]]}, {"a": "text"}, {"a": None}, {}, [], [1, [2]], 7, "x", None, "{broken"])


def test_odd_keys(spark):
    check(spark, [{"k k": 1, "K": 2, "k": 3, "'": 4, "é": [{"A": 1, "a": 2}], "": 5}])
    got = jf.json_family(spark.createDataFrame([('{"a.b": 1, "a": {"b": 2}, "#": 3}',)], "text string"), "text")["@"]
    assert sorted(zip(got.columns, got.frame.first(), strict=True)) == [("@.[#]", "3"), ("@.[a.b]", "1"), ("@.a.b", "2")]


def test_nothing_and_depth(spark):
    empty = jf.json_family(spark.createDataFrame([], "text string"), "text")
    assert list(empty) == ["@"] and empty["@"].frame.count() == 0
    deep: object = 1
    for _ in range(12):
        deep = [deep]
    assert len(check(spark, [deep])) == 13


scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", "a", "b c"])
values = st.recursive(scalars, lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "cd"]), inner, max_size=3), max_leaves=8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, min_size=1, max_size=4))
def test_any_texts(spark, texts):
    check(spark, [json.dumps(t) for t in texts])


@pytest.mark.parametrize("key", ["tbl_json_unknown", "tbl_json_props"])
def test_rows_are_made_without_a_shuffle_of_their_own(spark, key):
    from opalgrid.plans import registry

    plan = registry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= (2 if key == "tbl_json_unknown" else 0)


def test_shapes_take_a_pass_per_level_of_mixed_paths(spark, monkeypatch):
    passes, kind = [], type(spark.range(1))
    first = kind.first
    monkeypatch.setattr(kind, "first", lambda self: passes.append("first") or first(self))
    monkeypatch.setattr(kind, "isEmpty", lambda self: pytest.fail("a pass for a single path"))
    rows = [{"a": 1, "b": 2}, {"a": {"x": 1}, "b": {"y": {"z": 1}}}, {"a": [1, {"c": 2}], "b": {"y": 3}}]
    check(spark, rows)
    # the root; a and b together; b.y beside them and the elements of a
    assert len(passes) == 4


def test_order_texts_are_made_once(spark):
    from opalgrid.plans import registry

    plan = registry.queries()["tbl_json_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "collect_list" not in plan and "Join" not in plan
