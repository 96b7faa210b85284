"""Tables of JSON texts whose shape is not known beforehand.

Every array path of the texts makes a table, one row per element; the root makes the table ``@`` with a row per text. A
table's own columns come first and those of its parents after them. Shapes are found by an aggregate over all texts
(the merged schema of their variants, combined before it is shuffled); only where one path holds objects in some texts
and other values elsewhere are the objects and the arrays at that path asked for once more, those of all paths together.
Texts are read once for each such level and then by each table, so texts that are dear to make should be written first. Rows are made by exploding
one array path after another, lazily and without a shuffle.

Names are JSON paths: ``@.items.*.qty``; a key with a dot or a bracket stands in brackets. Cells are text. An array shows as
``[Array n]``, an object has no cell of its own, and the column ``#`` numbers the elements that are objects. Keys are in the
order of the variant, by name. A null text and one that is no JSON make a root row without values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Shape:
    """What a path holds: plain values, objects (their keys), arrays (their elements), or several of these."""

    plain: bool = False
    fields: dict[str, Shape] | None = None
    element: Shape | None = None


@dataclass
class JsonTable:
    name: str
    columns: list[str]
    frame: DataFrame
    parent: str | None = None
    own: list[str] = field(default_factory=list)


def _step(path: str, key: str) -> str:
    """The path of a key below a path."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
        return f"{path}.{key}"
    return f"{path}['{key}']" if "'" not in key else f'{path}["{key}"]'


def _named(key: str) -> str:
    return f"[{key}]" if re.search(r"[.\[\]*#]", key) else key


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _array(value: Column, path: str) -> Column:
    return _get(value, path, "array<variant>")


def _object(value: Column, path: str = "$") -> Column:
    return _get(value, path, "map<string,variant>")


def _parsed(ddl: str) -> T.DataType:
    """The type that a schema of variants names; quoted keys stay as they are."""
    struct = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], ddl)
    return T.DataType.fromDDL(struct)


@dataclass
class _Open:
    """A path of a frame that holds objects in some rows and other values elsewhere, and its shape."""

    frame: DataFrame
    value: Column
    path: str
    shape: Shape


def discover(frame: DataFrame, value: Column) -> Shape:
    """The shape of a variant column over all rows: one pass, and one more per level of mixed paths and frame."""
    out, todo = Shape(), []
    _fill(out, frame.agg(F.schema_of_variant_agg(value)).first()[0], frame, value, "$", todo)
    while todo:
        level, todo = todo, []
        for own in {id(o.frame): o.frame for o in level}.values():
            spots = [o for o in level if o.frame is own]
            at = own.select(*[_get(o.value, o.path).alias(f"_{i}") for i, o in enumerate(spots)])
            apart = [F.schema_of_variant_agg(F.when(test(F.col(f"_{i}"), "$").isNotNull(), F.col(f"_{i}"))) for i in range(len(spots)) for test in (_object, _array)]
            for j, found in enumerate(at.agg(*apart).first()):
                o = spots[j // 2]
                if found != "VOID":
                    _fill(o.shape, found, own, o.value, o.path, todo)
    return out


def _fill(shape: Shape, found: str | T.DataType | None, frame: DataFrame, value: Column, path: str, todo: list[_Open]) -> None:
    """Adds what a schema says to a shape; paths that it leaves open go to ``todo``."""
    kind = T.NullType() if found is None else _parsed(found) if isinstance(found, str) else found
    if isinstance(kind, T.StructType):
        shape.fields = {f.name: Shape() for f in kind.fields}
        for f in kind.fields:
            _fill(shape.fields[f.name], f.dataType, frame, value, _step(path, f.name), todo)
    elif isinstance(kind, T.ArrayType):
        shape.element, inner = Shape(), kind.elementType
        if "variant" in inner.simpleString():
            frame, value = frame.select(F.explode(_array(value, path)).alias("_each")), F.col("_each")
        _fill(shape.element, inner, frame, value, "$", todo)
    else:
        shape.plain = True  # in an open path: numbers beside texts, say; nulls count too
        if isinstance(kind, T.VariantType):
            todo.append(_Open(frame, value, path, shape))


def _cell(value: Column, path: str, shape: Shape) -> Column | None:
    """The text of a path's own cell; none where it holds objects alone."""
    out = None
    if shape.plain:
        out = _get(value, path, "string")
        if shape.fields is not None:
            out = F.when(_object(value, path).isNull(), out)
    if shape.element is not None:
        array = _array(value, path)
        shown = F.when(array.isNotNull(), F.concat(F.lit("[Array "), F.size(array).cast("string"), F.lit("]")))
        out = shown if out is None else shown.otherwise(out)
    return out


def json_family(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> dict[str, JsonTable]:
    """All tables of a column of JSON texts, a parent before its children; ``keys`` are columns that every table carries last."""
    frame = texts.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.try_parse_json(F.col(f"`{column}`")).alias("_v"))
    out: dict[str, JsonTable] = {}

    def visit(frame: DataFrame, shape: Shape, name: str, parent: str | None, above: list[tuple[str, str]], element: bool) -> None:
        # columns are numbered inside, as keys may differ in the case of letters alone
        own: list[tuple[str, Column]] = []
        arrays: list[tuple[str, str, Shape]] = []

        def walk(shape: Shape, path: str, label: str) -> None:
            cell = _cell(F.col("_v"), path, shape)
            if cell is not None:
                own.append((label, cell))
            for key, inner in (shape.fields or {}).items():
                walk(inner, _step(path, key), f"{label}.{_named(key)}")
            if shape.element is not None:
                arrays.append((label, path, shape.element))

        walk(shape, "$", name)
        if element and shape.fields is not None:
            own.append((f"{name}.#", F.when(_object(F.col("_v")).isNotNull(), F.col("_i"))))
        inner = [(f"c{len(out)}_{i}", label) for i, (label, _) in enumerate(own)]
        held = frame.select(*[c.alias(i) for (i, _), (_, c) in zip(inner, own, strict=True)], *[i for i, _ in above], "_v")
        columns = [*inner, *above]
        out[name] = JsonTable(name, [label for _, label in columns], held.select(*[i for i, _ in columns]).toDF(*[label for _, label in columns]), parent, [label for _, label in inner])
        for label, path, deeper in arrays:
            rows = held.select(*[i for i, _ in columns], F.posexplode(_array(F.col("_v"), path)).alias("_i", "_v"))
            visit(rows, deeper, f"{label}.*", name, columns, True)

    visit(frame, discover(frame, F.col("_v")), "@", None, [(f"k{i}", k) for i, k in enumerate(keys)], False)
    return out


def filled(tables: dict[str, JsonTable]) -> DataFrame:
    """(name, column, filled): how many rows of a table have a value in each of its own columns; one aggregate a table."""
    out = None
    for t in tables.values():
        if not t.own:
            continue
        numbered = t.frame.toDF(*[f"c{i}" for i in range(len(t.columns))])
        one = numbered.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(t.own))])
        pairs = F.array(*[F.struct(F.lit(label).alias("column"), F.col(f"c{i}").alias("filled")) for i, label in enumerate(t.own)])
        rows = one.select(F.lit(t.name).alias("name"), F.inline(pairs))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no table has a column of its own")
    return out
