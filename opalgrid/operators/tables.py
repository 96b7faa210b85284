"""Operators that shape tables: flattening, filtering, unpivoting, serialising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.functions.text import cell_text


def leaf_paths(schema: T.StructType, prefix: str = "", parents: bool = False, ignore: Sequence[str] = ()) -> list[tuple[str, T.DataType]]:
    """Dotted paths in order of appearance; with ``parents`` a record comes right before its own fields."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if f.name == "attributes" or (not prefix and f.name in ignore):
            continue
        if isinstance(f.dataType, T.StructType):
            out += [(path, f.dataType)] if parents else []
            out += leaf_paths(f.dataType, f"{path}.", parents)
        else:
            out.append((path, f.dataType))
    return out


def flatten_records(df: DataFrame, parents: bool = True) -> DataFrame:
    """Nested records as dotted columns; a record's own column shows its type in brackets."""
    cols = []
    for path, kind in leaf_paths(df.schema, parents=parents):
        c = F.col(path)
        cols.append((cell_text(c, "record", path.split(".")[-1]) if isinstance(kind, T.StructType) else c).alias(path))
    return df.select(*cols)


def hide_relations(df: DataFrame) -> DataFrame:
    """Without record columns, by schema."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.StructType | T.ArrayType)])


def texts(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    kinds = dict(df.dtypes)
    return [cell_text(F.col(f"`{c}`"), kinds[c]) for c in (columns or df.columns) if c in kinds]


def filter_any(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a cell, of the named columns or of any, that holds the term in any case; unknown columns match nothing."""
    hit = F.lit(False)
    for c in texts(df, columns):
        hit = hit | F.contains(F.lower(c), F.lit(term.lower()))
    return df.filter(hit)


def filter_terms(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Per column all blank-separated terms must be in that column; all columns must agree."""
    for name, terms in wanted.items():
        (cell,) = texts(df, [name])
        for term in terms.split():
            df = df.filter(F.contains(F.lower(cell), F.lit(term.lower())))
    return df


def filter_all_terms(df: DataFrame, terms: str, columns: Sequence[str]) -> DataFrame:
    """Every term must be in some of the columns."""
    for term in terms.split():
        df = filter_any(df, term, columns)
    return df


def available_columns(maps: DataFrame, column: str) -> DataFrame:
    return maps.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def field_usage(df: DataFrame, required: Sequence[str] = (), skipped: Sequence[str] = ()) -> DataFrame:
    """(field, filled, total, usage) in one pass: the share of rows with a value, in percent, for every column.

    Rounded half up; a share that rounds to zero keeps three decimals; no rows give 0; a required field counts as
    100 and a skipped one has none.
    """
    names = [c for c in df.columns if c not in skipped]
    one = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    long = one.unpivot(["_total"], [F.col(f"`{c}`") for c in names], "field", "filled")
    share = F.col("filled") * 100.0 / F.col("_total")
    whole = F.floor(share + 0.5)
    usage = F.when(F.col("field").isin(*required) if required else F.lit(False), 100.0).when(F.col("_total") <= 0, 0.0)
    usage = usage.when((whole == 0) & (F.col("filled") > 0), F.round(share, 3)).otherwise(whole.cast("double"))
    return long.select("field", "filled", F.col("_total").alias("total"), usage.alias("usage"))


def csv_line(columns: Sequence[Column], separator: str = ",") -> Column:
    """Every cell in quotes, quotes doubled."""
    return F.concat_ws(separator, *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def csv_text(df: DataFrame, separator: str = ",", quoted: bool = True) -> DataFrame:
    """One text line per row."""
    cells = texts(df)
    return df.select((csv_line(cells, separator) if quoted else F.concat_ws(separator, *cells)).alias("line"))


def manifest(members: DataFrame, kind: str, name: str, version: str = "62.0") -> DataFrame:
    """The package manifest text of (kind, name) rows: types and members sorted."""
    types = members.groupBy(kind).agg(F.array_sort(F.collect_set(name)).alias("_m"))
    block = F.concat(
        F.lit("    <types>\n"), F.array_join(F.transform("_m", lambda m: F.concat(F.lit("        <members>"), m, F.lit("</members>\n"))), ""),
        F.lit("        <name>"), F.col(kind), F.lit("</name>\n    </types>\n"),
    )
    blocks = types.agg(F.array_sort(F.collect_list(F.struct(F.col(kind), block.alias("text")))).alias("_b"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<Package xmlns="http://soap.sforce.com/2006/04/metadata">\n'
    return blocks.select(F.concat(F.lit(head), F.array_join(F.transform("_b", lambda b: b["text"]), ""), F.lit(f"    <version>{version}</version>\n</Package>")).alias("xml"))


def json_tables(df: DataFrame, column: str = "doc", name: str = "@") -> dict[str, DataFrame]:
    """A family of tables from a typed nested column: one per array path, children with their parents' columns."""
    out: dict[str, DataFrame] = {}

    def visit(frame: DataFrame, kind: T.DataType, at: str, path: str, inherited: list[str]) -> None:
        arrays = []
        leaves = leaf_paths(kind) if isinstance(kind, T.StructType) else [("value", kind)]
        own, picked = [], list(inherited)
        for leaf, k in leaves:
            c = F.col(f"{at}.{leaf}") if isinstance(kind, T.StructType) else F.col(at)
            label = f"{path}.{leaf}"
            if isinstance(k, T.ArrayType):
                own.append(F.when(c.isNotNull(), F.concat(F.lit("[Array "), F.size(c).cast("string"), F.lit("]"))).alias(label))
                arrays.append((leaf, k, c))
            else:
                own.append(c.alias(label))
            picked.append(label)
        table = frame.select(*[F.col(f"`{c}`") for c in inherited], *own, *[c.alias(f"_array_{leaf}") for leaf, _, c in arrays])
        out[path] = table.select(*[F.col(f"`{c}`") for c in picked])
        for leaf, k, _ in arrays:
            child = f"{path}.{leaf}.*"
            deeper = table.select(*[F.col(f"`{c}`") for c in picked], F.posexplode(F.col(f"`_array_{leaf}`")).alias(f"{child}#", "_item"))
            visit(deeper, k.elementType, "_item", child, [*picked, f"{child}#"])

    visit(df, df.schema[column].dataType, column, name, [])
    return out


def manifest_lines(members: DataFrame, kind: str, name: str, version: str = "62.0") -> DataFrame:
    """The package manifest of (kind, name) rows as ordered lines, a row each, for a text sink to write.

    (part, kind, place, name, line), sorted by the first four: types and their members sorted, each member once. No type is
    gathered in a cell, and the sort is the only thing that puts lines side by side; rows without kind or name are left out.
    """
    spark = members.sparkSession
    each = members.select(F.col(kind).alias("kind"), F.col(name).alias("name")).filter("kind IS NOT NULL AND name IS NOT NULL").distinct()
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda part, place, line: F.struct(F.lit(part).alias("part"), F.lit(place).alias("place"), line.alias("line"))
    inner = each.select(F.lit(1).alias("part"), "kind", F.lit(1).alias("place"), "name", F.concat(F.lit("        <members>"), safe(F.col("name")), F.lit("</members>")).alias("line"))
    ends = F.array(row(1, 0, F.lit("    <types>")), row(1, 2, F.concat(F.lit("        <name>"), safe(F.col("kind")), F.lit("</name>"))), row(1, 3, F.lit("    </types>")))
    types = each.select("kind").distinct().select("kind", F.inline(ends)).select("part", "kind", "place", F.lit("").alias("name"), "line")
    head = F.array(row(0, 0, F.lit('<?xml version="1.0" encoding="UTF-8"?>')), row(0, 1, F.lit('<Package xmlns="http://soap.sforce.com/2006/04/metadata">')), row(2, 0, F.lit(f"    <version>{version}</version>")), row(2, 1, F.lit("</Package>")))
    frame = spark.range(1).select(F.inline(head)).select("part", F.lit("").alias("kind"), "place", F.lit("").alias("name"), "line")
    return inner.unionByName(types).unionByName(frame).orderBy("part", "kind", "place", "name")


def layout_fields(df: DataFrame, key: str, sections: str, wanted: str = "Field") -> DataFrame:
    """(key, section, row, item, component, value) of the components of a type, with their places at all four levels.

    ``sections``: array of (rows: array of (items: array of (components: array of (type, value)))); null or empty levels
    have no rows.
    """
    out = df.select(F.col(key), F.posexplode(sections).alias("section", "_s"))
    out = out.select(key, "section", F.posexplode("_s.rows").alias("row", "_r"))
    out = out.select(key, "section", "row", F.posexplode("_r.items").alias("item", "_i"))
    out = out.select(key, "section", "row", "item", F.posexplode("_i.components").alias("component", "_c"))
    return out.filter(F.col("_c.type") == wanted).select(key, "section", "row", "item", "component", F.col("_c.value").alias("value"))
