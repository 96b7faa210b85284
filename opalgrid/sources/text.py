"""Reading pasted and replied text: format and separator detection, strict CSV, manifests, replies by content type."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")


def sniff_format(c: Column) -> Column:
    """json, excel, csv or empty."""
    is_json = F.trim(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()
    return F.when(is_json, "json").when(F.instr(c, "\t") > 0, "excel").when(F.instr(c, ",") > 0, "csv").otherwise("")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def detect_separator(c: Column) -> Column:
    """The separator that splits the first line with text most often; a tie goes to the earlier one, none to a comma."""
    line = F.coalesce(F.get(F.filter(F.split(c, "\r?\n"), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))
    counts = lambda x: F.array(*[F.size(F.split(x, "\\" + s)) for s in SEPARATORS])
    first = lambda n: F.get(F.array(*map(F.lit, SEPARATORS)), (F.array_position(n, F.array_max(n)) - 1).cast("int"))
    return _once(_once(line, counts), first)


#: The types that an imported field may have.
FIELD_TYPES = (
    "Checkbox", "Currency", "Date", "DateTime", "Email", "Location", "Number", "Percent", "Phone", "Picklist", "MultiselectPicklist", "Text", "TextArea", "LongTextArea", "Html", "Url",
)


def import_fields(c: Column) -> Column:
    """(fields, error) of a text of ``label, name, type`` lines.

    The separator is that of the first line with text. Lines that lack one of the three are passed over. A type that is
    not known is an error that names its line (the last such line), and then no field is imported. Null has no fields.
    """
    cell = lambda x, i: F.coalesce(F.trim(F.translate(F.get(x, F.lit(i)), "\r\t", "  ")), F.lit(""))

    def read(text: Column, by: Column) -> Column:
        # a line holds no line break, so that its separators can become some
        cells = F.transform(F.split(text, "\n"), lambda line: F.split(F.replace(line, by, F.lit("\n")), "\n"))
        lines = F.transform(cells, lambda x, i: F.struct((i + 1).alias("line"), *[cell(x, j).alias(n) for j, n in enumerate(("label", "name", "type"))]))
        return F.filter(lines, lambda r: (r["label"] != "") & (r["name"] != "") & (r["type"] != ""))

    def judged(whole: Column) -> Column:
        last = F.try_element_at(F.filter(whole, lambda r: ~r["type"].isin(*FIELD_TYPES)), F.lit(-1))
        said = lambda bad: F.concat(F.lit('Invalid type "'), bad["type"], F.lit('" on line '), bad["line"].cast("string"))
        return _once(_once(last, said), lambda error: F.struct(F.when(error.isNull(), whole).alias("fields"), error.alias("error")))

    return _once(c, lambda text: _once(_once(detect_separator(text), lambda by: read(text, by)), judged))


def content_kind(content_type: Column, url: Column, body: Column) -> Column:
    """How a reply is read: by its content type and address; a body that is no JSON falls back to text or log."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    log = url.rlike("/ApexLog/[^/]+/Body$")
    return (
        F.when(log, "log").when(F.contains(low, F.lit("xml")), "xml").when(F.contains(low, F.lit("csv")), "csv").when(low.startswith("text/plain"), "text")
        .when(F.try_parse_json(body).isNotNull(), "json").otherwise("text")
    )


def parse_csv_text(df: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """Strict parsing of CSV texts: (key, row, cells, error) per row of each text.

    Quotes double inside quoted cells and line breaks may stand in them; a last line break ends no row. A text that
    is empty, leaves a quote open, or has a row of another width than its first gives a single row with the error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 31)  # cells of any length
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                rows += [(k, *r) for r in _rows(t or "", separator)]
            yield pd.DataFrame(rows, columns=["key", "row", "cells", "error"])

    return df.select(F.col(key).cast("string").alias(key), text).mapInPandas(parse, "key string, row int, cells array<string>, error string")


def _rows(text: str, separator: str) -> list[tuple[int, list[str] | None, str | None]]:
    if not text.strip("\r\n"):
        return [(0, None, "no data")]
    if text.count('"') % 2:
        return [(0, None, "Quote not closed")]
    rows = [r or [""] for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator)]
    for i, r in enumerate(rows):
        if len(r) != len(rows[0]):
            return [(0, None, f"row {i + 1} has {len(r)} cells, expected {len(rows[0])}")]
    return [(i, r, None) for i, r in enumerate(rows)]


def manifest_members(df: DataFrame, xml: str) -> DataFrame:
    """(kind, members) of package manifests: members sorted."""
    bare = F.regexp_replace(F.col(xml), ' xmlns="[^"]*"', "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<types>.*?</types>"), F.lit(0))
    each = df.select(F.explode(blocks).alias("b"))
    return each.select(F.xpath_string("b", F.lit("types/name")).alias("kind"), F.array_sort(F.xpath("b", F.lit("types/members/text()"))).alias("members"))


def parse_xml(df: DataFrame, xml: str, schema: str) -> DataFrame:
    return df.select(F.from_xml(F.col(xml), schema, {"nullValue": ""}).alias("record"))
