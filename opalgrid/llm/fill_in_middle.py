"""Fill-in-the-middle: documents cut into prefix, middle and suffix at line ends, and joined again in another order.

Arrow hands a task batches of texts as one UTF-8 buffer with offsets, and one numpy kernel cuts all texts of a batch
together. A table gives each byte its class (line feed, continuation byte, other). A byte that follows a line feed, or
that opens a text, begins a line; the running count of such bytes, less its value where a text begins, numbers the
lines of each text anew. The byte where a wanted line begins is found by one binary search of the running count for
all rows; the line after a text's last one begins where the text ends, so that no case needs its own rule. Code points
are counted by a second running count, of the bytes that continue nothing. Outputs are gathered from the same buffer.
Batches are cut into runs of ``CHUNK_BYTES`` (one text at least), which bounds the memory of a task by that and by the
longest text.

The draws are the first four groups of eight hex digits of sha256(``seed:id``). A text is left plain if it is empty,
holds one of the marks, or is not among the ``rate`` percent to be cut.

Defined results: a null text is empty; a null id draws as ``seed:``; rows with equal ids draw alike and rows that are
repeated give repeated results; n counts lines (``[^\\n]*\\n|[^\\n]+``), 0 for the empty text; prefix_chars and
middle_chars are null where the form is plain; an empty table gives no rows. Texts of any length are read whole; a batch
holds as many as fit in Arrow's limit of bytes. Only the id and the text are read, whatever the other columns' names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.llm.common import text_of

MARKS = ("<P>", "<S>", "<M>")
CHUNK_BYTES = 4 << 20
FORMS = ("plain", "psm", "spm")


def draw(id_col: str, seed: int, place: int) -> Column:
    """The draw at a place (0 to 7): eight hex digits of sha256(``seed:id``) as an unsigned integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * place + 1, 8), 16, 10).cast("long")


def byte_classes() -> Any:
    """By byte: 1 line feed, 2 continuation of a code point, 0 other."""
    import numpy as np

    table = np.zeros(256, dtype=np.uint8)
    table[ord("\n")] = 1
    table[0x80:0xC0] = 2
    return table


def cut_lines(data: Any, offsets: Any, h1: Any, h2: Any) -> tuple[Any, Any, Any, Any, Any]:
    """(n, first cut, second cut, prefix_chars, middle_chars) of every text of a buffer; cuts are bytes of the buffer."""
    import numpy as np

    start, end = offsets[:-1], offsets[1:]
    kinds = byte_classes()[data]
    begins = np.empty(len(data), dtype=bool)
    begins[:1] = True
    begins[1:] = kinds[:-1] == 1
    begins[start[start < end]] = True
    upto = np.cumsum(begins, dtype=np.int64)
    before = np.concatenate(([0], upto))  # lines begun before a byte
    points = np.concatenate(([0], np.cumsum(kinds != 2, dtype=np.int64)))
    n = before[end] - before[start]
    one, two = h1 % (n + 1), h2 % (n + 1)
    first = np.searchsorted(upto, before[start] + np.minimum(one, two) + 1)
    second = np.searchsorted(upto, before[start] + np.maximum(one, two) + 1)
    return n, first, second, points[first] - points[start], points[second] - points[first]


def join_parts(data: Any, offsets: Any, first: Any, second: Any, form: Any, marks: Sequence[bytes]) -> tuple[Any, Any]:
    """(buffer, offsets) of the outputs: every row is up to six stretches of the texts and marks, gathered at once."""
    import numpy as np

    start, end, rows = offsets[:-1], offsets[1:], len(offsets) - 1
    source = np.concatenate([data, *[np.frombuffer(m, dtype=np.uint8) for m in marks]])
    at = len(data) + np.cumsum([0, *map(len, marks[:-1])])
    mark = [(np.full(rows, a), np.full(rows, len(m))) for a, m in zip(at, marks, strict=True)]
    prefix, middle, suffix = (start, first - start), (first, second - first), (second, end - second)
    none, whole = (start, start * 0), (start, end - start)
    orders = {"plain": (whole, none, none, none, none, none), "psm": (mark[0], prefix, mark[1], suffix, mark[2], middle), "spm": (mark[1], suffix, mark[0], prefix, mark[2], middle)}
    begin, length = (np.stack([np.choose(form, [orders[f][k][part] for f in FORMS]) for k in range(6)], axis=1) for part in (0, 1))
    out = np.concatenate(([0], np.cumsum(length.sum(axis=1))))
    if rows == 1:  # a long text: stretches are copied as they are
        return np.concatenate([source[b : b + n] for b, n in zip(begin[0], length[0], strict=True)]), out
    begin, length = begin.ravel(), length.ravel()
    to = np.cumsum(length) - length
    return source[np.arange(out[-1]) + np.repeat(begin - to, length)], out


def _runs(offsets: Any) -> Iterator[tuple[int, int]]:
    """Rows [i, j) of at most CHUNK_BYTES together, one row at least."""
    import numpy as np

    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, min(j, rows)
        i = j


def transform_batch(batch: Any, marks: Sequence[bytes]) -> Iterator[Any]:
    """An Arrow batch (id, text, form, h1, h2) as batches (id, n, form, prefix_chars, middle_chars, output)."""
    import numpy as np
    import pyarrow as pa

    text = batch.column("text")
    wide = pa.types.is_large_string(text.type)
    _, ends, raw = text.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    form, h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("form", "h1", "h2"))
    for i, j in _runs(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n, first, second, prefix, middle = cut_lines(own, at, h1[i:j], h2[i:j])
        out, ends = join_parts(own, at, first, second, form[i:j], marks)
        outputs = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out)))
        plain = form[i:j] == 0
        columns = [
            batch.column("id").slice(i, j - i), pa.array(n), pa.array(np.array(FORMS, dtype=object)[form[i:j]], type=pa.string()),
            pa.array(prefix, mask=plain), pa.array(middle, mask=plain), outputs if wide else outputs.cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """A row per document: id, n, form (plain, psm or spm), prefix_chars, middle_chars and the output text.

    ``rate`` percent of the documents are cut, ``spm`` percent of these in the order suffix, prefix, middle.
    """
    text = text_of(text_col)
    plain = text == ""
    for m in marks:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain | (draw(id_col, seed, 2) % 100 >= rate), 0).when(draw(id_col, seed, 3) % 100 < spm, 2).otherwise(1)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), draw(id_col, seed, 0).alias("h1"), draw(id_col, seed, 1).alias("h2"))
    raw = [m.encode() for m in marks]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            yield from transform_batch(batch, raw)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    schema = schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n, form, prefix_chars, middle_chars, and the digests of output and rebuilt text."""
    out = transform(docs, id_col, text_col)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
