"""WARC archives: written by Spark, normalised to a gzip member per record with an offset index, and read at random.

``write_archives`` makes one string per record and lets Spark's text sink write them with the record separator as line
separator, so that archives land on any store that Spark writes to; compressed, each is one monolithic gzip stream.
Records whose payloads are equal become one response and revisits of it.

``normalise`` reads every archive once, as a stream: it inflates, finds record after record by their Content-Length,
compresses each as a gzip member of its own, and writes the members to a new archive beside a sidecar of JSON lines
(offset, length, type, id, ...). Memory is bounded by a few blocks, however long a record is. A task works on
whole archives; a lost executor costs the archives it held: files get their final names when complete, and members have
no time stamps, so that a second run writes the same bytes. ``read_records`` opens members at their offsets, so that
one archive can be read by many tasks.

Workers open archives by pyarrow's file systems; Spark lists them.

Defined results: a null payload is empty; of equal payloads the record with the largest id is the response, and where
several rows bear that id, each of them is; null ids count as smaller than any other, and a null id is a response only
where all equal payloads have none; a null url writes no target; control characters and blanks in a url are escaped;
payloads of any length are streamed (reading returns them whole, one a row); an empty table gives no rows; columns
other than id, url and payload are not read. An archive that ends within a record keeps the records before it, and its
``truncated`` flag is set.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from typing import Any
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.llm.common import HOT_SHARE, fresh_path, materialize, text_of

END = "\r\n"
#: What the text sink puts after every record.
SEPARATOR = END + END
BLOCK = 1 << 18
#: The longest head of a record.
HEAD_BYTES = 1 << 20
#: Records of a monolithic archive, which one task normalises.
ARCHIVE_RECORDS = 10_000
#: Bytes of members that one task reads back, and of payloads that it returns at a time.
READ_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: The digits of base 32 as numbers are written, and as digests are.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_type string, record_id string, refers_to string, payload_digest string, block_bytes long"
URN = "urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _escaped(url: Column) -> Column:
    out = url
    for code in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def decide_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(_id, _url, _text, _digest, _keep, _shared): ``_keep`` is the id of the response where payloads are shared.

    Only digests that occur twice enter the table of groups. Those that hold over 1/HOT_SHARE of the pages are few
    and broadcast; the others are joined as the planner finds best.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_of(payload_col).alias("_text"))
    rows = rows.withColumn("_digest", base32_sha1(F.col("_text")))
    groups = rows.groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = materialize(groups, "payloads")
    hot = F.col("_n") * HOT_SHARE > F.lit(max(pages.count(), HOT_SHARE))
    few = F.broadcast(groups.filter(hot).drop("_n").withColumn("_shared", F.lit(True)))
    many = groups.filter(~hot).drop("_n").withColumn("_shared", F.lit(True))
    cold = rows.join(F.broadcast(groups.filter(hot).select("_digest")), "_digest", "left_anti").join(many, "_digest", "left")
    return rows.join(few, "_digest").select(cold.columns).unionByName(cold)


def record_text(date: str) -> Column:
    """A whole record, without what ends it, from the columns of ``decide_types``."""
    size = F.octet_length("_text").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    name = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(":"), F.col("_digest"), F.lit(">"))
    revisit = F.coalesce(F.col("_shared"), F.lit(False)) & ~F.col("_id").eqNullSafe(F.col("_keep"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_text")))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(END))
    return F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("_id"))), line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", _escaped(F.col("_url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("_keep"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
    )


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", compressed: bool = True, records: int = ARCHIVE_RECORDS, **columns: str) -> None:
    """Archives of up to ``records`` records each, every one a single gzip stream."""
    lines = decide_types(pages, **columns).select(record_text(date).alias("value"))
    lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", records).text(folder, compression="gzip" if compressed else "none")


def _open(uri: str) -> tuple[Any, str]:
    """(file system, path) of a path as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class _Stream:
    """Bytes of an archive, inflated block by block; gzip members follow each other, or the file is not compressed."""

    def __init__(self, source: Any) -> None:
        self.source, self.held, self.inflate, self.broken = source, bytearray(), None, False
        self.left = source.read(BLOCK)
        self.packed = self.left[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Reads on; false where nothing is left."""
        if not self.packed:
            got, self.left = self.left or self.source.read(BLOCK), b""
            self.held += got
            return bool(got)
        size = len(self.held)
        while len(self.held) == size:
            self.left = self.left or self.source.read(BLOCK)
            if not self.left:
                self.broken |= self.inflate is not None
                return False
            if self.inflate is None:
                self.left = self.left.lstrip(b"\0")  # padding between members
                if not self.left:
                    continue
                self.inflate = zlib.decompressobj(31)
            try:
                self.held += self.inflate.decompress(self.left, BLOCK)
            except zlib.error:  # what comes after is lost
                self.left, self.inflate, self.broken, self.packed, self.source = b"", None, True, False, io.BytesIO()
                return False
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, None
            else:
                self.left = self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to a mark, which is passed over; none if the stream ends before it."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if seen > HEAD_BYTES or not self.more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def blank(self) -> None:
        """Passes over what separates records."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:n]
            if self.held or not self.more():
                return

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in blocks; fewer where the stream ends."""
        while n:
            if not self.held and not self.more():
                return
            part = bytes(self.held[: min(n, BLOCK)])
            del self.held[: len(part)]
            n -= len(part)
            yield part


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the last of repeated ones; lines that go on the one before are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split(END)[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def normalise_stream(source: Any, sink: Any, level: int = 6) -> Iterator[dict[str, Any]]:
    """Writes every record of a stream as a gzip member; an entry per record, or ``{"truncated": True}`` at a broken end."""
    stream, at = _Stream(source), 0
    while True:
        stream.blank()
        if not stream.held:
            if stream.broken:
                yield {"truncated": True}
            return
        head = stream.until((END + END).encode())
        fields = fields_of(head) if head is not None else {}
        if head is None or not fields.get("content-length", "").isdigit():
            yield {"truncated": True}
            return
        size, member, begun = int(fields["content-length"]), zlib.compressobj(level, zlib.DEFLATED, 31), at
        got = 0
        pieces = [member.compress(head + (END + END).encode())]
        for part in stream.take(size):
            got += len(part)
            pieces.append(member.compress(part))
            if sum(map(len, pieces)) > BLOCK and got < size:
                at += _put(sink, pieces)
        if got < size:
            if at > begun:  # the member is closed, and has no entry
                at += _put(sink, [*pieces, member.flush()])
            yield {"truncated": True}
            return
        pieces += [member.compress(SEPARATOR.encode()), member.flush()]
        at += _put(sink, pieces)
        yield {
            "offset": begun, "length": at - begun, "record_type": fields.get("warc-type", ""), "record_id": fields.get("warc-record-id", "").strip("<>"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block_bytes": size,
        }


def _put(sink: Any, pieces: list[bytes]) -> int:
    raw = b"".join(pieces)
    pieces.clear()
    sink.write(raw)
    return len(raw)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites all archives of a folder into ``target``/archives, with sidecars in ``target``/index; (archive, records, truncated)."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).filter("length > 0").select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame([_normalise_one(path, target)], columns=["archive", "records", "truncated"])

    for part in ("archives", "index"):
        system, path = _open(f"{target}/{part}")
        system.create_dir(path)
    return materialize(paths.mapInPandas(run, "archive string, records long, truncated boolean"), "normalised")


def _normalise_one(path: str, target: str) -> tuple[str, int, bool]:
    name = f"{path.rsplit('/', 1)[-1].split('.')[0]}-{zlib.crc32(path.encode()):08x}"  # folders may hold files of one name
    archive, sidecar = f"{target}/archives/{name}.warc.gz", f"{target}/index/{name}.json"
    system, source = _open(path)
    out, final = _open(archive)
    _, beside = _open(sidecar)
    draft, records, truncated = f".{uuid4().hex}", 0, False
    folder, side = final.rsplit("/", 1)[0], beside.rsplit("/", 1)[0]
    with system.open_input_stream(source, compression=None) as raw, out.open_output_stream(f"{folder}/{draft}", compression=None) as sink, out.open_output_stream(f"{side}/{draft}", compression=None) as index:
        for entry in normalise_stream(raw, sink):
            if "truncated" in entry:
                truncated = True
            else:
                records += 1
                index.write((json.dumps({"archive": archive, **entry}) + "\n").encode())
    out.move(f"{folder}/{draft}", final)
    out.move(f"{side}/{draft}", beside)
    return archive, records, truncated


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """An entry per record: archive, offset, length, record_type, record_id, refers_to, payload_digest, block_bytes."""
    return spark.read.schema(INDEX).json(f"{target}/index")


def read_records(index: DataFrame) -> DataFrame:
    """The entries' records with ``uri``, ``http`` (head) and ``payload`` (binary), each read at its offset alone."""
    columns = [f.split()[0] for f in INDEX.split(", ")]
    chunks = index.select(*columns).withColumn("_chunk", F.floor(F.col("offset") / READ_BYTES)).repartition("archive", "_chunk").sortWithinPartitions("archive", "offset").drop("_chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, handle = None, None
        for batch in batches:
            rows, size = [], 0
            for row in batch.itertuples(index=False):
                if row.archive != opened:
                    if handle:
                        handle.close()
                    system, path = _open(row.archive)
                    opened, handle = row.archive, system.open_input_file(path)
                handle.seek(row.offset)
                raw = zlib.decompress(handle.read(row.length), 31)
                head, _, rest = raw.partition((END + END).encode())
                http, _, payload = rest[: row.block_bytes].partition((END + END).encode())
                rows.append((*row, fields_of(head).get("warc-target-uri"), http.decode("utf-8", "replace"), payload))
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*columns, "uri", "http", "payload"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=[*columns, "uri", "http", "payload"])
        if handle:
            handle.close()

    return chunks.mapInPandas(run, f"{INDEX}, uri string, http string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages, normalises the archives and reads all records back; a row per page.

    id, payload_bytes, payload_digest, record_type, refers_to. A response's size and digest are those of the bytes read
    back; a revisit has no payload, and its heads tell them.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    written, target = fresh_path(spark, "warc"), fresh_path(spark, "warc-members")
    write_archives(pages, written, id_col=id_col, url_col=url_col, payload_col=payload_col)
    normalise(spark, written, target)
    records = read_records(read_index(spark, target))
    page = lambda c: F.url_decode(F.nullif(F.regexp_extract(c, f"^{URN}(.*):[A-Z2-7]+$", 1), F.lit(""))).cast(kind)
    revisit = F.col("record_type") == "revisit"
    told = F.regexp_extract("http", r"(?i)\nContent-Length: *([0-9]+)", 1).cast("long")
    return records.select(
        page(F.col("record_id")).alias(id_col), F.when(revisit, told).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"), "record_type", F.when(revisit, page(F.col("refers_to"))).alias("refers_to"),
    )
