"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the scoring workers.

Counting. A task hashes the words of its texts (48 bits for raw counts, the upper 40 in n-grams) by one numpy kernel over the Arrow buffer and counts n-grams in flushes of FLUSH tokens. Each flush goes
out as one binary row per hash range (part), n-grams with their counts. A group task merges a part, writes it as a
sorted array, and passes on what the lower order needs: for each suffix the number of its different left neighbours
(the adjusted counts), for each context its total and its numbers of followers seen once, twice and more often. These
travel in the same packed form to the next round, in which an n-gram meets what is known of it as a context: both lie in
one array. A round takes PASSES passes, each for its share of the parts: the first round reads the texts anew in each, later
ones read what the round before wrote to the shared folder, and shuffle files and read rows go when their pass ends. The number of parts follows the size of the texts, and hashes
spread evenly, so a group task's memory is bounded whatever word is frequent.

Arrays. A part holds its n-grams' hashes, 48 bits beyond those that all hashes of the part share, as places of 65,536
buckets and 32 bits each, and a byte for the record of each: the number of a common record, or a mark for one that
stands in a list of the others. Two n-grams of a part of five million share 48 bits with a probability below 1e-7 each.

Scoring. p_k(w | context) = max(a - D(a), 0) / S + gamma * p_(k-1), from order 1, whose lower order is uniform over the
V known tokens and an unknown one. a, S and the counts behind gamma are looked up by binary search in the memory-mapped arrays; the context of an n-gram is the
n-gram that ends one token before, so that each is looked up once. Texts are gathered until there are ROOM_A_PART tokens for
each part, and looked up together in ascending order: opening a part then costs little beside what is looked up in it.

The arrays lie in the shared folder, which must be mounted on the workers. A retried task writes the same bytes and
renames them into place, so that lost executors do no harm.

Defined results: a null or empty text is the end token alone; rows with a null id are learned from; repeated rows are
learned as often as they occur; texts of any length are read whole; columns other than the id and the text are not read; without training texts every probability is that of the uniform distribution; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log2
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import doc_crc, local_folder, text_of

ORDER = 3
FLUSH = 1_500_000
PART_BYTES = 16 << 20
PASSES = 2  # a power of two
STATISTICS = -1  # stands for a turn
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FOLDS, HELD_OUT = 10, 0
LONG_WORD = 256  # bytes
OPEN_PARTS = 64
ROOM, ROOM_A_PART, MOST_ROOM = 1 << 17, 1 << 12, 1 << 20  # tokens that are scored at a time: at least, for each part, and at most
BUCKET_BITS = 16
RARE = 255  # the mark of a record that is not a common one
MASK = (1 << 48) - 1
NARROW = 8  # n-grams hold the upper 40 bits of a word's hash, raw counts all 48
ROWS = "kind string, part int, blob binary"
FIELDS = 5  # of a record: count, and as a context total, followers seen once, twice, more often


END = b"\n"  # no word holds a line break


def _stir(out: Any, column: Any) -> Any:
    import numpy as np

    with np.errstate(over="ignore"):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def word_hashes(data: Any, starts: Any, ends: Any) -> Any:
    """48-bit hashes of the words at these places of the bytes; small ones are kept for the start mark."""
    import numpy as np
    from xxhash import xxh64_intdigest

    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # from each byte on
    low = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
    sizes = ends - starts
    out = sizes.astype(np.uint64)
    for at in range(0, min(LONG_WORD, int(sizes.max(initial=0))), 8):
        own = np.flatnonzero(sizes > at)
        out[own] = _stir(out[own], eight[starts[own] + at] & low[np.minimum(sizes[own] - at, 8)])
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return np.maximum(out & np.uint64(MASK), np.uint64(1 << NARROW))


def token_stream(texts: Any) -> tuple[Any, Any]:
    """(tokens, lengths): the hashed words of an Arrow array of texts, each text followed by the end token."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, dtype="<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)[data]
    within = np.array([not bytes([i]).isspace() for i in range(256)])[data]
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    full = np.diff(offsets) > 0  # words end with their text
    for edge, at in ((first, offsets[:-1][full]), (last, offsets[1:][full] - 1)):
        edge[at] = within[at]
    starts = np.flatnonzero(first)
    words = word_hashes(data, starts, np.flatnonzero(last) + 1)
    before = np.searchsorted(starts, offsets)
    end = word_hashes(np.frombuffer(END, dtype=np.uint8), np.array([0]), np.array([len(END)]))
    return np.insert(words, before[1:], end[0]), np.diff(before) + 1


def grams(tokens: Any, lengths: Any, order: int) -> list[Any]:
    """The columns w1..wn of the n-gram that ends at each token; start marks stand before a text."""
    import numpy as np

    at = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for back in range(order - 1, -1, -1):
        col = np.zeros_like(tokens)
        col[back:] = tokens[: len(tokens) - back]
        col[at < back] = 0
        out.append(col)
    return out


def mix(columns: list[Any]) -> Any:
    """64-bit hash of an n-gram from its columns; an empty list is not hashed."""
    import numpy as np

    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        out = _stir(out, c)
    return out


def _add_up(keys: Any, values: list[Any]) -> tuple[Any, Any, list[Any]]:
    """Distinct keys ascending, the index of each one's first row, and the sums of the values."""
    import numpy as np

    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _planes(values: Any) -> bytes:
    """64-bit numbers as differences (modulo 2**64), first all lowest bytes, then all next ones."""
    import numpy as np

    with np.errstate(over="ignore"):
        steps = np.diff(values.astype("<u8"), prepend=np.zeros(1, dtype="<u8"))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(blob: bytes, rows: int, at: int) -> Any:
    import numpy as np

    steps = np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8, count=8 * rows, offset=at).reshape(8, rows).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _pack(columns: list[Any], counts: Any, width: int) -> bytes:
    """Rows of columns, those with count 1 first and without their counts, compressed.

    Words (``width`` below 8) become places in the ascending list of all words of the blob, the places of a row one
    number where 64 bits hold them. No row is left out; rows in the order of their numbers take the least room.
    """
    import numpy as np
    import pyarrow as pa

    one = np.flatnonzero(counts == 1)
    rest = np.flatnonzero(counts != 1)
    order = np.concatenate([one, rest])
    columns, listed, bits = [c[order].astype(np.uint64) for c in columns], np.zeros(0, np.uint64), 0
    if len(columns) > 1 and width < 8:
        words, places = np.unique(np.concatenate(columns), return_inverse=True)
        need = max(1, len(words).bit_length())
        if need * len(columns) <= 64:
            listed, bits, joined = words, need, np.zeros(len(order), np.uint64)
            for place in np.split(places.ravel().astype(np.uint64), len(columns)):
                joined = (joined << np.uint64(need)) | place
            columns = [joined]
    n_columns = len(columns) if not bits else len(places.ravel()) // max(1, len(order))
    head = np.array([len(order), len(one), n_columns, bits, len(listed)], dtype="<u8").tobytes()
    raw = head + _planes(listed) + b"".join(map(_planes, columns)) + _planes(counts[rest].astype(np.uint64))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, width: int) -> tuple[list[Any], Any]:
    import numpy as np
    import pyarrow as pa

    blob = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, one, n_columns, bits, listed = (int(x) for x in np.frombuffer(blob[:40], dtype="<u8"))
    words, at = _values(blob, listed, 40), 40 + 8 * listed
    stored = [_values(blob, n, at + 8 * n * i) for i in range(1 if bits else n_columns)]
    at += 8 * n * len(stored)
    if bits:
        shifts = [np.uint64(bits * i) for i in reversed(range(n_columns))]
        stored = [words[((stored[0] >> k) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in shifts]
    counts = np.ones(n, dtype=np.int64)
    counts[one:] = _values(blob, n - one, at).astype(np.int64)
    return stored, counts


def _parted(kind: str, keys: Any, columns: list[Any], counts: Any, shift: int, width: int) -> Iterator[tuple[str, int, bytes]]:
    """Packed rows per part; ``keys``, ascending, decide the part by their top bits."""
    import numpy as np

    part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), dtype=np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            own, n = [c[a:b] for c in columns], counts[a:b]
            if len(own) > 1 and width < 8:  # n-grams in the order of their words, about: the leading bits decide
                room, lead = 64 // len(own), np.zeros(b - a, dtype=np.uint64)
                for c in own:
                    lead = (lead << np.uint64(room)) | (c >> np.uint64(max(0, 40 - room)))
                order = np.argsort(lead)
                own, n = [c[order] for c in own], n[order]
            yield kind, int(part[a]), _pack(own, n, width)


def _save(folder: str, name: str, own: Any, records: Any) -> None:
    """One file: bucket ends, common records, the others, the lower halves of the keys, a byte for each record.

    ``own`` are ascending keys within the part.
    """
    import numpy as np

    ends = np.searchsorted(own, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(32)).astype("<u4")
    small = np.ones(len(own), dtype=bool)
    for i in range(records.shape[1]):
        small &= records[:, i] < 1 << 12
    packed = np.zeros(len(own), dtype=np.int64)
    for i in range(records.shape[1]):
        packed = (packed << 12) | np.minimum(records[:, i], (1 << 12) - 1)
    kinds, back, n = np.unique(packed[small], return_inverse=True, return_counts=True)
    best = np.sort(np.lexsort((kinds, -n))[:RARE])  # ties: the smaller record
    code = np.full(len(kinds), RARE, dtype=np.uint8)
    code[best] = np.arange(len(best))
    codes = np.full(len(own), RARE, dtype=np.uint8)
    codes[small] = code[back.ravel()]
    common = np.stack([(kinds[best] >> (12 * i)) & 4095 for i in reversed(range(records.shape[1]))], axis=1)
    rare = np.flatnonzero(codes == RARE)
    wide = "<u8" if len(rare) and int(records[rare].max()) >> 32 else "<u4"
    head = np.array([len(own), records.shape[1], len(common), len(rare), wide == "<u8"], dtype="<u8")
    path = f"{folder}/{name}"
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        for array in (head, ends, common.astype("<u8"), rare.astype("<u8"), records[rare].astype(wide), (own & np.uint64(0xFFFFFFFF)).astype("<u4"), codes):
            f.write(np.ascontiguousarray(array).tobytes())
    os.replace(temporary, path)


@dataclass
class NgramModel:
    """What the driver keeps: the folder of arrays and a few numbers."""

    folder: str
    order: int
    bits: int
    tokens: int = 0
    vocabulary: int = 0
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    base: tuple[float, float] = (0.0, 1.0)  # total and gamma of the empty context


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with adjusted counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def key_bits(kind: str) -> int:
    """Of the keys of raw counts, of words in n-grams, and of longer n-grams."""
    return {"u": 48, "g1": 40}.get(kind, 64)


def within_part(keys: Any, kind: str, bits: int) -> Any:
    """The 48 bits of a key that follow those that its part decides."""
    import numpy as np

    return (keys << np.uint64(64 - key_bits(kind) + bits)) >> np.uint64(16)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> NgramModel:
    """Counts the texts of ``docs`` and writes the arrays."""
    spark = docs.sparkSession
    texts = docs.select(text_of(text_col).alias("_text"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = max(0, ceil(log2(max(1, size / PART_BYTES))))
    model = NgramModel(local_folder(spark, "ngrams"), order, bits)
    folder, word_shift, narrow_shift, key_shift = model.folder, 48 - bits, 40 - bits, 64 - bits

    passes = min(PASSES, 1 << bits)

    def count(turn: int) -> Any:
        """The map task of a pass: n-grams and words of the parts whose turn it is, of all texts."""

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            held, n = [[] for _ in range(order + 2)], 0

            def mine(keys: Any, shift: int) -> Any:
                return (keys >> np.uint64(shift)) & np.uint64(passes - 1) == turn if passes > 1 else np.ones(len(keys), dtype=bool)

            def flush() -> Iterator:
                nonlocal held, n
                whole = []
                while held:  # a column at a time, so that two copies of one alone are in memory
                    whole.append(np.concatenate(held.pop(0)))
                tokens, keys, *columns = whole
                held, n = [[] for _ in range(order + 2)], 0
                keys, at, (counts,) = _add_up(keys, [np.ones(len(keys), dtype=np.int64)])
                rows = list(_parted(f"g{order}", keys, [c[at] for c in columns], counts, key_shift, 5))
                words, counts = np.unique(tokens, return_counts=True)
                rows += _parted("u", words, [words], counts, word_shift, 6)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["kind", "part", "blob"])

            for batch in batches:
                texts = batch.column(0)
                for at in range(0, len(texts), 256):
                    tokens, sizes = token_stream(texts.slice(at, 256))
                    columns = grams(tokens >> np.uint64(NARROW), sizes, order)
                    keys = mix(columns)
                    own = mine(keys, key_shift)
                    kept = [tokens[mine(tokens, word_shift)], keys[own], *[c[own] for c in columns]]
                    for column, values in zip(held, kept, strict=True):
                        column.append(values)
                    n += max(len(kept[0]), len(kept[1]))
                    if n >= FLUSH:
                        yield from flush()
            if held[0]:
                yield from flush()

        return run

    def merge(k: int) -> Any:
        """The group task of round k: n-grams of order k, with what is known of them as contexts, and raw word counts."""

        def run(group: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            slot, part = group["slot"].iloc[0], int(group["part"].iloc[0])
            rows: list[tuple[str, int, bytes]] = []
            width, own = (1 if slot == "u" else k), group["kind"] == slot
            unpacked = [_unpack(b, 6 if slot == "u" else 5) for b in group["blob"][own]]
            columns = [np.concatenate([np.zeros(0, np.uint64), *[u[0][i] for u in unpacked]]) for i in range(width)]
            counts = np.concatenate([np.zeros(0, np.int64), *[u[1] for u in unpacked]])
            del unpacked
            keys, at, (counts,) = _add_up(columns[0] if width == 1 else mix(columns), [counts])
            columns = [c[at] for c in columns]
            own_keys = within_part(keys, slot, bits)
            every, records = own_keys, counts[:, None]
            if slot != "u" and k < order:
                unpacked = [_unpack(b, 8)[0] for b in group["blob"][~own]]
                # a key alone is a context seen once
                unpacked = [u if len(u) > 1 else [u[0], np.ones_like(u[0]), np.ones_like(u[0]), np.zeros_like(u[0]), np.zeros_like(u[0])] for u in unpacked]
                contexts = [np.concatenate([np.zeros(0, np.uint64), *[u[i] for u in unpacked]]) for i in range(FIELDS)]
                del unpacked
                met, _, sums = _add_up(contexts[0], contexts[1:])
                del contexts
                every = np.union1d(own_keys, met)
                most = max(int(c.max(initial=0)) for c in (counts, *sums))
                records = np.zeros((len(every), FIELDS), dtype=np.uint32 if most < 1 << 32 else np.int64)
                records[np.searchsorted(every, own_keys), 0] = counts
                at = np.searchsorted(every, met)
                for i in range(1, FIELDS):
                    records[at, i] = sums[i - 1]
                del met, sums, at
            _save(folder, f"{slot}-{part}", every, records)
            del every, records, own_keys
            seen = [int((counts == c).sum()) for c in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum()), len(counts)]
            rows.append((f"s{slot}", 0, np.array(seen, dtype="<u8").tobytes()))
            if slot != "u" and width > 1 and len(keys):
                flags = [counts, *((counts == c).astype(np.int64) for c in (1, 2)), (counts >= 3).astype(np.int64)]
                context = columns[0] if width == 2 else mix(columns[:-1])
                ckeys, _, sums = _add_up(context, flags)
                shift = narrow_shift if width == 2 else key_shift
                once, sent = sums[0] == 1, within_part(ckeys, f"g{width - 1}", bits)
                rows += _parted(f"c{width}", ckeys[once], [sent[once]], sums[0][once], shift, 8)
                full = [sent[~once], *[s[~once].astype(np.uint64) for s in sums]]
                rows += _parted(f"c{width}", ckeys[~once], full, np.ones(len(full[0]), dtype=np.int64), shift, 8)
                del once, sent, full, sums, ckeys, context, flags
                suffix = columns[1] if width == 2 else mix(columns[1:])
                skeys, first, (n,) = _add_up(suffix, [np.ones(len(suffix), dtype=np.int64)])
                rows += _parted(f"g{width - 1}", skeys, [c[first] for c in columns[1:]], n, shift, 5)
            return pd.DataFrame(rows, columns=["kind", "part", "blob"])

        return run

    def between(k: int) -> str:
        return f"file://{folder}/rows-{k}"

    def done(k: int, turn: int) -> DataFrame:
        return spark.read.schema(f"{ROWS}, turn int").parquet(between(k)).filter(F.col("turn") == turn).drop("turn")

    total: dict[str, list[int]] = {}
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")  # a pass leaves no shuffle files behind
    try:
        for k in range(order, 0, -1):
            for turn in range(passes):
                rows = texts.mapInArrow(count(turn), ROWS) if k == order else done(k + 1, turn)
                # contexts of order k + 1 are n-grams of order k
                slot = F.when(F.col("kind") == f"c{k + 1}", f"g{k}").otherwise(F.col("kind"))
                rows = rows.withColumn("slot", slot).groupBy("slot", "part").applyInPandas(merge(k), ROWS)
                next_turn = F.when(F.col("kind").startswith("s"), STATISTICS).otherwise(F.col("part") % passes)
                rows.withColumn("turn", next_turn).write.partitionBy("turn").parquet(between(k), mode="append")
                if k < order:
                    shutil.rmtree(f"{folder}/rows-{k + 1}/turn={turn}", ignore_errors=True)
            for kind, _, blob in done(k, STATISTICS).collect():  # a row per part and kind, seven numbers each
                own = [int.from_bytes(blob[i : i + 8], "little") for i in range(0, 56, 8)]
                total[kind] = [a + b for a, b in zip(total.get(kind, [0] * 7), own, strict=True)]
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
        for k in range(order, 0, -1):
            shutil.rmtree(f"{folder}/rows-{k}", ignore_errors=True)
    for k in range(order, 0, -1):
        n = total.get(f"sg{k}", [0] * 7)
        model.discounts[k] = d = discounts(n[:4])
        if k == 1 and n[5]:
            model.base = (float(n[5]), (d[0] * n[0] + d[1] * n[1] + d[2] * n[4]) / n[5])
    model.tokens, model.vocabulary = total.get("su", [0] * 7)[5:]
    return model


class Arrays:
    """The memory-mapped parts of one kind; keys ascend from part to part.

    A part is mapped when it is first looked up, and at most OPEN_PARTS of a kind are mapped at a time, so that a
    worker's open files do not grow with the corpus.
    """

    def __init__(self, model: NgramModel, kind: str, fields: int):
        self.bits, self.name, self.up, self.fields, self.parts = model.bits, f"{model.folder}/{kind}", 64 - key_bits(kind), fields, OrderedDict()

    def part(self, number: int) -> tuple[Any, ...] | None:
        """(ends, lower halves, codes, common records, places and records of the others) of a part; None where it holds nothing."""
        import numpy as np

        if number in self.parts:
            self.parts.move_to_end(number)
            return self.parts[number]
        path, found = f"{self.name}-{number}", None
        if os.path.exists(path):
            raw = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
            n, fields, common, rare, wide = (int(x) for x in raw[:40].view("<u8"))
            if n:
                found, at = [], 40
                for rows, columns, kind in (((1 << BUCKET_BITS) + 1, 1, "<u4"), (common, fields, "<u8"), (rare, 1, "<u8"), (rare, fields, "<u8" if wide else "<u4"), (n, 1, "<u4"), (n, 1, "u1")):
                    size = rows * columns * np.dtype(kind).itemsize
                    found.append(raw[at : at + size].view(kind).reshape(rows, columns))
                    at += size
        self.parts[number] = found
        if len(self.parts) > OPEN_PARTS:
            self.parts.popitem(last=False)
        return found

    def find(self, keys: Any) -> Any:
        """The record of each key, zeros where it is missing."""
        import numpy as np

        asked, back = np.unique(keys << np.uint64(self.up), return_inverse=True)
        out = np.zeros((len(asked), self.fields))
        part = (asked >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(asked), dtype=np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(asked)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a and (found := self.part(int(part[a]))):
                ends, common, rare, others, lower, codes = found
                own = within_part(asked[a:b], "", self.bits)  # the keys have all 64 bits here
                bucket, low = (own >> np.uint64(32)).astype(np.int64), (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                lo, end = ends[bucket, 0].astype(np.int64), ends[bucket + 1, 0].astype(np.int64)
                lower, step = lower[:, 0], 1 << int((end - lo).max()).bit_length() >> 1
                while step:  # all keys at a time, each in its bucket: forward over smaller ones by halved steps
                    probe = lo + step
                    right = lower.take(probe - 1, mode="clip") < low
                    right &= probe <= end
                    lo += right * np.int64(step)
                    step >>= 1
                at = np.minimum(lo, len(lower) - 1)
                hit = np.flatnonzero((lo < end) & (lower[at] == low))
                at = at[hit]
                code = codes[at, 0]
                got = np.zeros((len(hit), self.fields))
                known = code != RARE
                got[known] = common[code[known]]
                if not known.all():
                    got[~known] = others[np.searchsorted(rare[:, 0], at[~known].astype(np.uint64))]
                out[a + hit] = got
        return out[back.ravel()]


class Scorer:
    """Scores texts; what the arrays say of a word alone is looked up once a call."""

    def __init__(self, model: NgramModel):
        import numpy as np

        self.model = model
        self.raw = Arrays(model, "u", 1)
        self.grams = {k: Arrays(model, f"g{k}", FIELDS if k < model.order else 1) for k in range(1, model.order + 1)}
        # what stands before a text: start marks alone, as the context of each order
        none = np.zeros(1, dtype=np.uint64)
        self.start = {k: self.grams[k - 1].find(none if k == 2 else mix([none] * (k - 1)))[0] for k in range(2, model.order + 1)}

    def probabilities(self, columns: list[Any], records: Any, first: Any) -> Any:
        """Model probability of the last word of each n-gram given those before it.

        ``records`` are those of the last words alone; ``first`` are the places where texts begin.
        """
        import numpy as np

        m, before = self.model, None
        p = np.full(len(records), 1 / (m.vocabulary + 1))
        for k in range(1, m.order + 1):
            own = records if k == 1 else self.grams[k].find(mix(columns[m.order - k :]))
            a, d = own[:, 0], m.discounts[k]
            cut = np.array([0.0, *d])[np.minimum(a, 3).astype(np.int64)]
            if k == 1:
                total, gamma = np.full(len(p), m.base[0]), np.full(len(p), m.base[1])
            else:
                context = np.empty_like(before)  # the shorter n-gram that ends one token before
                context[1:] = before[:-1]
                context[first] = self.start[k]
                total = context[:, 1]
                gamma = sum(context[:, 2 + i] * d[i] for i in range(3)) / np.where(total > 0, total, 1)
            known = total > 0
            p = np.where(known, np.maximum(a - cut, 0) / np.where(known, total, 1) + gamma * p, p)
            before = own
        return p

    def room(self) -> int:
        """Tokens that are worth a call."""
        return min(MOST_ROOM, max(ROOM, ROOM_A_PART << self.model.bits))

    def __call__(self, tokens: Any, lengths: Any) -> tuple[Any, ...]:
        """(known tokens, base score, score) of each of the texts that ``token_stream`` has made these of."""
        import numpy as np

        m = self.model
        words, back = np.unique(tokens, return_inverse=True)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        c = self.raw.find(words)[back, 0]
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        score = np.log10(self.probabilities(grams(tokens >> np.uint64(NARROW), lengths, m.order), self.grams[1].find(words >> np.uint64(NARROW))[back], np.cumsum(lengths) - lengths))
        sums = [np.bincount(doc, weights=w, minlength=len(lengths)) for w in (c > 0, base, score)]
        return sums[0].astype(np.int64), sums[1], sums[2]


def scored(batches: Iterator, model: NgramModel) -> Iterator:
    """The rows of ``score_documents`` for Arrow batches (id, held_out, text)."""
    import numpy as np
    import pyarrow as pa

    score, held, n = None, [], 0

    def flush() -> Any:
        nonlocal held, n
        ids, folds, tokens, lengths = zip(*held, strict=True)
        held, n, lengths = [], 0, np.concatenate(lengths)
        known, base, own = score(np.concatenate(tokens), lengths)
        cols = [pa.concat_arrays(ids), pa.concat_arrays(folds), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), model.tokens)), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / lengths))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    for batch in batches:
        score = score or Scorer(model)
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            held.append((part.column(0), part.column(1), *token_stream(part.column(2))))
            n += len(held[-1][2])
            if n >= score.room():
                yield flush()
    if held:
        yield flush()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """A row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the documents outside the held-out fold and scores all.
    """
    held_out = F.coalesce(doc_crc(id_col) % FOLDS == HELD_OUT, F.lit(False))
    model = train(docs.filter(~held_out), text_col, order)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text")).mapInArrow(lambda batches: scored(batches, model), schema)
