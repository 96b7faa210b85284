"""Hierarchical multi-length packing.

Documents are tokenised and packed where they were read: a task keeps a block of about ``block_tokens`` tokens, packs
it, and goes on, so that memory is bounded and nothing is shuffled. In a block

1. whole longest windows are cut from long documents, and every remainder is routed to the smallest tier that holds it;
2. each tier is packed, longest first: the gap that a remainder leaves in its window is filled with the largest
   documents of shorter tiers that fit, and what is then still open is closed by cutting one shorter document;
3. the sequences are dealt to step groups of about ``step_tokens`` tokens, longest first to the group with the least
   attention cost (sum of squared lengths), so that groups of one block cost about the same.

A remainder for which no filler is left is cut down the tiers; what stays below the smallest tier moves on to the next
block, and at the end of a task it leaves as sequences of a power of two. No sequence has any padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; a null id
is passed on; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import text_of

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer, read from its JSON file and, for speed, from the same vocabulary as ranks.

    Texts that hold a special token's own string go through the ``tokenizers`` library itself.
    """

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb") if line.strip())}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pack_block(items: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Packs pieces (slot, start, length) into full windows; returns the windows and what waits for the next block."""
    top, low = tiers[-1], tiers[0]
    windows: list[list[tuple[int, int, int]]] = []
    short: list[tuple[int, int, int]] = []  # (length, slot, start), sorted
    by_tier: dict[int, list[tuple[int, int, int]]] = {c: [] for c in tiers}
    for slot, start, length in items:
        while length >= top:
            windows.append([(slot, start, top)])
            start, length = start + top, length - top
        if length:
            by_tier[next(c for c in tiers if length <= c)].append((length, slot, start))
    for c in tiers[:-1]:
        short.extend(by_tier[c])
    short.sort()

    def take(gap: int) -> tuple[int, int, int] | None:
        """The largest piece of at most ``gap`` tokens, or else ``gap`` tokens cut from the next larger one."""
        at = bisect_right(short, (gap, float("inf"), 0))
        if at:
            length, slot, start = short.pop(at - 1)
            return slot, start, length
        if at < len(short):
            length, slot, start = short.pop(at)
            insort(short, (length - gap, slot, start + gap))
            return slot, start, gap
        return None

    for c in reversed(tiers[1:]):
        if c != top:  # what is left of this tier, and nothing longer, is packed now
            at = bisect_right(short, (c // 2, float("inf"), 0))
            mine, short[at:] = short[at:], []
        else:
            mine = sorted(by_tier[c])
        while mine:
            length, slot, start = mine.pop()
            window, gap = [(slot, start, length)], c - length
            while gap and short:
                piece = take(gap)
                window.append(piece)
                gap -= piece[2]
            if not gap:
                windows.append(window)
                continue
            for piece in window:  # fillers have run out: down the tiers
                _split(piece, tiers, windows, short)
    window, gap = [], low
    while short:
        piece = take(gap)
        window.append(piece)
        gap -= piece[2]
        if not gap:
            windows.append(window)
            window, gap = [], low
    if window and last:
        left, at = sum(p[2] for p in window), 0
        for size in (1 << b for b in reversed(range(left.bit_length())) if left >> b & 1):
            part = []
            while size:
                slot, start, length = window[at]
                n = min(size, length)
                part.append((slot, start, n))
                window[at] = (slot, start + n, length - n)
                at, size = at + (n == length), size - n
            windows.append(part)
        window = []
    return windows, window


def _split(piece: tuple[int, int, int], tiers: tuple[int, ...], windows: list, short: list) -> None:
    slot, start, length = piece
    for c in reversed(tiers):
        while length >= c:
            windows.append([(slot, start, c)])
            start, length = start + c, length - c
    if length:
        insort(short, (length, slot, start))


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """For each sequence the number of its step group: longest first to the group with the least cost so far."""
    n = max(1, round(sum(lengths) / step_tokens))
    heap, out = [(0, 0, g) for g in range(n)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        cost, tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (cost + lengths[i] ** 2, tokens + lengths[i], g))
    return out


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = 1 << 20,
    step_tokens: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    ``path`` and ``ranks_path`` name the tokenizer's JSON file and the same vocabulary as ranks; both must be readable
    on the workers. ``tiers`` are powers of two, ascending. ``tier`` is the length of the sequence that holds the piece.
    """
    if path is None or ranks_path is None:
        import public_tokenizers

        path, ranks_path = path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, base, held, kept = ByteBpe(path, ranks_path), TaskContext.get().partitionId() << 36, [], []
        counts = {"sequence": 0, "step": 0, "tokens": 0}
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, kept
            windows, rest = pack_block(kept + [(slot, 0, len(ids)) for slot, (_, ids) in enumerate(held) if slot >= counts.get("old", 0)], tiers, last)
            steps = step_groups([sum(p[2] for p in w) for w in windows], step_tokens) if windows else []
            cols: list[list] = [[] for _ in names]
            for window, step in zip(windows, steps, strict=True):
                offset, size = 0, sum(p[2] for p in window)
                for slot, start, length in window:
                    doc, ids = held[slot]
                    row = (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), base + counts["sequence"], offset, size, base + counts["step"] + step)
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    offset += length
                counts["sequence"] += 1
            counts["step"] += max(steps, default=-1) + 1
            slots = sorted({p[0] for p in rest})
            kept = [(slots.index(s), a, n) for s, a, n in rest]
            held, counts["old"], counts["tokens"] = [held[s] for s in slots], len(slots), 0
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names) if cols[0] else None

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*bpe.encode(text.as_py()), end_id], dtype="<u4")
                held.append((doc, ids))
                counts["tokens"] += len(ids)
                if counts["tokens"] >= block_tokens and (out := flush(False)) is not None:
                    yield out
        if held and (out := flush(True)) is not None:
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)
