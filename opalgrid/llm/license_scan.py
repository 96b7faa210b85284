"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingles verify them.

Words are lower-cased and stripped of punctuation at their ends; a shingle is five neighbouring words. A template of m
shingles is looked for in windows of m to 1.2 m shingles that overlap by about three quarters. A window and a template are a
candidate pair if any of BANDS one-row bands agree, that is if under one of BANDS hash orders their smallest shingles
are equal. For a passage that holds 0.8 of a template, the best window has a resemblance of at least 0.5, so that a pair
is missed with probability 0.5 ** BANDS, under 4e-6. A candidate is accepted if the document holds at least
``containment`` of the template's distinct shingles, compared as words.

Templates are the whole license texts of ``licenses/`` and common notices. Versions of one license share much of their
text: of those in one group of VERSIONS, a template that matches less well than another one is reported only if the
document also holds ``containment`` of the shingles that the other lacks.

Every task scans its own rows; the templates are the only thing shared, and nothing is shuffled.

Defined results: null, empty and shorter texts match nothing; ties cannot occur, as every template that matches is
reported once per row; repeated rows are reported each; an empty table or no template gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from importlib.resources import files
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import text_of

SHINGLE = 5
BANDS = 18
CONTAINMENT = 0.8
CACHE = 400_000
BLOCK = 16
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Short notices and the opening paragraphs of well-known licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}

#: The whole texts.
TEXTS = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in sorted(files("opalgrid.llm").joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
TEMPLATES = NOTICES | TEXTS

#: Templates of which a document's text usually is one, not several.
VERSIONS = (
    {"GPL-2.0", "GPL-3.0"},
    {"CC-BY-4.0-notice", "CC-BY-SA-4.0-notice", "CC-BY-NC-4.0-notice"},
    {"GPL-notice", "LGPL-notice"},
    {"BSD-2-Clause-text", "BSD-3-Clause-text"},
    {"GFDL-1.2-text", "GFDL-1.3-text"},
    {"GPL-1.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.0-text", "LGPL-2.1-text", "LGPL-3.0-text"},
    {"MPL-1.1-text", "MPL-2.0-text"},
)


def scan_words(text: str) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in text.encode("utf-8", "surrogatepass").lower().split()) if w]


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def window(m: int) -> tuple[int, int]:
    """(step, steps in a window) for a template of m shingles; long steps are multiples of BLOCK, so that they share minima."""
    if m < 24:
        step = max(1, m // 4)
    elif m < 8 * BLOCK:
        step = -(-m // 4)
    else:
        step = m // (8 * BLOCK) * BLOCK
    return step, -(-m // step)


class Scanner:
    def __init__(self, templates: Mapping[str, str], containment: float):
        import numpy as np

        self.containment, self.hashes = containment, {}
        self.sets = {name: set(shingles(scan_words(t))) for name, t in templates.items()}
        rng = np.random.default_rng(5)
        self.factors = (rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        #: window (step, steps) -> band -> smallest hash -> names
        self.wanted: dict[tuple[int, int], list[dict[int, list[str]]]] = {}
        for name, own in self.sets.items():
            if own:
                bands = self.wanted.setdefault(window(len(own)), [{} for _ in range(BANDS)])
                h = self.shingle_hashes([w for s in own for w in s])[::SHINGLE]
                with np.errstate(over="ignore"):
                    for band, factor in zip(bands, self.factors, strict=True):
                        band.setdefault(int((h * factor).min()), []).append(name)

    def shingle_hashes(self, words: list[bytes]) -> Any:
        import numpy as np
        from xxhash import xxh64_intdigest

        if len(self.hashes) > CACHE:
            self.hashes.clear()
        get, put = self.hashes.get, self.hashes.setdefault
        h = np.array([v if (v := get(w)) is not None else put(w, xxh64_intdigest(w, 3)) for w in words], dtype=np.uint64)
        n, out = max(0, len(h) - SHINGLE + 1), np.zeros(max(0, len(h) - SHINGLE + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE):
                out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(31)
        return out

    def candidates(self, h: Any) -> Iterator[tuple[int, int, str]]:
        """(first, last, name): windows of shingle numbers that share a band with a template."""
        import numpy as np

        for band, factor in enumerate(self.factors):
            with np.errstate(over="ignore"):
                every = h * factor
            blocks = np.minimum.reduceat(every, np.arange(0, len(h), BLOCK))
            for (step, span), bands in self.wanted.items():
                unit, low = (BLOCK, blocks) if step % BLOCK == 0 else (1, every)
                if step > unit:
                    low = np.minimum.reduceat(low, np.arange(0, len(low), step // unit))
                if span > 1:
                    padded = np.concatenate([low, np.full(span - 1, np.iinfo(np.uint64).max, dtype=np.uint64)])
                    low = np.minimum.reduce([padded[i : i + len(low)] for i in range(span)])
                for value, names in bands[band].items():
                    for at in np.flatnonzero(low == np.uint64(value)):
                        for name in names:
                            yield int(at) * step, min(len(h), int(at) * step + step * span) - 1, name

    def outdone(self, name: str, share: float, held: dict[str, float], own: set[tuple[bytes, ...]]) -> bool:
        """Whether the match is only what the template shares with a better matching version."""
        for other in held:
            if held[other] > share and any({name, other} <= group for group in VERSIONS):
                rest = self.sets[name] - self.sets[other]
                if len(rest & own) < self.containment * len(rest):
                    return True
        return False

    def __call__(self, texts: list[str]) -> list[tuple[int, str, float, int]]:
        """(text number, template, containment, first matching word) of every match."""
        import numpy as np

        words = [scan_words(t) for t in texts]
        flat = [w for ws in words for w in ws]
        if len(flat) < SHINGLE:
            return []
        h = self.shingle_hashes(flat)
        ends = np.cumsum([len(ws) for ws in words])
        pairs = set()
        for first, last, name in self.candidates(h):
            a, b = np.searchsorted(ends, [first, last + SHINGLE - 1], side="right")
            pairs |= {(i, name) for i in range(int(a), min(int(b), len(texts) - 1) + 1)}
        out = []
        for i, found in groupby(sorted(pairs), key=lambda pair: pair[0]):
            own = shingles(words[i])
            every = set(own)
            shares = {name: len(self.sets[name] & every) / len(self.sets[name]) for _, name in found}
            held = {name: share for name, share in shares.items() if share >= self.containment}
            for name, share in held.items():
                if not self.outdone(name, share, held, every):
                    out.append((i, name, share, next(k for k, s in enumerate(own) if s in self.sets[name])))
        return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and matching template: doc_id, license, containment, start_word."""
    fixed = dict(templates)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = Scanner(fixed, containment)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, found = part.column(0).to_pylist(), scan(part.column(1).to_pylist())
                if found:
                    i, names, share, start = zip(*found, strict=True)
                    cols = [pa.array([ids[k] for k in i], pa.int64()), pa.array(names), pa.array(share), pa.array(start, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "license", "containment", "start_word"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, containment double, start_word long")
