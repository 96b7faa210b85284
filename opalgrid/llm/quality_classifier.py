"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text: its words (lower-cased) and the words' shapes (runs of letters and digits reduced to one mark, other
characters kept), single and in neighbouring pairs, and whether a word repeats the one before it; each hashed to one
of ``1 << BITS`` weights. Every occurrence weighs 1 / sqrt(number of features), so that a score is a sparse dot product.

Training reads a bounded sample: of the labelled rows outside the held-out fold about ``max_train`` are chosen by a
hash of their id (all, where there are fewer), whole texts each. The weights (1 MB whatever the corpus) are broadcast.

Defined results: a null or empty text scores by the bias alone; a null label or an id without a text is not learned
from; an id labelled more than once counts with its largest label; repeated rows get equal scores; without any label
every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opalgrid.llm.common import doc_crc, text_of

BITS = 18
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
MAX_TRAIN = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
CACHE = 400_000
_LETTERS, _DIGITS, _HIGH = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"[A-Z]+")


class Featurizer:
    """Turns texts into weight indices; remembers the hashes of up to CACHE distinct words."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[int] = []
        self.shapes: list[int] = []

    def _add(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        shape = _DIGITS.sub(b"0", _LETTERS.sub(b"a", _HIGH.sub(b"A", word)))
        self.ids[word] = at = len(self.words)
        self.words.append(xxh64_intdigest(word.lower(), 1))
        self.shapes.append(xxh64_intdigest(shape, 2))
        return at

    def __call__(self, texts: list[str]) -> tuple[Any, Any]:
        """(document number, weight index) of every feature occurrence; index 0 is left to the bias."""
        import numpy as np

        if len(self.words) > CACHE:
            self.__init__()
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        get, add = self.ids.get, self._add
        flat = np.array([i if (i := get(w)) is not None else add(w) for ws in split for w in ws], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        if not len(flat):
            return doc, flat
        word, shape = np.array(self.words, dtype=np.uint64)[flat], np.array(self.shapes, dtype=np.uint64)[flat]
        pair = doc[1:] == doc[:-1]
        first, second = np.flatnonzero(pair), np.flatnonzero(pair) + 1
        again = first[word[first] == word[second]]
        k1, k2, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            groups = [word * k1, shape * k1, word[first] * k1 ^ word[second] * k2, shape[first] * k1 ^ shape[second] * k2, np.full(len(again), 12345, np.uint64) * k2]
            index = np.concatenate([(g * k1) >> shift for g in groups]).astype(np.int64)
        return np.concatenate([doc, doc, doc[first], doc[first], doc[again]]), np.maximum(index, 1)


def ftrl(rows: list[tuple[Any, Any, int]], epochs: int = EPOCHS) -> Any:
    """Weights after ``epochs`` passes over (indices, values, label), in the given order."""
    import numpy as np

    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: Any) -> Any:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(1 << BITS)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """The weights as float32 bytes. One task trains, on the bounded sample; the others only read and filter."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (doc_crc(id_col) % FOLDS != HELD_OUT))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    place = (F.xxhash64(F.lit("train"), F.col("_id")).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    known = known.withColumn("_place", place)
    part = min(1.0, max_train / max(1, known.count()))
    sample = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    # the sample of labels is bounded by max_train, hence the broadcast
    sample = sample.join(F.broadcast(known.filter(F.col("_place") < part)), "_id").select("_text", "_y", "_place")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        make, rows = Featurizer(), []
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                doc, index = make(list(part["_text"]))
                order = np.argsort(doc, kind="stable")
                for i, own in enumerate(np.split(index[order], np.searchsorted(doc[order], np.arange(1, len(part))))):
                    u, c = np.unique(own, return_counts=True)
                    x = np.concatenate([[1.0], c / np.sqrt(max(1, len(own)))]).astype(np.float32)
                    rows.append((part["_place"].iloc[i], np.concatenate([[0], u]).astype(np.int32), x, int(part["_y"].iloc[i])))
        rows.sort(key=lambda r: r[0])
        yield pd.DataFrame({"weights": [ftrl([r[1:] for r in rows]).tobytes()]})

    row = sample.repartition(1).mapInPandas(learn, "weights binary").first()
    return bytes(row["weights"]) if row else bytes(4 << BITS)


def scorer(weights: bytes) -> Callable[[Column], Column]:
    """A column function: the probability that a text has label 1."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        w, make = np.frombuffer(weights, dtype=np.float32), Featurizer()
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                part = list(texts.iloc[at : at + 512])
                doc, index = make(part)
                sums, n = np.bincount(doc, weights=w[index], minlength=len(part)), np.bincount(doc, minlength=len(part))
                out.append(1 / (1 + np.exp(-np.clip(w[0] + sums / np.sqrt(np.maximum(1, n)), -35, 35))))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return lambda text: score(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: Any) -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col, **how))
    out = docs.select(F.col(id_col), F.coalesce(doc_crc(id_col) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: Any) -> DataFrame:
    """The documents whose score reaches THRESHOLD, with all their columns."""
    return docs.filter(scorer(train(docs, labels, id_col=id_col, text_col=text_col, **how))(F.col(text_col)) >= THRESHOLD)
