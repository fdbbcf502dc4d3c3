"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in ``2**bits`` buckets, of its words, of the first 3
to 7 bytes of longer words (inflected and compounded forms share them), of pairs of
neighbours, and of pairs with one word between them; what occurs twice or more, and in one of
``RATE`` words or oftener, counts as a second feature. Every coordinate has its own learning rate,
and the L1 term sets most weights to exactly zero, so the model that is broadcast holds a few
thousand numbers at most (never more than twice ``2**bits``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_texts
from .kernels import ALNUM, LOWER, chunks, mix, owners, prefix, slice_hash, spans, words
from .sampling import fold, labelled

BITS = 20
STEMS = (3, 4, 5, 6, 7)
RATE = 192


def _features(buf: np.ndarray, offs: np.ndarray, bits: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and coordinate of every feature of every text, sorted; only of ``known`` coordinates if given."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, ALNUM)
    sums = prefix(low)
    h, owner = slice_hash(sums, starts, ends), owners(first)
    texts, found = [owner], [h]
    for size in STEMS:
        long = ends - starts > size
        texts.append(owner[long])
        found.append(mix(slice_hash(sums, starts[long], starts[long] + size) + np.uint64(size)))
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            texts.append(owner[gap:][same])
            found.append(mix(h[:-gap][same] * np.uint64(3) + h[gap:][same] * np.uint64(5) + np.uint64(salt)))
    text, bucket = np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    if known is not None:
        hit = (known[: 1 << bits] | known[1 << bits :])[bucket]
        text, bucket = text[hit], bucket[hit]
    both, times = np.unique(text << bits | bucket, return_counts=True)
    text, bucket = both >> bits, both & ((1 << bits) - 1)
    often = (times > 1) & (times * RATE >= np.diff(first)[text])
    text, at = np.concatenate([text, text[often]]), np.concatenate([bucket, bucket[often] + (1 << bits)])
    if known is not None:
        text, at = text[known[at]], at[known[at]]
    order = np.argsort(text, kind="stable")
    return text[order], at[order]


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the intercept, which has no penalty."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.last = 2 << bits
        self.z = np.zeros(self.last + 1)
        self.n = np.zeros(self.last + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.last, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, rows: list[tuple[np.ndarray, int]], epochs: int = 3) -> Ftrl:
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                at, label = rows[k]
                at = np.append(at, self.last)
                w = self.weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
                sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
                self.z[at] += g - sigma * w
                self.n[at] += g * g
        return self

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coordinates with a weight, their weights, and the intercept."""
        w = self.weights(np.arange(self.last + 1))
        at = np.flatnonzero(w[:-1])
        return at, w[at], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, limit: int = 6144, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``limit`` labelled rows (all folds but 0); with none, every score is 0.5."""
    sample = labelled(docs, labels, label, held_out=fold("doc_id", folds) == 0, limit=limit)

    def run(batches):
        for batch in batches:
            data, offs = spans(batch.column(2))
            out = []
            for i, j, buf, local in chunks(data, offs):
                text, at = _features(buf, local, bits)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                out += [at[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "found"])

    rows = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, found binary").toArrow().sort_by("doc_id")
    # views of the table's memory, which goes back to the system: the driver's is small
    out = Ftrl(bits).learn([(np.frombuffer(x.as_buffer(), np.uint32), y) for x, y in zip(rows["found"], rows["label"].to_pylist(), strict=True)]).compact()
    del rows
    pa.default_memory_pool().release_unused()
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, bits: int = BITS, keep: bool = False) -> DataFrame:
    """``score`` (0 to 1) beside the id, or beside the whole row as ``row``; null and empty texts get the intercept's."""
    at, w, bias = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((at.astype(np.int64), w.astype(np.float64), bias))

    def kernel(data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        at, w, bias = shared.value
        known = np.zeros(2 << bits, bool)
        known[at] = True
        total = np.full(len(offs) - 1, bias)
        for i, j, buf, local in chunks(data, offs):
            text, found = _features(buf, local, bits, known)
            total[i:j] += np.bincount(text, w[np.searchsorted(at, found)], j - i)
        return {"score": pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))}

    return map_texts(docs, kernel, "score double", keep=keep)


def report(scored: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
