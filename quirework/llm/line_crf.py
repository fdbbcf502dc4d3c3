"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its features (shares of kinds of characters, length, repetition within
it, repeats of other lines) and those of the lines before and after it are binned, and each bin
has a weight; transitions tie neighbours together. Lines are trained with the label of their document. A text's
score is the mean of its lines' forward-backward marginals of being good, weighted by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_texts
from .kernels import LOWER, NOT_SPACE, chunks, grams, mix, prefix, slice_hash, spans, words
from .sampling import fold, labelled

#: Kinds of bytes, as shares of a line's bytes.
KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": [0x20, *range(0x09, 0x0E)],
    "stop": b".,;:",
    "call": b"!?",
    "symbol": b"#*$%&|<>@^~=+_\\/{}[]",
    "quote": b"\"'()-",
    "wide": range(0x80, 0x100),
}
MEMBER = np.zeros((len(KINDS), 256), dtype=bool)
for _row, _bytes in enumerate(KINDS.values()):
    MEMBER[_row, list(_bytes)] = True
EDGES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.0])  # a value's bin: how many edges are below it
BINS = len(EDGES) + 1
SHARES = [*KINDS, "repeated_words", "repeated_triples", "repeated_line", "word_length", "line_length", "text_length", "long_words"]
N_FEATURES = len(SHARES) * BINS * 3 + 1
GOOD, BAD = 1, 0


def line_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, weight, active features) of every line; an empty text has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    of_break = np.searchsorted(offs, breaks, "right") - 1
    begin = np.concatenate([offs[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), of_break])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, offs[doc + 1], np.append(begin[1:], 0) - 1)
    n = np.maximum(end - begin, 1).astype(float)
    value = np.zeros((len(SHARES), len(begin)))
    for row in range(len(KINDS)):
        total = np.concatenate([[0], np.cumsum(MEMBER[row][buf])])
        value[row] = (total[end] - total[begin]) / n
    low = LOWER[buf]
    sums = prefix(low)
    starts, ends, _ = words(low, offs, NOT_SPACE)
    h = slice_hash(sums, starts, ends)
    line = np.searchsorted(begin, starts, "right") - 1
    at = np.flatnonzero(np.diff(np.concatenate([[-1], doc, [doc[-1] + 1 if len(doc) else 0]])))
    size = np.bincount(line, minlength=len(begin))
    many = np.maximum(size, 1)

    def repeated(keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(begin))
        both = mix(keys + where.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        first = np.unique(both, return_index=True)[1]
        return 1 - np.bincount(where[first], minlength=len(begin)) / np.maximum(1, np.bincount(where, minlength=len(begin)))

    value[len(KINDS)] = repeated(h, line)
    triples = grams(h, 3)
    inside = line[: len(triples)] == line[2 : 2 + len(triples)]
    value[len(KINDS) + 1] = repeated(triples[inside], line[: len(triples)][inside])
    key = mix(slice_hash(sums, begin, end) + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    value[len(KINDS) + 2] = (times[inverse] - 1) / 10 * (size > 0)
    length = ends - starts
    value[len(KINDS) + 3] = np.bincount(line, length, len(begin)) / many / 20
    value[len(KINDS) + 4] = np.log2(n) / 14
    value[len(KINDS) + 5] = np.log2(np.maximum(1, np.diff(offs)))[doc] / 20
    value[len(KINDS) + 6] = np.bincount(line[length > 24], minlength=len(begin)) / many
    bins = np.searchsorted(EDGES, value, "left").T + np.arange(len(SHARES)) * BINS  # value 0 is bin 0
    width = len(SHARES) * BINS
    none = np.full((1, len(SHARES)), N_FEATURES - 1)
    before, after = np.concatenate([none, bins[:-1] + width]), np.concatenate([bins[1:] + 2 * width, none])
    before[at[at < len(doc)]] = N_FEATURES - 1  # no line before the first, none after the last
    after[last] = N_FEATURES - 1
    return doc, n, np.concatenate([bins, before, after], 1).astype(np.int32)


class Crf:
    def __init__(self) -> None:
        self.weight = np.zeros(N_FEATURES)  # for good; for bad it is the negative
        self.step = np.zeros((2, 2))

    def marginals(self, doc: np.ndarray, active: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward; with ``pairs`` also summed pair marginals and log Z."""
        lead = self.weight[active].sum(1)
        score = np.stack([-lead, lead], 1)
        lines, texts = len(doc), int(doc[-1]) + 1 if len(doc) else 0
        first = np.searchsorted(doc, np.arange(texts + 1))
        count = np.diff(first)
        by_length = np.argsort(-count, kind="stable")
        first, count = first[:-1][by_length], count[by_length]
        alpha, beta = np.zeros((lines, 2)), np.zeros((lines, 2))
        alive = [int(np.searchsorted(-count, -t, "left")) for t in range(int(count[0]) if texts else 0)]
        for t, k in enumerate(alive):
            at = first[:k] + t
            alpha[at] = score[at] if not t else score[at] + np.logaddexp(alpha[at - 1, :1] + self.step[0], alpha[at - 1, 1:] + self.step[1])
        for t in range(len(alive) - 2, -1, -1):
            k = alive[t + 1]
            at = first[:k] + t
            ahead = score[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(self.step[:, 0] + ahead[:, :1], self.step[:, 1] + ahead[:, 1:])
        both = alpha + beta
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, GOOD] - log_z)
        if not pairs:
            return good
        inner = np.flatnonzero(doc[1:] == doc[:-1])
        joint = alpha[inner][:, :, None] + self.step + (score[inner + 1] + beta[inner + 1])[:, None, :] - log_z[inner][:, None, None]
        return good, np.exp(joint).sum(0), inner

    def learn(self, doc: np.ndarray, active: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.05, l2: float = 1e-4) -> Crf:
        """Maximises the mean log likelihood of the label sequences (each text counts ``weight``) by Adam."""
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.weight, self.step)]
        per_line = weight[doc]
        for k in range(1, steps + 1):
            good, joint, inner = self.marginals(doc, active, pairs=True)
            error = (label[doc] - good) * per_line
            g_weight = 2 * np.bincount(active.ravel(), np.repeat(error, active.shape[1]), N_FEATURES) / len(doc)
            wanted = np.zeros((2, 2))
            np.add.at(wanted, (label[doc[inner]], label[doc[inner + 1]]), 1)
            g_step = (wanted - joint) / len(doc)
            for p, g, (m, v) in zip((self.weight, self.step), (g_weight, g_step), moments, strict=True):
                g = g - l2 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, limit: int = 6144) -> Crf:
    """A field learnt from at most ``limit`` labelled rows (all folds but 0); with none, every score is 0.5."""
    sample = labelled(docs, labels, label, held_out=fold("doc_id", folds) == 0, limit=limit)

    def run(batches):
        for batch in batches:
            out = []
            for i, j, buf, offs in chunks(*spans(batch.column(2))):
                doc, _, active = line_features(buf, offs)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                out += [active[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "lines"])

    rows = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, lines binary").toArrow().sort_by("doc_id")
    if not len(rows):
        return Crf()
    lines = [np.frombuffer(x, np.uint16).reshape(-1, len(SHARES) * 3) for x in rows["lines"].to_pylist()]
    y = rows["label"].to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return Crf().learn(doc, np.concatenate(lines).astype(np.int64), y, np.ones(len(lines)))


def score(docs: DataFrame, model: Crf, *, keep: bool = False) -> DataFrame:
    """``score`` (0 to 1) beside the id or the whole row; null and empty texts are scored as one empty line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        out = np.zeros(len(offs) - 1)
        for i, j, buf, local in chunks(data, offs, 4 << 20):
            doc, weight, active = line_features(buf, local)
            good = shared.value.marginals(doc, active)
            out[i:j] = np.bincount(doc, good * weight, j - i) / np.bincount(doc, weight, j - i)
        return {"score": pa.array(np.clip(out, 0, 1))}

    return map_texts(docs, kernel, "score double", keep=keep)


def report(scored: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
