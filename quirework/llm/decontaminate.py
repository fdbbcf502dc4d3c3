"""Benchmark decontamination by winnowing.

A fingerprint of a text is the smallest ``k``-word hash of every ``window - k + 1`` consecutive
ones. Two texts that share ``window`` words share that run's smallest hash, so every such span
has a common fingerprint. Fingerprints of documents are joined with those of the benchmark, and
each hit is extended to the whole windows around it, which are compared with the windows of the
items. Items of fewer words than a window (but not none) are looked up as they are.

The index of the benchmark is broadcast, in parts whose size is measured before: ``index_bytes``
of benchmark text at most in one part (an item is never split). A larger benchmark makes more
passes over the documents, each with one part, and the hits of the passes are merged; neither
memory nor results depend on the number of parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .kernels import ALNUM, LOWER, chunks, grams, owners, prefix, slice_hash, sliding, spans, words

K = 5


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, first = words(low, offs, ALNUM)
    return slice_hash(prefix(low), starts, ends), first


def _winnowed(hashes: np.ndarray, owner: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions of k-grams that are smallest in some window of their text."""
    g = grams(hashes, k)
    span = window - k + 1
    if len(g) < span:
        return np.zeros(0, np.int64)
    least = sliding(g, span, np.minimum)
    least[owner[: len(least)] != owner[window - 1 : window - 1 + len(least)]] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return np.flatnonzero((sliding(padded, span, np.maximum) == g) & (g > 0))


class Index:
    """Windows of benchmark items by length, with the items of each, and their fingerprints."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.k = min(K, window)
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        pairs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for name, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _ = _tokens(raw, np.array([0, len(raw)]))
            if not len(h):
                continue
            size = min(window, len(h))
            g = grams(h, size)
            pairs.setdefault(size, []).append((g, np.full(len(g), number[name])))
            if size == window:
                prints.append(grams(h, self.k)[_winnowed(h, np.zeros(len(h)), window, self.k)])
        self.prints = np.unique(np.concatenate(prints))
        self.by_size = {}
        for size, found in pairs.items():
            g, item = (np.concatenate(x) for x in zip(*found, strict=True))
            both = np.unique(np.stack([g, item.astype(np.uint64)], 1), axis=0)
            values, begin = np.unique(both[:, 0], return_index=True)
            self.by_size[size] = (values, np.append(begin, len(both)), both[:, 1].astype(np.int64))

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, rows of the table of windows) of what occurs in the texts."""
        for size, (values, _, _) in self.by_size.items():
            at = np.arange(max(0, len(hashes) - size + 1))
            if size == self.window:
                seed = _winnowed(hashes, owner, size, self.k)
                seed = seed[_member(grams(hashes, self.k)[seed], self.prints)[0]]
                at = np.unique((seed[:, None] - np.arange(size - self.k + 1)).ravel())
                at = at[(at >= 0) & (at + size <= len(hashes))]
            at = at[owner[at] == owner[at + size - 1]]
            found, row = _member(grams(hashes, size)[at], values)
            yield size, at[found], row[found]


def _member(x: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.searchsorted(values, x)
    row[row == len(values)] = 0
    return (values[row] == x if len(values) else np.zeros(len(x), bool)), row


def _parts(benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in parts of about ``index_bytes`` of text; items without id or text have no windows."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // index_bytes + 1
    for part in range(n):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == part).collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    index_bytes: int = 32 << 20,
) -> DataFrame:
    """Each input row as ``row``, with its hits.

    ``n_words``; ``hits``: disjoint runs of hit words as [first, last + 1] indexes of words;
    ``items``: the ids, sorted as strings, of items with a window in the text. Null and empty
    texts have no words and no hits; repeated rows are judged each; with an empty benchmark
    nothing is hit.
    """
    spark = docs.sparkSession
    fields = [T.StructField("row", T.StructType(docs.schema.fields)), *T.StructType.fromDDL("n_words bigint, hits array<array<bigint>>, items array<string>").fields]
    names = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    out = out.select("row", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<array<bigint>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    at = names.index(text_col)
    for part, items in enumerate(_parts(benchmark, item_col, item_text_col, index_bytes)):
        index = spark.sparkContext.broadcast(Index(items, window))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0)
                n, hits, found = _scan(index.value, *spans(row.flatten()[at]), batch.column(2), batch.column(3))
                yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), hits, found], ["row", "n_words", "hits", "items"])

        out = (cut(out) if part else out).mapInArrow(run, T.StructType(fields))
    return out


def _scan(index: Index, data: np.ndarray, offs: np.ndarray, hits: pa.Array, items: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words of each text, and the hits of earlier parts joined by those of ``index``."""
    n_words = np.zeros(len(offs) - 1, np.int64)
    all_hits, all_items = [[]] * len(n_words), [[]] * len(n_words)
    for i in np.flatnonzero(np.diff(items.offsets.to_numpy())):
        all_hits[i], all_items[i] = hits[i].as_py(), items[i].as_py()
    for i, j, buf, local in chunks(data, offs):
        h, first = _tokens(buf, local)
        owner = owners(first)
        n_words[i:j] = np.diff(first)
        found = [(size, at, row) for size, at, row in index.hits(h, owner) if len(at)]
        if not found:
            continue
        edge = np.zeros(len(h) + 1, np.int64)
        named: dict[int, set[str]] = {}
        for size, at, row in found:
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            _, begin, item = index.by_size[size]
            for doc, r in set(zip(owner[at].tolist(), row.tolist(), strict=True)):
                named.setdefault(doc, set()).update(index.names[x] for x in item[begin[r] : begin[r + 1]])
        covered = np.cumsum(edge)[:-1] > 0
        for doc, new in named.items():
            a = first[doc]
            flags = covered[a : first[doc + 1]].copy()
            for x, y in all_hits[i + doc]:
                flags[x:y] = True
            runs = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)
            all_hits[i + doc] = runs.tolist()
            all_items[i + doc] = sorted(new | set(all_items[i + doc]))
    return n_words, pa.array(all_hits, pa.list_(pa.list_(pa.int64()))), pa.array(all_items, pa.list_(pa.string()))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of ``decontaminate`` for each document, with a digest of the items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x[1] - x[0])
    return found.select(
        F.col("row")[id_col].alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple]:
    """What ``report`` returns, from the definition; for tests on small inputs."""
    import re

    def tokens(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for doc, text in docs:
        w, hit, got = tokens(text), set(), set()
        for item, body in items:
            b = tokens(body)
            size = min(window, len(b))
            wanted = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
            for i in range(len(w) - size + 1):
                if wanted and tuple(w[i : i + size]) in wanted:
                    hit.update(range(i, i + size))
                    got.add(str(item))
        out.append((doc, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
