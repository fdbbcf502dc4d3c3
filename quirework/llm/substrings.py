"""Suffix-array dedup: bytes covered by long strings that also start in an earlier document.

The array of all suffixes is sorted only as far as it decides something. Names (ranks) of strings
come from sorting them, by hash bucket, and pairs of names at growing offsets give the names of
longer strings, as in prefix doubling; a position leaves when its name is unique or its string is
past the threshold:

* length ``base`` (half the threshold): names at sampled positions. Each string of threshold
  length has one sample, where the smallest of the names in it starts; that is at the same place in all
  its copies. Names of one document only leave.
* the context: the name with the strings on both sides of it, as far as a threshold-long string
  around it can reach. Where an earlier document has the same context, every such string is a
  repeat, and the position leaves; where all contexts of a name are one, it leaves too.
* length ``threshold``: pairs of names ``threshold - base`` apart, at the positions of what is
  left (strings whose sample is undecided: those near the ends of a repeat).

Sampling decides nothing by itself: with it, rows and shuffled bytes are a small part of what a
row for each byte would take, and the result is the same. Names are 64-bit hashes, and strings are
compared by them. They travel packed by (hash bucket, block of documents), each block with the
smallest id of each name, so a string that is in every document costs a block one entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, prefix, slice_hash, sliding, window_hash
from .packed import EMPTY, block_plan, find, in_blocks, least, packed, planes, rows_of, texts, unpacked


class Samples:
    """The sampled positions of some texts in one buffer."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, threshold: int):
        base = threshold // 2
        self.reach = threshold - base
        self.threshold, self.offs = threshold, offs
        self.sums = prefix(buf)
        self.names = window_hash(self.sums, base)
        self.valid = np.zeros(len(buf), bool)  # where a string of threshold length starts
        lengths = np.diff(offs)
        for a, b in zip(offs[:-1][lengths >= threshold].tolist(), offs[1:][lengths >= threshold].tolist(), strict=True):
            self.valid[a : b - threshold + 1] = True
        self.starts = np.flatnonzero(self.valid)
        # the sample of each such string: its leftmost smallest name, by the name's upper bits
        low = np.uint64((1 << len(buf).bit_length()) - 1)
        ranked = (self.names & ~low) | np.arange(len(self.names), dtype=np.uint64)
        self.sample = (sliding(ranked, self.reach + 1, np.minimum)[self.starts] & low).astype(np.int64) if len(self.starts) else self.starts
        chosen = np.zeros(len(buf), bool)
        chosen[self.sample] = True
        self.at = np.flatnonzero(chosen)
        self.doc = np.searchsorted(offs, self.at, "right") - 1
        self.name = self.names[self.at]

    def contexts(self) -> np.ndarray:
        low = np.maximum(self.at - self.reach, self.offs[self.doc])
        high = np.minimum(self.at + self.threshold, self.offs[self.doc + 1])
        return mix(slice_hash(self.sums, low, high) + (self.at - low).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + (high - self.at).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))

    def strings(self, undecided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the threshold-long strings whose sample is undecided."""
        open_ = np.zeros(len(self.valid), bool)
        open_[self.at[undecided]] = True
        at = self.starts[open_[self.sample]]
        return at, mix(self.names[at] * np.uint64(3) + self.names[at + self.reach] * np.uint64(0x9FB21C651E98DF25))


def _sampled_names(threshold: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        names, docs = [EMPTY], [np.zeros(0, np.int64)]
        for ids, buf, offs in texts(table):
            s = Samples(buf, offs, threshold)
            names.append(s.name)
            docs.append(ids[s.doc])
        name, doc = np.concatenate(names), np.concatenate(docs)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        # a name that several documents of the block have is sent twice
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if len(name) else np.zeros(0, bool)
        name = name[new]
        rank = np.arange(len(name)) - np.searchsorted(name, name)
        name = name[rank < 2]
        low = (name & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        return packed(table["block"][0].as_py(), low.astype(np.int64), buckets, names=(name >> np.uint64(32)).astype(np.uint32))

    return run


def _shared_names(table: pa.Table) -> pa.Table:
    name, row = unpacked(table, "names", np.uint32), rows_of(table, "names", 4)
    _, inverse, times = np.unique(name, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    name, row = name[shared], row[shared]
    cut = np.searchsorted(row, np.arange(len(table) + 1))
    blobs = [planes(np.unique(name[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "names": pa.array(blobs, pa.binary())})


def _contexts(threshold: int, buckets: int):
    def run(held: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(held) or not len(shared):
            return packed(0, np.zeros(0, np.int64), buckets, names=EMPTY, contexts=EMPTY, docs=np.zeros(0, np.int64))
        high = shared["bucket"].to_numpy().astype(np.uint64)[rows_of(shared, "names", 4)] << np.uint64(32)
        known = np.sort(high | unpacked(shared, "names", np.uint32).astype(np.uint64))
        name, context, doc = [EMPTY], [EMPTY], [np.zeros(0, np.int64)]
        for ids, buf, offs in texts(held):
            s = Samples(buf, offs, threshold)
            low = (s.name & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            kept = find(known, low << np.uint64(32) | s.name >> np.uint64(32))[0]
            name.append(s.name[kept])
            context.append(s.contexts()[kept])
            doc.append(ids[s.doc[kept]])
        name, context, doc = np.concatenate(name), np.concatenate(context), np.concatenate(doc)
        order = np.lexsort((doc, context, name))
        name, context, doc = name[order], context[order], doc[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (name[1:] != name[:-1])]) if len(name) else np.zeros(0, bool)
        name, context, doc = name[new], context[new], doc[new]
        return packed(held["block"][0].as_py(), (name % np.uint64(buckets)).astype(np.int64), buckets, names=name, contexts=context, docs=doc)

    return run


def _ranked_contexts(table: pa.Table) -> pa.Table:
    """For each block: contexts that an earlier document has, with it, and names with several contexts."""
    name, context, doc = unpacked(table, "names"), unpacked(table, "contexts"), unpacked(table, "docs", np.int64)
    row = rows_of(table, "names", 8)
    contexts, docs = least(context, doc)
    first = docs[np.searchsorted(contexts, context)]
    pairs = np.unique(np.stack([name, context], 1), axis=0)
    names, times = np.unique(pairs[:, 0], return_counts=True)
    open_ = np.isin(name, names[times > 1])
    cut = np.searchsorted(row, np.arange(len(table) + 1))
    seen, by, several = [], [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        earlier = first[a:b] < doc[a:b]
        seen.append(planes(context[a:b][earlier]))
        by.append(planes(first[a:b][earlier]))
        several.append(planes(np.unique(name[a:b][open_[a:b]])))
    return pa.table({"block": table["block"], "names": pa.array(several, pa.binary()), "seen": pa.array(seen, pa.binary()), "docs": pa.array(by, pa.binary())})


class Ranked:
    """What ``_ranked_contexts`` found for a block, joined by the block's own smallest documents."""

    def __init__(self, table: pa.Table, threshold: int, held: pa.Table):
        self.several = np.sort(unpacked(table, "names"))
        context, doc = [unpacked(table, "seen")], [unpacked(table, "docs", np.int64)]
        self.samples = []
        for ids, buf, offs in texts(held):
            s = Samples(buf, offs, threshold)
            self.samples.append((ids, buf, offs, s, s.contexts()))
            context.append(self.samples[-1][4])
            doc.append(ids[s.doc])
        self.contexts, self.docs = least(np.concatenate(context), np.concatenate(doc))

    def decide(self, ids: np.ndarray, s: Samples, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which samples are repeats as they are, and which are undecided."""
        repeat = self.docs[np.searchsorted(self.contexts, context)] < ids[s.doc]
        return repeat, ~repeat & find(self.several, s.name)[0]


def _strings(threshold: int, buckets: int):
    def run(held: pa.Table, ranked: pa.Table) -> pa.Table:
        name, doc = [EMPTY], [np.zeros(0, np.int64)]
        if len(held) and len(ranked):
            found = Ranked(ranked, threshold, held)
            for ids, _, offs, s, context in found.samples:
                at, names = s.strings(found.decide(ids, s, context)[1])
                own = least(names, ids[np.searchsorted(offs, at, "right") - 1])
                name.append(own[0])
                doc.append(own[1])
        name, doc = least(np.concatenate(name), np.concatenate(doc))
        block = held["block"][0].as_py() if len(held) else 0
        return packed(block, (name % np.uint64(buckets)).astype(np.int64), buckets, names=name, docs=doc)

    return run


def _ranked_strings(table: pa.Table) -> pa.Table:
    name, doc, row = unpacked(table, "names"), unpacked(table, "docs", np.int64), rows_of(table, "names", 8)
    names, docs = least(name, doc)
    first = docs[np.searchsorted(names, name)]
    cut = np.searchsorted(row, np.arange(len(table) + 1))
    out = [(planes(name[a:b][first[a:b] < doc[a:b]]), planes(first[a:b][first[a:b] < doc[a:b]])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table["block"], "names": pa.array([b""] * len(out), pa.binary()), "seen": pa.array([x for x, _ in out], pa.binary()), "docs": pa.array([y for _, y in out], pa.binary())})


def _removed(threshold: int):
    """(doc_id, text, [begin, end) pairs of removed bytes) of a block."""

    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        ranked, late = found.filter(pa.compute.equal(found["late"], 0)), found.filter(pa.compute.equal(found["late"], 1))
        block = Ranked(ranked, threshold, held)
        seen, by = [unpacked(late, "seen")], [unpacked(late, "docs", np.int64)]
        todo = []
        for ids, buf, offs, s, context in block.samples:
            repeat, undecided = block.decide(ids, s, context)
            at, names = s.strings(undecided)
            doc = ids[np.searchsorted(offs, at, "right") - 1]
            todo.append((ids, buf, offs, s, repeat, at, names, doc))
            seen.append(names)
            by.append(doc)
        names_all, docs_all = least(np.concatenate(seen), np.concatenate(by))
        out: list[tuple[int, int, list[int], str]] = []
        for ids, buf, offs, s, repeat, at, names, doc in todo:
            edge = np.zeros(len(buf) + 1, np.int64)
            a, d = s.at[repeat], s.doc[repeat]
            np.add.at(edge, np.maximum(a - s.reach, offs[d]), 1)
            np.add.at(edge, np.minimum(a + threshold, offs[d + 1]), -1)
            hit = at[docs_all[np.searchsorted(names_all, names)] < doc]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + threshold, -1)
            gone = np.cumsum(edge)[:-1] > 0
            for k, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                flags = gone[lo:hi]
                runs = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))) if flags.any() else np.zeros(0, np.int64)
                out.append((int(ids[k]), hi - lo, runs.tolist(), hashlib.sha256(buf[lo:hi][~flags].tobytes()).hexdigest()))
        return pa.table(
            {"doc_id": pa.array([x[0] for x in out], pa.int64()), "n_bytes": pa.array([x[1] for x in out], pa.int64()), "removed": pa.array([x[2] for x in out], pa.list_(pa.int64())), "kept_sha256": pa.array([x[3] for x in out], pa.string())}
        )

    return run


def repeated_bytes(docs: DataFrame, *, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, ``removed`` (begin and end of every removed run, in turn), kept_sha256.

    A byte is removed when a string of ``threshold`` bytes that covers it also starts in a document
    with a smaller id; strings never cross documents. Null texts are empty. Ids are integers; rows
    without one are left out (no document comes before them or after), and rows with the same id
    don't count as earlier than each other.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    blocks, buckets = block_plan(rows)
    rows = in_blocks(rows, blocks)
    held = rows.groupBy("block")
    shared = held.applyInArrow(_sampled_names(threshold, buckets), "bucket int, block int, names binary").groupBy("bucket").applyInArrow(_shared_names, "block int, bucket int, names binary")
    contexts = held.cogroup(shared.groupBy("block")).applyInArrow(_contexts(threshold, buckets), "bucket int, block int, names binary, contexts binary, docs binary")
    ranked = contexts.groupBy("bucket").applyInArrow(_ranked_contexts, "block int, names binary, seen binary, docs binary")
    strings = held.cogroup(ranked.groupBy("block")).applyInArrow(_strings(threshold, buckets), "bucket int, block int, names binary, docs binary")
    last = strings.groupBy("bucket").applyInArrow(_ranked_strings, "block int, names binary, seen binary, docs binary")
    found = ranked.withColumn("late", F.lit(0)).unionByName(last.withColumn("late", F.lit(1)))
    return held.cogroup(found.groupBy("block")).applyInArrow(_removed(threshold), "doc_id bigint, n_bytes bigint, removed array<bigint>, kept_sha256 string")


def report(found: DataFrame) -> DataFrame:
    length = F.aggregate("removed", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("sign")), lambda s, x: F.struct((s.n + s.sign * x).alias("n"), (-s.sign).alias("sign")))
    return found.select("doc_id", "n_bytes", length.n.alias("n_removed"), (F.size("removed") / 2).cast("bigint").alias("n_spans"), "kept_sha256")
