"""N-gram Jaccard join of documents, with signature trees.

A document is the set of its word shingles. All pairs whose Jaccard similarity reaches the
threshold are found exactly, and only verified links connect documents:

1. Counts. Each block of documents asks, by hash bucket, in how many sets each of its shingles is. A
   linked set has at least the threshold's share of its shingles in others: all other sets leave here.
2. Neighbourhoods. Under the order of all shingles from the rarest on, two linked sets share one of
   their first n - ceil(t * n) + 1. Sets with such a shingle in common meet at the smallest of them:
   its neighbourhood holds all their pairs. Copies of one set stand aside, linked to their first. So
   passages that many documents share come last and rarely bring anybody together, and nobody meets
   over a chain of others.
3. Trees. The sets of a neighbourhood meet in one task, or, where they are more than ``grid_docs`` or
   ``GRID_SHINGLES``, in one task for each pair of its blocks. Each block is a signature tree: leaves
   hold bitmaps of shingles, nodes the OR of their children's and the range of their sizes. A dual
   traversal drops node pairs whose sizes or largest possible overlap rule out a link; the leaf pairs
   left that aren't connected yet are compared exactly.
4. The links of all neighbourhoods give the components (distributed union-find).

Shingles are 64-bit hashes. They travel packed, by hash bucket, as 32 bits beside the bucket: what
then collides can only bring more sets together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .components import components
from .frames import map_texts
from .kernels import LOWER, NOT_SPACE, chunks, grams, prefix, slice_hash, spans, words
from .packed import EMPTY, block_plan, in_blocks, packed, planes, rows_of, unpacked

BUCKET_BYTES = 16 << 20
EXACT_BITS = 1 << 15
FANOUT = 8
TILE_BYTES = 16 << 20  # bitmaps compared at once
GRID_SHINGLES = 4 << 20  # shingles of one block of a neighbourhood
LEAF_PAIRS = 4096  # pairs between two looks at what is connected


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, of none is empty."""
    for i, j, buf, local in chunks(data, offs):
        low = LOWER[buf]
        starts, ends, first = words(low, local, NOT_SPACE)
        h = slice_hash(prefix(low), starts, ends)
        g = grams(h, size)
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= size:
                yield np.unique(g[a : b - size + 1])
            else:
                yield grams(h[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64)


class BlockSets:
    """The distinct sets of a block of documents, each with its smallest document, and the copies of them."""

    def __init__(self, table: pa.Table, size: int):
        ids = table["doc_id"].to_numpy()
        sets = list(shingle_sets(*spans(table["text"]), size))
        firsts: dict[bytes, int] = {}
        self.copies: list[tuple[int, int]] = []
        self.docs: list[int] = []
        self.sets: list[np.ndarray] = []
        self.digests: list[int] = []
        for i in np.argsort(ids, kind="stable").tolist():
            if len(sets[i]):
                digest = hashlib.blake2b(sets[i], digest_size=16).digest()
                first = firsts.setdefault(digest, i)
                if first == i:
                    self.docs.append(int(ids[i]))
                    self.sets.append(sets[i])
                    self.digests.append(int.from_bytes(digest[:8], "little"))
                elif ids[first] != ids[i]:
                    self.copies.append((int(ids[i]), int(ids[first])))
        flat = np.concatenate([EMPTY, *self.sets])
        self.names, self.inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.times = np.minimum(counts, 2)  # a shingle of several sets is sent twice
        self.cuts = np.cumsum([0, *map(len, self.sets)])

    def sent(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        names = np.repeat(self.names, self.times)
        return names, _bucket(names, buckets)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _upper(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(32)).astype(np.uint32)


def _asked(size: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        names, bucket = BlockSets(table, size).sent(buckets)
        return packed(table["block"][0].as_py(), bucket, buckets, names=_upper(names))

    return run


def _counted(table: pa.Table) -> pa.Table:
    """In how many sets each shingle is (255 for more), in the order in which each block asked."""
    name, row = unpacked(table, "names", np.uint32), rows_of(table, "names", 4)
    _, inverse, times = np.unique(name, return_inverse=True, return_counts=True)
    times = np.minimum(times, 255).astype(np.uint8)[inverse]
    cut = np.searchsorted(row, np.arange(len(table) + 1))
    return pa.table({"block": table["block"], "bucket": table["bucket"], "counts": pa.array([planes(times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def first_shingles(n: int, percent: int) -> int:
    """How many of the rarest shingles of a set of n must hold one of any linked set's rarest."""
    return n + percent * n // -100 + 1


def _posted(size: int, percent: int, buckets: int):
    """Rows of the rarest shingles of the sets that may have a link; in bucket -1 the copies within the block."""

    def run(held: pa.Table, counted: pa.Table) -> pa.Table:
        names, docs, sizes, digests, copies = [EMPTY], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [EMPTY], []
        if len(held) and len(counted):
            block = BlockSets(held, size)
            copies = block.copies
            sent, bucket = block.sent(buckets)
            times = np.zeros(len(sent), np.uint8)
            times[np.argsort(bucket, kind="stable")] = unpacked(counted.sort_by("bucket"), "counts", np.uint8)
            times = times[np.cumsum(block.times) - 1][block.inverse]
            for doc, s, digest, a, b in zip(block.docs, block.sets, block.digests, block.cuts[:-1].tolist(), block.cuts[1:].tolist(), strict=True):
                known = times[a:b]
                if 100 * int((known > 1).sum()) < percent * len(s):
                    continue
                rarest = np.lexsort((s, known))[: first_shingles(len(s), percent)]
                rarest = rarest[known[rarest] > 1]
                names.append(s[rarest])
                docs.append(np.full(len(rarest), doc))
                sizes.append(np.full(len(rarest), len(s), np.int32))
                digests.append(np.full(len(rarest), digest, np.uint64))
        name, number = np.concatenate(names), held["block"][0].as_py() if len(held) else 0
        out = packed(number, _bucket(name, buckets), buckets, names=_upper(name), docs=np.concatenate(docs), sizes=np.concatenate(sizes), digests=np.concatenate(digests))
        if copies:
            pair = np.array(copies, np.int64)
            own = {"names": pair[:, 0], "docs": pair[:, 1], "sizes": np.zeros(0, np.int32), "digests": EMPTY}
            out = pa.concat_tables([out, pa.table({"bucket": pa.array([-1], pa.int32()), "block": pa.array([number], pa.int32()), **{k: pa.array([planes(v)], pa.binary()) for k, v in own.items()}})])
        return out.drop_columns("block")

    return run


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield pa.RecordBatch.from_arrays([pa.array(unpacked(table, c, np.int64)) for c in ("names", "docs")], ["a", "b"])


def _neighbours(table: pa.Table) -> pa.Table:
    """(a, b, n, same): a set's document, the smallest one with a rarest shingle in common, the set's size; or a copy and its first."""
    name, doc = unpacked(table, "names", np.uint32), unpacked(table, "docs", np.int64)
    size, digest = unpacked(table, "sizes", np.int32), unpacked(table, "digests")
    order = np.lexsort((doc, digest, name))
    name, doc, size, digest = (x[order] for x in (name, doc, size, digest))
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (digest[1:] != digest[:-1])]) if len(name) else np.zeros(0, bool)
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(name) else doc
    copy = np.stack([doc, first], 1)[doc != first]
    name, doc, size = name[new], doc[new], size[new]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(name))))
    least = np.minimum.reduceat(doc, begin)[group] if len(name) else doc
    several = np.bincount(group, minlength=len(begin))[group] > 1
    near = np.unique(np.stack([doc, least, size], 1)[several], axis=0)
    copy = np.unique(copy, axis=0)
    return pa.table(
        {
            "a": np.concatenate([near[:, 0], copy[:, 0]]),
            "b": np.concatenate([near[:, 1], copy[:, 1]]),
            "n": np.concatenate([near[:, 2], np.zeros(len(copy), np.int64)]),
            "same": np.arange(len(near) + len(copy)) >= len(near),
        }
    )


class Tree:
    """Bitmaps and sizes by level, root last; the children of node k are k * FANOUT and on."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        counts = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, sizes - counts)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, other: Tree, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link, by sizes and by the largest possible overlap."""
        bits, low, high, extra = self.levels[level]
        bits2, low2, high2, extra2 = other.levels[level]
        ok = (high[a] * 100 >= low2[b] * percent) & (high2[b] * 100 >= low[a] * percent)
        a, b, kept = a[ok], b[ok], np.flatnonzero(ok)
        overlap = np.bitwise_count(bits[a] & bits2[b]).sum(1) + np.minimum(extra[a], extra2[b])
        need = (low[a] + low2[b]) * percent
        fine = np.zeros(len(ok), bool)
        fine[kept[overlap * (100 + percent) >= need]] = True
        return fine


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning_links(docs: list[int], sets: list[np.ndarray], percent: int, blocks: tuple[int, int] | None = None, block_of: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked: within ``docs``, or between two blocks of them."""
    distinct: dict[bytes, int] = {}
    links: list[tuple[int, int]] = []
    own: list[int] = []
    for i, s in enumerate(sets):
        first = distinct.setdefault(s.tobytes(), i)
        if first == i:
            own.append(i)
        elif docs[first] != docs[i]:
            links.append((docs[first], docs[i]))
    if len(own) == 1:
        return links
    order = sorted(own, key=lambda i: (int(sets[i][0]), len(sets[i]), docs[i]))  # neighbours share their smallest shingle
    universe = np.unique(np.concatenate([sets[i] for i in order]))
    exact = len(universe) <= EXACT_BITS
    width = -(-min(len(universe), EXACT_BITS) // 64)
    bits = np.zeros((len(order), width), np.uint64)
    for row, i in enumerate(order):
        at = np.searchsorted(universe, sets[i]) if exact else (sets[i] % np.uint64(width * 64)).astype(np.int64)
        np.bitwise_or.at(bits[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    side = block_of[order] if blocks and blocks[0] != blocks[1] else np.zeros(len(order), np.int64)
    groups = [np.flatnonzero(side == x) for x in (blocks if blocks and blocks[0] != blocks[1] else (0,))]
    if any(not len(g) for g in groups):
        return links
    trees = [Tree(bits[g], sizes[g]) for g in groups]
    left, right, same = trees[0], trees[-1], len(trees) == 1
    label = np.arange(len(order))

    def join(x: int, y: int) -> None:
        links.append((docs[order[x]], docs[order[y]]))
        label[label == label[x]] = label[y]

    tile = max(64, TILE_BYTES // (8 * width))

    def meet(level_a: int, level_b: int, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), tile):
            x, y = a[at : at + tile], b[at : at + tile]
            if level_a == level_b:
                fine = left.possible(level_a, x, y, right, percent)
                x, y = x[fine], y[fine]
            if level_a == 0 and level_b == 0:
                x, y = groups[0][x], groups[-1][y]
                for some in range(0, len(x), LEAF_PAIRS):
                    p, q = x[some : some + LEAF_PAIRS], y[some : some + LEAF_PAIRS]
                    apart = label[p] != label[q]
                    for i, k in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                        if label[i] != label[k] and (exact or _linked(sets[order[i]], sets[order[k]], percent)):
                            join(i, k)
                continue
            down_a, down_b = max(level_a - 1, 0), max(level_b - 1, 0)
            x, y = _children(x, level_a, len(left.levels[down_a][0])), _children(y, level_b, len(right.levels[down_b][0]))
            pairs = [np.stack(np.meshgrid(p, q, indexing="ij"), -1).reshape(-1, 2) for p, q in zip(x, y, strict=True)]
            if pairs:
                both = np.concatenate(pairs)
                if same:
                    both = both[both[:, 0] < both[:, 1]] if down_a == 0 else both[both[:, 0] <= both[:, 1]]
                meet(down_a, down_b, both[:, 0], both[:, 1])

    meet(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return links


def _children(nodes: np.ndarray, level: int, n: int) -> list[np.ndarray]:
    return [np.arange(k * FANOUT, min(n, k * FANOUT + FANOUT)) if level else np.array([k]) for k in nodes.tolist()]


def _component_links(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        table = table.sort_by([("comp", "ascending"), ("p", "ascending"), ("q", "ascending"), ("doc_id", "ascending")])
        comp, p, q, block, doc = (table[c].to_numpy() for c in ("comp", "p", "q", "block", "doc_id"))
        change = np.flatnonzero((comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(comp)], strict=True):
            sets = list(shingle_sets(*spans(table["text"].slice(a, b - a)), size))
            some = [i for i, s in enumerate(sets) if len(s)]
            out += spanning_links([int(doc[a + i]) for i in some], [sets[i] for i in some], percent, (int(p[a]), int(q[a])), block[a:b][some])
        edges = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def jaccard_components(
    docs: DataFrame,
    *,
    size: int = 3,
    percent: int = 90,
    id_col: str = "doc_id",
    text_col: str = "text",
    grid_docs: int = 4096,
) -> DataFrame:
    """(doc_id, component_id) of the documents that are linked with another.

    Documents link when 100 * |A n B| >= percent * |A u B|. Ids are integers; rows without an id
    are left out, rows with the same id are one document with the links of each. Null and empty
    texts have no shingles and no links; an empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    blocks, buckets = block_plan(texts)
    held = in_blocks(texts, blocks).groupBy("block")
    counted = held.applyInArrow(_asked(size, buckets), "bucket int, block int, names binary").groupBy("bucket").applyInArrow(_counted, "block int, bucket int, counts binary")
    posted = stored(held.cogroup(counted.groupBy("block")).applyInArrow(_posted(size, percent, buckets), "bucket int, names binary, docs binary, sizes binary, digests binary"))
    met = stored(posted.where("bucket >= 0").groupBy("bucket").applyInArrow(_neighbours, "a bigint, b bigint, n bigint, same boolean").distinct())
    copies = posted.where("bucket < 0").mapInArrow(_copies, "a bigint, b bigint").union(met.where("same").select("a", "b"))
    # neighbourhoods, in blocks where they are large
    near = met.where("NOT same").groupBy("a", "b").agg(F.max("n").alias("n")).select(F.col("a").alias("node"), F.col("b").alias("comp"), "n")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / grid_docs, F.sum("n") / GRID_SHINGLES)).cast("int")
    sizes = near.groupBy("comp").agg(parts.alias("n_blocks")).withColumnRenamed("comp", "c2")
    near = near.join(sizes, F.col("comp") == F.col("c2"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    near = near.select("node", "comp", "n", block.alias("block"), other.alias("other"))
    near = stored(near.select("node", "comp", "n", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")))
    tasks = max(16, (near.agg(F.sum("n")).first()[0] or 0) * 8 // BUCKET_BYTES)
    found = texts.join(near, texts.doc_id == near.node).withColumn("bucket", F.pmod(F.xxhash64("comp", "p", "q"), F.lit(tasks)))
    links = found.select("bucket", "comp", "p", "q", "block", "doc_id", "text").groupBy("bucket").applyInArrow(_component_links(size, percent), "a bigint, b bigint")
    links = stored(links.union(copies))
    out = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    discard(posted, met, near, links)
    return out


def report(docs: DataFrame, *, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (its own id where it has no link)."""

    def count(data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        return {"n_shingles": pa.array(np.fromiter((len(s) for s in shingle_sets(data, offs, size)), np.int64, len(offs) - 1))}

    linked = jaccard_components(docs, size=size, percent=percent).withColumnRenamed("doc_id", "d")
    counted = map_texts(docs, count, "n_shingles bigint")
    return counted.join(linked, F.col("doc_id") == F.col("d"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
