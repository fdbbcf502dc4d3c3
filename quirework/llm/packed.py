"""Exchanging packed arrays: (hash bucket, block of documents) rows whose columns are raw numbers.

Blocks hold whole texts, dealt by a hash of the id; buckets hold names (64-bit hashes). What many
small rows would say travels as a few arrays, and each side handles its arrays with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, spans

EMPTY = np.zeros(0, np.uint64)


def least(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, with its smallest document."""
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
    return name[new], doc[new]


def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in the sorted table, and where."""
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return (table[at] == x if len(table) else np.zeros(len(x), bool)), at


def texts(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = table["doc_id"].to_numpy()
    for i, j, buf, offs in chunks(*spans(table["text"])):
        yield ids[i:j], buf, offs


def planes(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: the upper ones are mostly alike, so the shuffle compresses them."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def packed(block: int, bucket: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.Table:
    """One row for each bucket in use, its columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    used, begin = np.unique(bucket, return_index=True)
    end = np.append(begin[1:], len(bucket))[: len(used)]
    out = {"bucket": pa.array(used, pa.int32()), "block": pa.array(np.full(len(used), block), pa.int32())}
    for name, values in columns.items():
        values = values[order]
        out[name] = pa.array([planes(values[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
    return pa.table(out)


def unpacked(table: pa.Table, name: str, dtype: type = np.uint64) -> np.ndarray:
    got = table[name].to_pylist()
    return np.concatenate([from_planes(x, dtype) for x in got]) if got else np.zeros(0, dtype)


def rows_of(table: pa.Table, name: str, width: int) -> np.ndarray:
    """The row that each entry of a packed column came from."""
    return np.repeat(np.arange(len(table)), [len(x) // width for x in table[name].to_pylist()])


def block_plan(texts: DataFrame, least_buckets: int = 128) -> tuple[int, int]:
    """How many blocks and buckets: both grow with the bytes of text, so a task's share doesn't."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = min(64 << 20, max(2 << 20, total // 4096))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, total // block_bytes), max(least_buckets, total // (16 * block_bytes))


def in_blocks(texts: DataFrame, blocks: int) -> DataFrame:
    return texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
