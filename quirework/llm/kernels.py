"""Byte-level numpy kernels: tokenising, hashing and sliding windows over many texts at once.

Texts are handled as their UTF-8 bytes, many of them in one buffer. Hashes are polynomial in
the bytes modulo 2**64 (so the hash of any slice comes from two prefix sums) and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # bytes of text handled by one round of array operations

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_GRAM_VALUE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


#: Byte classes: what is not in the class separates words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within them) of runs of whole texts of about ``limit`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``member`` bytes that stays in one text, and each text's first word."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = member[buf]
    left = inside[:-2].copy()
    right = inside[2:].copy()
    cuts = offs[1:-1]
    left[cuts[cuts < len(buf)]] = False
    right[cuts[cuts > 0] - 1] = False
    inside = inside[1:-1]
    starts = np.flatnonzero(inside & ~left)
    ends = np.flatnonzero(inside & ~right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``slice_hash`` gets the hash of any slice."""
    up, _ = _power(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` bytes at every position that has as many after it."""
    _, down = _power(len(sums))
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive items, wherever texts end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _GRAM_VALUE[0]
    for j in range(1, size):
        out += hashes[j : j + n] * _GRAM_VALUE[j]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``size`` consecutive values."""
    have, out = 1, x
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out
