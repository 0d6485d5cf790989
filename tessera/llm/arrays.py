"""Vectorised work on the texts of an Arrow batch: words, rolling hashes and sorted-set helpers.

All hashes are functions of content alone, so executors agree on them without talking to each other.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in runs of about this many bytes, so that temporary arrays stay small.
RUN_BYTES = 1 << 19
#: Byte ranges above this length have a hash of their own kind.
LONG = 64
BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random number for each byte; the second folds A-Z to a-z first.
BYTE = _rng.integers(1, 2**63, 256).astype(U64)
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give freed memory back to the system, so that a worker that is used again does not hold its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base in _powers and n <= len(_powers[base]):
        return _powers[base][:n]
    p = np.full(max(n, RUN_BYTES + 1024), base, U64)
    p[0] = 1
    p = np.cumprod(p)
    if len(p) == RUN_BYTES + 1024:  # those of longer texts are not kept
        _powers[base] = p
    return p[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] == base ** s * (hash of values[s:e])."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def text_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, folded: bool = False) -> np.ndarray:
    """The hash of each byte range; ``folded`` takes A-Z as a-z.

    Sums of powers modulo 2 ** 64 cancel out in certain strings of many hundred bytes, whatever the base, so ranges
    of more than LONG bytes are hashed by BLAKE2.
    """
    out = span_hash(prefix_hash((BYTE_FOLDED if folded else BYTE)[raw]), start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        part = raw[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(part.lower() if folded else part, digest_size=8).digest(), "little")
    return out


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends). Null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about RUN_BYTES of text each; a longer text has a slice to itself."""
    _, at = texts_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + RUN_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words (runs of anything but ASCII white space) of some texts, in order.

    start, end: byte range of each word; doc: its text; first: index of each text's first word (and the end).
    """

    def __init__(self, column: pa.Array) -> None:
        self.raw, self.at = texts_of(column)
        n = len(self.raw)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~IS_SPACE[self.raw]
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1] if n else begins[1:]
        edges = self.at[:-1][self.at[:-1] < self.at[1:]]  # texts follow each other without a space
        begins[edges] = inside[edges]
        ends = inside[:n] & ~inside[1:]
        last = self.at[1:][self.at[:-1] < self.at[1:]] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def hashes(self, folded: bool = False) -> np.ndarray:
        return mix(text_hashes(self.raw, self.start, self.end, folded) ^ U64(0x5851F42D4C957F2D))

    def bytes_of(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def run_hashes(names: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` neighbours (len - k + 1 of them)."""
    if len(names) < k:
        return np.zeros(0, U64)
    prefix = prefix_hash(names)
    start = np.arange(len(names) - k + 1)
    return mix(span_hash(prefix, start, start + k) + U64(k))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and for each place whether a new group begins there. The last key sorts first."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    same = keys[-1][order][1:] == keys[-1][order][:-1]
    new[1:] = ~same
    return order, new


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges [lo, hi), as ranges that neither overlap nor touch."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    ends = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
    return lo[new], reach[ends]
