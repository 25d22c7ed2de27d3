"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive in Arrow batches; everything here works on their UTF-8 bytes with
numpy, one block of about half a megabyte at a time, so the cost is a few array passes
per byte and the memory is bounded by the block (or by the longest single text).
Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from inspect import isgeneratorfunction
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

# What a batch frees goes back to the system: several workers share an executor's memory.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(_LIBC := ctypes.CDLL(None), "mallopt"):  # glibc: keep at most 16 MB of free heap, map arrays over 8 MB
    _LIBC.mallopt(-3, 8 << 20)
    _LIBC.mallopt(-1, 16 << 20)

_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words between ASCII white space.
SPACED = ~_SPACE
#: Words of digits, a-z and every byte of a non-ASCII character.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("q", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs only give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    start: np.ndarray  # byte offset in the block
    end: np.ndarray
    ptr: np.ndarray  # words of text i: ptr[i]:ptr[i + 1]
    hash: np.ndarray  # uint64


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, lower-cased bytes, offsets): runs of whole texts of about `size` bytes."""
    data, off = raw(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, _LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `inside` bytes that don't cross texts, and the runs' pointer by text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = m[1:] != m[:-1]
    edge[0], edge[-1] = m[0], m[-1]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    cut = np.flatnonzero(first[1:] & m[1:] & m[:-1]) + 1  # a run that would go on over a border
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, independent of where it stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * q[start])


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> Words:
    start, end, ptr = spans(data, off, inside)
    return Words(start, end, ptr, span_hash(data, start, end))


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes; order matters."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _P + np.uint64(k + 1)
    return mix(out)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... for count[0] of them, then those of start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return shift + np.arange(total)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and their pointer.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    n = np.diff(w.ptr)
    full = window_hash(w.hash, width)
    count = np.maximum(n - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    value = full[ragged(w.ptr[:-1], count)] if len(full) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        own = []
        for i in short:
            h = int(n[i])
            for x in w.hash[w.ptr[i] : w.ptr[i + 1]].tolist():
                h = ((h ^ x) * int(_P) + 0x5151) % (1 << 64)
            own.append(h)
        value = np.concatenate([value, mix(np.array(own, np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc)) if len(short) else None
    if order is None:  # documents stand in order: sort within each
        value = value.copy()
        ptr = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
            if b - a > 1:
                value[a:b].sort()
    else:
        value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    if len(value) > 1:
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def tune(spark) -> None:
    """Small Arrow batches, so that a Python worker's memory is bounded by bytes rather than by rows; smaller within :func:`lean`."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str((2 if _LEAN[0] else 8) << 20))


#: What frees the models that a module keeps in a Python worker between tasks, by module.
KEPT: dict[str, Callable[[], None]] = {}
_LEAN = [False]


@contextmanager
def lean() -> Iterator[None]:
    """Plans made within leave nothing in Python workers that wait for another task.

    For operators that run one after another in one application: their workers stay alive,
    and what each keeps would add up with what the next one needs.
    """
    before, _LEAN[0] = _LEAN[0], True
    try:
        yield
    finally:
        _LEAN[0] = before


def make_room(module: str) -> None:
    """Frees what other modules than `module` keep in this process."""
    for name, clear in KEPT.items():
        if name != module:
            clear()


def give_back() -> None:
    """Frees the tables of powers, which grow with the longest block, and returns what this process has freed to the system."""
    _POW.clear()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def released(run: Callable) -> Callable:
    """`run`, an Arrow function of batches or of a group; within :func:`lean`, one that makes room before and gives back after."""
    if not _LEAN[0]:
        return run
    module = run.__module__
    if isgeneratorfunction(run):

        def batched(batches):
            make_room(module)
            yield from run(batches)
            give_back()

        return batched

    def grouped(group):
        make_room(module)
        out = run(group)
        give_back()
        return out

    return grouped


def unused(names: list[str], name: str) -> str:
    """`name`, or with underscores before it, that is none of `names` in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = "_" + name
    return name


def extended(schema, ddl: str):
    """A schema and the columns of `ddl` after its own."""
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
