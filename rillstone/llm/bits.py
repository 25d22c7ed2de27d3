"""Bitmaps of hashes, which tasks ask before they shuffle.

Hashes of `WIDTH` bits are counted in ranges of their first bits; a bit is set for what
was counted `least` times or more. What a bitmap lacks was counted less often for sure;
what it has may be another hash's. A bitmap has `each` bits for each hash that is
expected and 2^MOST at most, so it comes through the driver in bounded room whatever the
table; a fuller one rules out less and is never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .textkit import released

WIDTH = 46
MOST = 29
FLUSH = 1_000_000  # hashes counted together in a task
SHARE = 21  # a range has about 2^SHARE hashes


def short(x: np.ndarray) -> np.ndarray:
    """The first bits of 64-bit hashes."""
    return x >> np.uint64(64 - WIDTH)


class Bits(NamedTuple):
    body: np.ndarray  # eight bits a byte, the lowest first
    bits: int

    def has(self, value: np.ndarray) -> np.ndarray:
        at = value >> np.uint64(WIDTH - self.bits)
        return (self.body[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _pack(low: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers and their counts, byte plane by byte plane."""
    raw = np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(n, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(body: pa.Buffer) -> np.ndarray:
    """Numbers of :func:`_pack`, shifted by 16 bits for the counts below."""
    planes = np.frombuffer(pa.decompress(body[8:], int(np.frombuffer(body, "<i8", 1)[0]), codec="zstd"), np.uint8).reshape(6, -1)
    low = np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint64)
    return low << np.uint64(16) | np.ascontiguousarray(planes[4:].T).view("<u2").ravel()


def marked(rows: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], *, total: int, each: int = 16, least: int = 1, over: int = 0) -> tuple[Bits, DataFrame, np.uint64]:
    """The bitmap of hashes, (value, n) of those counted over `over` times if that is not 0, and a mask of the bits that tell these apart.

    `total` is about the number of hashes.
    """
    bits = min(MOST, max(12, (total * each).bit_length()))
    fine = min(WIDTH, max(bits, total.bit_length() + 4))
    n_first = min(bits - 3, max(3, (total >> SHARE).bit_length()), 12)
    n_first = max(n_first, fine - 32)  # what is left of a number has 32 bits
    rest = np.uint64(fine - n_first)
    shift = np.uint64(WIDTH - fine)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
            cut = np.searchsorted(value, np.arange(1 << n_first, dtype=np.uint64) << rest).tolist() + [len(value)]
            low = (value & np.uint64((1 << int(rest)) - 1)).astype("<u4")
            full = [k for k in range(1 << n_first) if cut[k] < cut[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(low[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for k in full], pa.binary())], ["bucket", "body"])

        for x in values(batches):
            held.append(x)
            waiting += len(x)
            if waiting >= FLUSH:
                yield flush()
                held.clear()
                waiting = 0
        if waiting:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        number = group["bucket"][0].as_py()
        code = np.concatenate([_unpack(x.as_buffer()) for c in group["body"].chunks for x in c])
        code.sort()
        low = code >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.add.reduceat((code & np.uint64(0xFFFF)).astype(np.int64), first)
        low = low[first]
        own = np.zeros(1 << (bits - n_first), bool)
        own[low[n >= least] >> np.uint64(fine - bits)] = True
        many = n > over if over else np.zeros(len(n), bool)
        value = (np.uint64(number) << rest | low[many]) << shift
        return pa.table({"bucket": pa.array([number], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary()), "often": pa.array([value.tobytes() + n[many].tobytes()], pa.binary())})

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                value, n = np.frombuffer(body.as_buffer(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["value", "n"])

    found = keep(rows.mapInArrow(released(tell), "bucket int, body binary").groupBy("bucket").applyInArrow(released(count), "bucket int, bits binary, often binary"), "bits")
    body = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - 3 - n_first)
    table = found.select("bucket", "bits").toArrow()  # the bitmap, in ranges
    for k, part in zip(table["bucket"].to_pylist(), (x for c in table["bits"].chunks for x in c), strict=True):
        body[k * size : (k + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    mask = np.uint64((1 << WIDTH) - (1 << int(shift)))
    return Bits(body, bits), found.select("often").mapInArrow(released(listed), "value long, n long"), mask


class Chosen(NamedTuple):
    """A set of hashes: a bitmap of it, and what else meets bits of it among all that is asked for."""

    bits: Bits
    others: np.ndarray  # ascending

    def has(self, value: np.ndarray) -> np.ndarray:
        hit = self.bits.has(short(value))
        if len(self.others):
            at = np.flatnonzero(hit)
            hit[at] = self.others[np.minimum(np.searchsorted(self.others, value[at]), len(self.others) - 1)] != value[at]
        return hit


def chosen(inside: DataFrame, every: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], *, each: int = 32, most: int = 4_000_000) -> Broadcast | None:
    """Tells the rows `inside` from the others of `every` (of the same columns) by their 64-bit hashes, so that no text need be shuffled to meet them.

    None if more than `most` others meet the bitmap.
    """
    inside = keep(inside, "inside")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield short(hashes(b))

    share = inside.sparkSession.sparkContext.broadcast
    bits = marked(inside, listed, total=inside.count(), each=each)[0]
    given = share(bits)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(given.value.has(short(hashes(b)))))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes(b).view(np.int64))], ["value"])

    others = every.mapInArrow(released(meet), every.schema).join(inside, inside.columns, "left_anti")
    others = keep(others.mapInArrow(released(named), "value long"), "others")
    given.destroy()
    if others.limit(most + 1).count() > most:
        return None
    return share(Chosen(bits, np.sort(others.toArrow()["value"].to_numpy().view(np.uint64))))
