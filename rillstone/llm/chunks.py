"""Encoding of texts by chunks that begin at a space, each distinct chunk encoded once.

Sub-word encoders split a text at spaces before anything else, so its ids are those
of its chunks in turn. A bounded cache maps a chunk to its ids; a batch of texts then
costs one dictionary look-up a word and one ragged gather.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from .textkit import ragged


class ChunkCache:
    """`encode` gives the ids of each of a list of chunks. Beyond `limit` chunks those met once go, then all."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        kept = [(c, i) for c, i in self.index.items() if self.met[i] > 1]
        if len(kept) > self.limit // 2:
            return self.clear()
        at = np.fromiter((i for _, i in kept), np.int64, len(kept))
        count = self.count[at]
        flat = self.flat[ragged(self.start[at], count)]
        self.clear()
        self.flat, self.used, self.count, self.met = np.concatenate([flat, np.zeros(1 << 16, np.int32)]), len(flat), count, np.ones(len(kept), np.int64)
        self.start = np.cumsum(count) - count
        self.index = {c: k for k, (c, _) in enumerate(kept)}

    def _add(self, new: list[str]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = self.encode(part)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.index) + len(part) > len(self.start):
                self.start, self.count, self.met = (np.concatenate([x, np.zeros(len(x) + 1024, np.int64)]) for x in (self.start, self.count, self.met))
            k = len(self.index)
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[k : k + len(part)] = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.count[k : k + len(part)] = n
            self.met[k : k + len(part)] = 1
            self.used += len(flat)
            self.index.update(zip(part, range(k, k + len(part)), strict=True))

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each chunk has."""
        if len(self.index) > self.limit:
            self._shrink()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = 2
        if len(missing):
            gone = [chunks[i] for i in missing.tolist()]
            self._add(list(dict.fromkeys(gone)))
            at[missing] = np.fromiter(map(self.index.__getitem__, gone), np.int64, len(gone))
        count = self.count[at]
        return self.flat[ragged(self.start[at], count)], count


_TAIL = np.zeros(16, np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
SHORT = 15  # bytes of a chunk, without its space, that are their own key


class WordCache:
    """As :class:`ChunkCache`, over bytes: chunks of up to SHORT bytes are found by their bytes in an open hash table.

    `encode` gives the ids of each of a list of chunks (a chunk that begins at a space has it).
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.bits = int(2 * limit).bit_length()
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.flat, self.used, self.n = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, bool)
        self.own = np.zeros((1 << 14, 2), np.uint64)  # each place's key, zeros for a long chunk

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(low), -1, np.int32)
        slot, todo = self._slots(low, high), np.arange(len(low))
        while len(todo):
            at = slot[todo]
            p = self.place[at]
            same = (self.low[at] == low[todo]) & (self.high[at] == high[todo]) & (p >= 0)
            out[todo[same]] = p[same]
            on = ~same & (p >= 0)
            todo = todo[on]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        slot, todo = self._slots(low, high), np.arange(len(low))
        while len(todo):
            at = slot[todo]
            free = np.flatnonzero(self.place[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]  # one key a slot
            put, at = todo[free], at[free]
            self.low[at], self.high[at], self.place[at] = low[put], high[put], place[put]
            rest = np.ones(len(todo), bool)
            rest[free] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Places of new chunks, encoded."""
        begin = self.n
        for i in range(0, len(chunks), 20_000):
            ids = self.encode(chunks[i : i + 20_000])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.n + len(ids) > len(self.start):
                self.start, self.count, self.met, self.own = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.met, self.own))
            to = slice(self.n, self.n + len(ids))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[to], self.count[to], self.met[to], self.own[to] = self.used + np.cumsum(n) - n, n, False, 0
            self.used += len(flat)
            self.n += len(ids)
        return np.arange(begin, self.n, dtype=np.int32)

    def _shrink(self) -> None:
        """Short chunks met in more than one call stay, if they are half the limit at most."""
        kept = np.flatnonzero(self.met[: self.n] & (self.own[: self.n, 1] > 0))
        if len(kept) > self.limit // 2:
            return self.clear()
        count, own = self.count[kept], self.own[kept]
        flat = self.flat[ragged(self.start[kept], count)]
        self.clear()
        more = np.zeros(len(kept) + (1 << 14), np.int64)
        self.flat, self.used, self.n = np.concatenate([flat, np.zeros(1 << 16, np.int32)]), len(flat), len(kept)
        self.start, self.count, self.met, self.own = more.copy(), more.copy(), np.zeros(len(more), bool), np.zeros((len(more), 2), np.uint64)
        self.start[: self.n], self.count[: self.n], self.own[: self.n] = np.cumsum(count) - count, count, own
        self._insert(own[:, 0].copy(), own[:, 1].copy(), np.arange(self.n, dtype=np.int32))

    def ids(self, data: np.ndarray, off: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has; texts marked `whole` are one chunk."""
        if self.n > self.limit:
            self._shrink()
        size = np.diff(off)
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1][size > 0]] = True
        space = data == 32
        if whole.any():
            space &= ~np.repeat(whole, size)
        at = np.flatnonzero(space | first[:-1])
        end = np.append(at[1:], len(data))
        spaced = space[at]
        begin = at + spaced
        n = end - begin
        padded = np.concatenate([data, _TAIL])
        word = np.ndarray((len(data) + 9,), "<u8", padded.tobytes(), strides=(1,))
        short = n <= SHORT
        low = word[begin] & _MASK[np.minimum(n, 8)]
        high = (word[begin + np.minimum(n, 8)] & _MASK[np.clip(n - 8, 0, 8)]) | (n + 1 + 128 * ~spaced).astype(np.uint64) << np.uint64(56)
        place = np.full(len(at), -1, np.int32)
        place[short] = self._find(low[short], high[short])
        self.met[place[place >= 0]] = True
        raw = padded.tobytes()
        text = lambda i: (" " if spaced[i] else "") + raw[begin[i] : end[i]].decode()
        new = np.flatnonzero(short & (place < 0))
        if len(new):
            order = np.lexsort((low[new], high[new]))
            new = new[order]
            head = np.ones(len(new), bool)
            head[1:] = (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]])
            lead = new[head]
            got = self._add([text(i) for i in lead.tolist()])
            self.own[got, 0], self.own[got, 1] = low[lead], high[lead]
            self._insert(low[lead], high[lead], got)
            place[new] = got[np.cumsum(head) - 1]
        rest = np.flatnonzero(~short).tolist()
        if rest:
            keys = [raw[at[i] : end[i]] if spaced[i] else b"\0" + raw[begin[i] : end[i]] for i in rest]
            gone = {k: i for i, k in zip(rest, keys, strict=True) if k not in self.long}
            if gone:
                self.long.update(zip(gone, self._add([text(i) for i in gone.values()]).tolist(), strict=True))
            place[rest] = [self.long[k] for k in keys]
        count = self.count[place]
        ids = self.flat[ragged(self.start[place], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(ends[np.searchsorted(at, off)])
