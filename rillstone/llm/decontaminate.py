"""Benchmark decontamination by an FM-index of each shard (operator 4).

A shard is a run of whole documents within a partition. Its text is the sequence of
their words over the alphabet of the benchmark's words; any other word is a break, and
so is a run of words shorter than the shortest window, for no window can lie across
either. Over that sequence an FM-index is built: suffix array, Burrows-Wheeler
transform in a wavelet matrix, and every eighth suffix position. All benchmark windows
are searched backwards at once, occurrences are located from the sampled positions, and
their word ranges are merged into removal spans.

The windows of one block of benchmark items are broadcast, about fifty bytes a word. A benchmark of more than
`block_bytes` of text is dealt into as many blocks as keep to that, searched in turn.

Defined results: null or wordless texts and items have no words, spans or items; a null
item_id is dropped from the list of items, its words still count as hit; repeated rows
are all kept; columns pass through and clashing names are replaced; an empty table or
benchmark gives no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, Words, blocks, extended, ragged, released, tune, words

ADDED = ("n_words", "spans", "items")


class BitPlane(NamedTuple):
    word: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bit: np.ndarray) -> BitPlane:
        packed = np.packbits(bit, bitorder="little")
        word = np.zeros(len(bit) // 64 + 1, np.uint64)
        word.view(np.uint8)[: len(packed)] = packed
        count = np.bitwise_count(word).astype(np.int64)
        return cls(word, np.cumsum(count) - count)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.word[k] & mask)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of positive numbers in which zeros are breaks, each its own symbol."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    zero = s == 0
    nz = int(zero.sum())
    rank = s.astype(np.int64) + nz
    rank[zero] = np.arange(nz)  # breaks sort first, by place
    order = np.argsort(rank, kind="stable")
    new = np.ones(n, bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    rank[order] = np.cumsum(new) - 1
    width = 1
    while int(rank.max()) < n - 1:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:] if width < n else after[:0]
        key = rank * np.int64(n + 1) + (after + 1)
        order = np.argsort(key, kind="stable")
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2
    return order


class FMIndex:
    """Backward search and location over a sequence of symbols below `symbols`; 0 is a break and ends it."""

    STEP = 8

    def __init__(self, s: np.ndarray, symbols: int):
        n = self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1] if n else s
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.depth = max(1, int(symbols - 1).bit_length())
        self.planes, self.zeros, cur = [], [], bwt
        for k in range(self.depth - 1, -1, -1):
            bit = ((cur >> k) & 1).astype(bool)
            self.planes.append(BitPlane.of(bit))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        marked = (sa % self.STEP == 0) | (bwt == 0)  # breaks sort by place: no walk may cross one
        self.marked, self.sample = BitPlane.of(marked), sa[marked]

    def _rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each i: down the wavelet planes."""
        low = np.zeros_like(i)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = plane.rank(low), plane.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of `patterns` (all of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns)) if self.n else np.zeros(0, np.int64)
        if not self.n:
            hi[:] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k].astype(np.int64)
            lo[live], hi[live] = self.first[c] + self._rank(c, lo[live]), self.first[c] + self._rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        empty = np.ones(len(patterns), bool)
        empty[live] = False
        hi[empty] = lo[empty]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in `rows`: back through the transform to a sampled one."""
        at, out, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.marked.bit(here) == 1
            out[todo[done]] = self.sample[self.marked.rank(here[done])] + steps
            todo, here = todo[~done], here[~done]
            symbol = np.zeros(len(todo), np.int64)
            i = here
            for plane, zeros in zip(self.planes, self.zeros, strict=True):
                bit = plane.bit(i).astype(np.int64)
                ones = plane.rank(i)
                symbol = symbol << 1 | bit
                i = np.where(bit == 1, zeros + ones, i - ones)
            at[todo] = self.first[symbol] + self._rank(symbol, here)
            steps += 1
        return out


class Phrases(NamedTuple):
    """Distinct windows of a block of items."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    windows: list[np.ndarray]  # one matrix of symbols a window length
    owners: list[tuple[np.ndarray, np.ndarray]]  # for each matrix: items of its windows, by pointer
    items: list[str | None]
    shortest: int

    @classmethod
    def of(cls, items: list[str | None], texts: list[str | None], width: int) -> Phrases:
        """Windows as sorted rows of numbers, without a Python object a window."""
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, off in blocks(pa.array(texts, pa.string())):
            x = words(data, off, ALNUM)
            hashes.append(x.hash)
            counts.append(np.diff(x.ptr))
        vocabulary, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        symbol, n = (symbol + 1).astype(np.int32), np.concatenate(counts)
        first, size = np.cumsum(n) - n, np.minimum(n, width)
        windows, owners = [], []
        lengths = [int(k) for k in np.unique(size) if k]
        for k in lengths:
            own = np.flatnonzero(size == k)
            count = n[own] - k + 1
            at, who = ragged(first[own], count), np.repeat(own, count)
            rows = symbol[at[:, None] + np.arange(k)]
            order = np.lexsort((who, *rows.T[::-1]))
            rows, who = rows[order], who[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(1)
            once = new.copy()
            once[1:] |= who[1:] != who[:-1]  # a window that an item repeats has it once
            windows.append(rows[new])
            owners.append((np.concatenate([[0], np.cumsum(np.bincount(np.cumsum(new)[once] - 1, minlength=int(new.sum())))]), who[once]))
        return cls(vocabulary, windows, owners, items, min(lengths, default=width))


def find(shard: list[Words], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans (start, end over the shard's words) and pairs (word of the document's occurrence, item)."""
    h = np.concatenate([x.hash for x in shard])
    sizes = np.concatenate([np.diff(x.ptr) for x in shard])
    none = np.zeros(0, np.int64)
    if not len(h) or not len(phrases.vocabulary):
        return none, none, none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[at] == h, at + 1, 0)
    # Runs of benchmark words within a document, at least as long as the shortest window.
    known = symbol > 0
    begin = np.zeros(len(h), bool)
    ends = np.cumsum(sizes)
    begin[(ends - sizes)[sizes > 0]] = True
    open_ = known & (begin | ~np.concatenate([[False], known[:-1]]))
    start = np.flatnonzero(open_)
    close = known & (np.concatenate([begin[1:], [True]]) | ~np.concatenate([known[1:], [False]]))
    length = np.flatnonzero(close) + 1 - start
    keep = length >= phrases.shortest
    start, length = start[keep], length[keep]
    if not len(start):
        return none, none, none, none
    origin = ragged(start, length + 1)  # each run and a break after it
    breaks = np.cumsum(length + 1) - 1
    sequence = symbol[np.minimum(origin, len(h) - 1)]
    sequence[breaks] = 0
    index = FMIndex(sequence, len(phrases.vocabulary) + 1)
    cover = np.zeros(len(h) + 1, np.int64)
    places, owners = [], []
    for patterns, (ptr, items) in zip(phrases.windows, phrases.owners, strict=True):
        lo, hi = index.search(patterns)
        n = hi - lo
        hit = np.flatnonzero(n)
        where = origin[index.locate(ragged(lo[hit], n[hit]))]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + patterns.shape[1], -1)
        which = np.repeat(hit, n[hit])
        count = ptr[which + 1] - ptr[which]
        places.append(np.repeat(where, count))
        owners.append(items[ragged(ptr[which], count)])
    covered = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    # A span ends where its document does.
    s, e = edge[0::2], edge[1::2]
    cut = np.flatnonzero(begin & covered & np.concatenate([[False], covered[:-1]]))
    return np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut])), np.concatenate(places), np.concatenate(owners)


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, shard_words: int = 500_000, block_bytes: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` and, `prefix` before each name, n_words, spans (array of [start, end) in words, merged) and items (sorted, whose windows occur).

    Map-only: each document is read once a benchmark block and nothing is shuffled.
    Memory a task: the index of one shard, or of one document longer than a shard.
    """
    spark = docs.sparkSession
    tune(spark)
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("body"))
    total = bench.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    passes = -(-total // block_bytes) or 1
    added = [prefix + c for c in ADDED]
    docs = docs.drop(*added)
    names = docs.columns
    at = names.index(text_col)
    out = docs
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = extended(docs.schema, f"`{added[0]}` bigint, `{added[1]}` array<struct<start:bigint,end:bigint>>, `{added[2]}` array<string>")
    for k in range(passes):
        own = bench if passes == 1 else bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == k)
        rows = own.collect()  # at most about block_bytes of text
        phrases = spark.sparkContext.broadcast(Phrases.of([r["item"] for r in rows], [r["body"] for r in rows], width))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, later=k > 0) -> Iterator[pa.RecordBatch]:
            p: Phrases = phrases.value

            def finish(shard: list[Words], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
                s, e, place, owner = find(shard, p)
                sizes = np.concatenate([np.diff(x.ptr) for x in shard])
                first = np.cumsum(sizes) - sizes
                n = len(sizes)
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                real = np.flatnonzero(sizes > 0)
                doc = lambda x: real[np.searchsorted(first[real], x, side="right") - 1]
                for d, a, b in zip(doc(s).tolist(), s.tolist(), e.tolist(), strict=True):
                    spans[d].append((a - int(first[d]), b - int(first[d])))
                if len(place):
                    pairs = np.unique(np.stack([doc(place), owner], 1), axis=0)
                    for d, i in pairs.tolist():
                        if p.items[i] is not None:
                            items[d].add(p.items[i])
                table = pa.Table.from_batches(parts).combine_chunks()
                if later:
                    spans = [_merge(a, [(x["start"], x["end"]) for x in b]) for a, b in zip(spans, table[added[1]].to_pylist(), strict=True)]
                    items = [a | set(b) for a, b in zip(items, table[added[2]].to_pylist(), strict=True)]
                    table = table.drop_columns(added)
                columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
                new = [pa.array(sizes, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([*columns, *new], [*names, *added])

            shard: list[Words] = []
            parts: list[pa.RecordBatch] = []
            held = 0
            for b in batches:
                for i, j, data, off in blocks(b.column(at)):
                    w = words(data, off, ALNUM)
                    shard.append(Words(w.start[:0], w.end[:0], w.ptr, w.hash))
                    parts.append(b.slice(i, j - i))
                    held += len(w.hash)
                    if held >= shard_words:
                        yield finish(shard, parts)
                        shard, parts, held = [], [], 0
            if shard:
                yield finish(shard, parts)

        out = out.mapInArrow(released(run), schema)
    return out


def contamination(marked: DataFrame, prefix: str = "") -> DataFrame:
    """The contract's columns from what :func:`decontaminate` adds."""
    spans, items, words = (F.col(prefix + c) for c in ("spans", "items", "n_words"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    found = {"n_hit": n_hit, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256), "contaminated": (n_hit > 0) & (n_hit * 20 >= words)}
    return marked.withColumns({prefix + k: v for k, v in found.items()})
