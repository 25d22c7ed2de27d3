"""N-gram Jaccard join and its connected groups (operator 6).

Documents with one set of shingles (equal 63-bit hashes of it) are one class. A class goes
on only if other classes hold `num`/`den` of its shingles. Of those, two that are linked
share one of the first n - ceil(t n) + 1 shingles of each in one order (see `near`), and
hashed bitmaps of the whole sets, about a bit a shingle, bound their overlap from above
before they are candidates.

Within a candidate component the sets are sorted by size and compared tile by tile within
the size band that t allows: bitmaps of both tiles bound each overlap, and only pairs
within the bound, not yet in one group, meet in an exact intersection of sorted arrays.

Defined results: null, empty and wordless texts have no shingles and stay alone, as do
rows with a null id, whose component is null; repeated rows all come back; further
columns are ignored; an empty table gives no rows. A very long text costs its task about
forty bytes a word; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import FEW, Forest, components, few, verified
from .near import Entry, Keyed, Rule, bitmap, candidates, frequent, gathered, live
from .storage import keep, small
from .textkit import SPACED, blocks, mix, released, shingles, tune, words

TILE = 256


def classes(value: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A hash of each set of shingles; that of an empty set means nothing."""
    m = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.concatenate([[np.uint64(0)], np.cumsum(m, dtype=np.uint64)])
    twice = np.concatenate([[np.uint64(0)], np.cumsum(mix(m), dtype=np.uint64)])
    n = np.diff(ptr).astype(np.uint64)
    return mix((total[ptr[1:]] - total[ptr[:-1]]) ^ mix(twice[ptr[1:]] - twice[ptr[:-1]] + n)) >> np.uint64(1)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, off in blocks(column):
        yield i, j, *shingles(words(data, off, SPACED), width)


def linker(num: int, den: int):
    """Joins in a forest the sets (bytes of sorted uint64) of Jaccard similarity num/den or more."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        common = len(np.intersect1d(x, y, assume_unique=True))
        return den * common >= num * (len(x) + len(y) - common)

    def link(bodies: list, sizes: np.ndarray, forest: Forest, loose: np.ndarray | None) -> None:
        order = np.argsort(sizes, kind="stable")
        sets = [np.frombuffer(bodies[i], "<u8") for i in order.tolist()]
        size = sizes[order]
        free = loose[order] if loose is not None else None
        n = len(sets)
        if n <= FEW:
            few(n, lambda i, j: size[i] * den >= size[j] * num and linked(sets[i], sets[j]), order, forest, free)
            return
        starts = list(range(0, n, TILE))

        def rows(a: int, bits: int) -> np.ndarray:
            part = sets[a : a + TILE]
            return bitmap(np.concatenate(part), np.cumsum([0] + [len(x) for x in part]), bits)

        for a in starts:
            root_a = np.array([forest.find(int(x)) for x in order[a : a + TILE]])
            for b in starts:
                if b < a:
                    continue
                if size[min(a + TILE, n) - 1] * den < size[b] * num:  # sizes too far apart, and further on too
                    break
                root_b = np.array([forest.find(int(x)) for x in order[b : b + TILE]])
                open_ = root_a[:, None] != root_b[None, :]
                if a == b:
                    open_ &= np.triu(np.ones((len(root_a), len(root_b)), bool), 1)
                if free is not None:
                    open_ &= free[a : a + TILE, None] | free[None, b : b + TILE]
                sa, sb = size[a : a + TILE, None], size[None, b : b + TILE]
                open_ &= (sa * den >= sb * num) & (sb * den >= sa * num)
                if not open_.any():
                    continue
                bits = max(256, min(16384, 1 << int(2 * size[min(b + TILE, n) - 1]).bit_length()))
                x, y = rows(a, bits), rows(b, bits)
                i, j = np.nonzero(open_)
                for s in range(0, len(i), 1 << 13):
                    p, q = i[s : s + (1 << 13)], j[s : s + (1 << 13)]
                    both = np.bitwise_count(x[p] & y[q]).sum(1, dtype=np.int64)
                    top = np.minimum(size[a + p] - (np.bitwise_count(x[p]).sum(1, dtype=np.int64) - both), size[b + q] - (np.bitwise_count(y[q]).sum(1, dtype=np.int64) - both))
                    can = top * (den + num) >= num * (size[a + p] + size[b + q])
                    for u, v in zip((a + p[can]).tolist(), (b + q[can]).tolist(), strict=True):
                        if forest.find(int(order[u])) == forest.find(int(order[v])):
                            continue
                        if linked(sets[u], sets[v]):
                            forest.join(int(order[u]), int(order[v]))
                root_a = np.array([forest.find(int(z)) for z in order[a : a + TILE]])

    return link


def rule(num: int, den: int) -> Rule:
    """Links of sets of Jaccard similarity num/den or more."""
    need = lambda size: (size * num + den - 1) // den
    fits = lambda a, b: a * den >= b * num
    may = lambda a, b, out_a, out_b: np.minimum(a - out_a, b - out_b) * (num + den) >= num * (a + b)
    return Rule(need, lambda size: size - need(size) + 1, fits, may, 1)


def jaccard_groups(docs: DataFrame, *, width: int = 5, num: int = 75, den: int = 100, bucket_entries: int = 2_000_000, cap: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `docs` (doc_id, text): groups linked by Jaccard >= num/den."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, value, ptr in sets_of(b.column(1), width):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ptr)), pa.array(classes(value, ptr).view(np.int64))], ["doc_id", "n_shingles", "class"])

    rows = keep(docs.mapInArrow(released(describe), "doc_id long, n_shingles long, class long"), "shingle-classes")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    known = keep(real.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"), F.first("n_shingles").alias("n_shingles")).withColumnRenamed("class", "node"), "classes")
    total = real.agg(F.sum("n_shingles")).first()[0] or 0
    texts = docs.where("doc_id is not null")
    law = rule(num, den)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[Keyed]:
        for b in batches:
            for _, _, value, ptr in sets_of(b.column(0), width):
                n = np.diff(ptr)
                yield Keyed(value, n, classes(value, ptr), n)

    found = live(texts.select("text"), spell, law, total=total, n_classes=known.count(), bucket_entries=bucket_entries)
    alive = keep(found.join(known, "node").select("node", F.col("n_shingles").alias("size"), F.col("least").alias("doc_id")), "live")

    # One document stands for each class.
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column(0).to_numpy()
            for i, j, value, ptr in sets_of(b.column(1), width):
                good = np.flatnonzero(classes(value, ptr).view(np.int64) == nodes[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i:j][good]), pa.array(np.diff(ptr)[good]), pa.array([value[ptr[x] : ptr[x + 1]].tobytes() for x in good], pa.binary())], ["node", "size", "body"])

    some = texts.join(small(alive.select("doc_id", "node")), "doc_id").select("node", "text")
    sets = keep(some.mapInArrow(released(build), "node long, size long, body binary"), "sets")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
        for b in batches:
            value, n = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8"), b.column(1).to_numpy()
            yield Entry(Keyed(value, n, b.column(0).to_numpy().view(np.uint64), n), value, value, np.concatenate([[0], np.cumsum(n)]))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered(e.keyed for e in kept(batches)):
            value, n = np.unique(x.key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["value", "n"])

    late = frequent(sets.mapInArrow(released(often), "value long, n long"))
    part = alive.agg(F.sum(F.col("size") * (den - num) / den)).first()[0] or 0
    edges = candidates(sets, kept, law, late, total=int(part), bucket_entries=bucket_entries // 4)
    stand = components(edges).join(alive.select("node", "size"), "node")
    fetch = lambda ids: sets.select("node", "body").join(small(ids), "node")
    groups = keep(verified(stand, fetch, linker(num, den), cap=cap), "groups")
    # Names by class first: a class or a group of many documents joins them as one row.
    first = keep(groups.join(known, "node").groupBy("label").agg(F.min("least").alias("first")), "first")
    moved = groups.join(first, "label").select("node", "first")
    named = keep(known.join(moved, "node", "left").where("m > 1 or first <> least").select(F.col("node").alias("class"), F.coalesce("first", "least").alias("first")), "named")
    own = rows.withColumn("class", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class")))
    return own.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
