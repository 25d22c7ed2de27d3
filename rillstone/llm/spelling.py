"""Spelling variants by a positional q-gram inverted index with a count filter (operator 13).

Words are the maximal runs of ASCII and Latin-1 letters, ASCII lower-cased, after the deletions that the
contract plants by the checksum of document and word; a task counts a word once a document and adds up before it sends.

Two words one edit apart agree in the first or in the last half of the shorter, so each word is dealt by
its four halves (as the shorter and as the longer of a pair) and a pair meets in a group of one half. A group of over
`limit` words is dealt again by halves of what the words don't have in common, until it is small or one code point
is left, of which only so many exist; no group is a whole hot key, and none is left out. In a group, the
bigrams of the rests, padded, with their positions and the rests' lengths are an inverted index. For each word the
postings of its bigrams at positions at most one away and of equal or next length, each list sorted, are merged
by a heap that skips what can't reach the bound: of the longer's length + 1 padded bigrams one edit spoils two.
What reaches it is verified. Pairs that meet in several groups are counted once.

A word's form is its near word of most occurrences, if those are `ratio` times the word's; forms are followed to
the last by doubling, and since counts grow `ratio` times each step, the number of rounds is known beforehand.

Defined results: null and empty texts have no words; a null id counts as an empty one in the checksum; repeated rows count each;
ties go to the smaller word by code points; further columns are not read; an empty table gives no rows. A run of any
length is a word; a very long text costs its task some tens of bytes for each of its bytes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import cut_out
from .storage import keep, small
from .textkit import _BYTES, blocks, span_hash, spans, tune

_LETTER = (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES == 0xC3)
_ANY = np.array([False, True])
LIMIT = 4096

_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) whose entries, by byte, add up to what `length` zero bytes make of a checksum's bits."""
    if length not in _SHIFTS:
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        _SHIFTS[length] = np.array([[zlib.crc32(zeros, v << 8 * k) ^ none for v in range(256)] for k in range(4)], np.uint32)
    return _SHIFTS[length]


def joined_crc(before: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of two strings one after the other, from theirs and the second's length in bytes (at most 255)."""
    out = own.astype(np.uint32).copy()
    for n in np.unique(length).tolist():
        at = length == n
        table, x = _shift(n), before[at]
        out[at] ^= table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]
    return out


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters in lower-cased UTF-8, and their pointer by text: U+00C0 to U+00FF are 0xC3 and a further byte."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return spans(inside.astype(np.uint8), off, _ANY)


def _counted(modulus: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, data, off in blocks(b.column(1), 1 << 20):
                start, end, ptr = letter_runs(data, off)
                if not len(start):
                    continue
                h = span_hash(data, start, end)
                _, first, which = np.unique(h, return_index=True, return_inverse=True)
                text = np.repeat(np.arange(j - i), np.diff(ptr))
                pair, n = np.unique(text * len(first) + which, return_counts=True)
                row, word = np.divmod(pair, len(first))
                forms = [data[s:e].tobytes() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[i:j]], np.uint32)
                own, size = np.array([zlib.crc32(w) for w in forms], np.uint32), end[first] - start[first]
                crc = np.zeros(len(pair), np.uint32)
                fits = size[word] < 256
                crc[fits] = joined_crc(before[row[fits]], own[word[fits]], size[word[fits]])
                for p in np.flatnonzero(~fits).tolist():
                    crc[p] = zlib.crc32(forms[word[p]], int(before[row[p]]))
                hit = crc % modulus == 0
                changed: Counter = Counter()
                for p in np.flatnonzero(hit).tolist():
                    w = forms[word[p]].decode()
                    at = int(crc[p]) % len(w)
                    if len(w) > shortest:
                        changed[w[:at] + w[at + 1 :]] += int(n[p])
                total = np.bincount(word[~hit], n[~hit], len(first)).astype(np.int64)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                good = np.flatnonzero((total > 0) & (points[end[first]] - points[start[first]] >= shortest))
                yield pa.RecordBatch.from_arrays([cut_out(data, start[first][good], end[first][good]), pa.array(total[good])], ["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed)), pa.array(list(changed.values()), pa.int64())], ["word", "n"])

    return run


def word_counts(docs: DataFrame, least: int = 5, shortest: int = 6, modulus: int = 199) -> DataFrame:
    """(word, n) of `docs` (id, text): words of at least `shortest` code points and `least` occurrences."""
    counted = docs.mapInArrow(_counted(modulus, shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(m: Column, rest: Column, path: Column) -> Column:
    """Of a word's rest, if the shorter of a pair has m code points: its two halves' keys and what is left at each."""
    a = F.floor(m / 2).cast("int")
    b = (m - a).cast("int")
    length = F.length(rest)
    one = F.struct(F.concat(path, F.lit("<"), F.substring(rest, F.lit(1), a)).alias("path"), b.alias("m"), F.substring(rest, a + 1, length).alias("rest"))
    two = F.struct(F.concat(path, F.lit(">"), F.substring(rest, length - b + 1, b)).alias("path"), a.alias("m"), F.substring(rest, F.lit(1), length - b).alias("rest"))
    return F.array(one, two)


def dealt(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(path, m, word, rest, n): each word in the groups of its halves, hot groups dealt again until they are small."""
    length = F.length("word")
    both = F.array(*[F.struct(F.lit(d).alias("d")) for d in (0, 1)])
    rows = words.withColumn("x", F.explode(both)).withColumn("m", (length - F.col("x.d")).cast("int"))
    rows = rows.withColumn("g", F.explode(_halves(F.col("m"), F.col("word"), F.concat(F.col("m").cast("string"), F.lit("|")))))
    rows = keep(rows.select("g.path", "g.m", "word", "g.rest", "n"), "halves")
    out = None
    while True:
        hot = keep(rows.where("m > 1").groupBy("path").count().where(F.col("count") > limit).select("path"), "hot")
        if hot.isEmpty():
            return rows if out is None else out.unionByName(rows)
        cold = rows.join(small(hot), "path", "left_anti")
        out = cold if out is None else out.unionByName(cold)
        again = rows.join(small(hot), "path", "left_semi").withColumn("g", F.explode(_halves(F.col("m"), F.col("rest"), F.col("path"))))
        rows = keep(again.select("g.path", "g.m", "word", "g.rest", "n"), "halves")


def one_edit(s: str, t: str) -> bool:
    """Whether `t`, as long as `s` or one longer, is one edit away."""
    i, n = 0, len(s)
    while i < n and s[i] == t[i]:
        i += 1
    return s != t and (s[i + 1 :] == t[i + 1 :] if len(t) == n else s[i:] == t[i + 1 :])


def reaching(lists: list[list[int]], bound: int) -> Iterator[int]:
    """What stands in at least `bound` of sorted lists (a value counts in each), by a heap that skips ahead."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= bound:
        top, met = heap[0][0], []
        while heap and heap[0][0] == top:
            met.append(heapq.heappop(heap))
        if len(met) >= bound:
            yield top
            for _, k, i in met:
                if i + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][i + 1], k, i + 1))
            continue
        while heap and len(met) < bound - 1:  # these alone can't reach the bound before the next head
            met.append(heapq.heappop(heap))
        if not heap:
            return
        head = heap[0][0]
        for _, k, i in met:
            i = bisect_left(lists[k], head, i)
            if i < len(lists[k]):
                heapq.heappush(heap, (lists[k][i], k, i))


def near_pairs(rests: list[str]) -> Iterator[tuple[int, int]]:
    """Places of distinct rests that are one edit apart, the shorter first."""
    order = sorted(range(len(rests)), key=lambda i: (len(rests[i]), rests[i]))
    index: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    grams = []
    for w, i in enumerate(order):
        padded = "\x00" + rests[i] + "\x01"
        own = [padded[p : p + 2] for p in range(len(padded) - 1)]
        grams.append(own)
        for p, g in enumerate(own):
            index[g, p, len(rests[i])].append(w)
    for w, i in enumerate(order):
        size = len(rests[i])
        for longer in (size, size + 1):
            if longer <= 1:  # the bound is nought: every pair of rests so short is near
                found = (v for v in range(w + 1, len(order)) if len(rests[order[v]]) == longer)
            else:
                lists = [x[bisect_right(x, w) :] for p, g in enumerate(grams[w]) for q in (p - 1, p, p + 1) if (x := index.get((g, q, longer)))]
                found = reaching(lists, longer - 1)
            for v in found:
                if one_edit(rests[i], rests[order[v]]):
                    yield i, order[v]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n), both ways, of groups in the order of their paths."""
    names = ["word", "n", "near", "near_n"]

    def found(group: list[tuple]) -> list[tuple]:
        out = []
        if len(group) > 1:
            for i, j in near_pairs([g[2] for g in group]):
                (_, w, _, n), (_, v, _, k) = group[i], group[j]
                out += [(w, n, v, k), (v, k, w, n)]
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names)

    group, out = [], []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and row[0] != group[0][0]:
                out += found(group)
                group = []
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            group.append(row)
    yield batch(out + found(group))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 5, shortest: int = 6, ratio: int = 5, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    spark = docs.sparkSession
    tune(spark)
    words = keep(word_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), least, shortest), "words")
    groups = dealt(words, limit).select("path", "word", "rest", "n")
    pairs = groups.repartition("path").sortWithinPartitions("path").mapInArrow(_pairs, "word string, n long, near string, near_n long").distinct()
    near = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    good = -F.col("best.k") >= ratio * F.col("n")
    near = near.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n"))
    formed = keep(words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))), "forms")
    most = formed.agg(F.max("n")).first()[0] or least
    steps = max(1, int(math.log(max(most / least, 1)) / math.log(ratio)) + 1)
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = keep(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
