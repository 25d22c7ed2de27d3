"""Candidates for links between near-equal classes, without a row for each pair.

A class is a text (or line) with its keys: hashes of parts of it. Two linked classes have
at least `need` keys of each in common, and at least one among the first `prefix` keys of
each in one order of all keys. The keys are the caller's: shingles, runs of words.

:func:`live` leaves the classes of which others hold `need` keys or more. A task counts
what its own classes share; a key goes on once a task, however many of its classes hold
it, and buckets of keys tell the rest. :func:`candidates` connects those of the remaining
classes that share a prefix key and whose sizes and hashed bitmaps allow a link; keys that
many of them share come last in the order. Each bucket yields a spanning forest, so its
rows never outnumber its classes. In a key of more than `large` classes of a bucket (or
`LOCAL` of a task), neighbours by size connect without a test of their bitmaps. Where a
bitmap of the keys' values that several classes have is given, the others come first in the
order and are not dealt, for nothing meets them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import Bits
from .groups import forest
from .textkit import ragged, released

LARGE = 1024  # classes of a bucket's key up to which all its pairs are tested
LOCAL = 16  # classes of a task's key up to which each is dealt by itself
CHUNK = 600_000  # keys counted together before they are dealt
WIDTHS = (64, 128, 256, 512, 1024, 2048, 4096)  # bits of a bitmap
LOW = np.uint64((1 << 48) - 1)


class Rule(NamedTuple):
    """A link of sizes a <= b: `fits` sizes, and `may` by lower bounds of what either lacks of the other."""

    need: Callable[[np.ndarray], np.ndarray]  # of sizes
    prefix: Callable[[np.ndarray], np.ndarray]
    fits: Callable[[np.ndarray, np.ndarray], np.ndarray]
    may: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    bits: int  # of a bitmap, for each of a size


class Keyed(NamedTuple):
    """Some classes: all keys in turn, how many each has, and each one's class and size."""

    key: np.ndarray
    n: np.ndarray
    cls: np.ndarray
    size: np.ndarray


def bitmap(value: np.ndarray, ptr: np.ndarray, bits: int) -> np.ndarray:
    """One row of `bits` bits for each set: where some member's hash falls."""
    n = len(ptr) - 1
    out = np.zeros((n, bits), bool)
    out[np.repeat(np.arange(n), np.diff(ptr)), (value >> np.uint64(7)) % np.uint64(bits)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def dealt(bucket: np.ndarray, n: int, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    """Rows (bucket, pack(indices)) of the buckets below n that have entries; `bucket` is of each entry."""
    by = np.argsort(bucket.astype(np.uint16) if n < 1 << 16 else bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(n + 1))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([pack(by[cut[k] : cut[k + 1]]) for k in full], pa.binary())], ["bucket", "body"])


def bodies_of(group: pa.Table) -> list[pa.Buffer]:
    return [x.as_buffer() for c in group["body"].chunks for x in c]


def _starts(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def _ends(new: np.ndarray) -> np.ndarray:
    return np.concatenate([new[1:], np.ones(min(len(new), 1), bool)])


def gathered(parts: Iterator[Keyed]) -> Iterator[Keyed]:
    """Distinct classes with keys, together until they have CHUNK keys."""
    held: list[Keyed] = []

    def take() -> Keyed:
        key, n, cls, size = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        first = np.sort(np.unique(cls, return_index=True)[1])
        first = first[n[first] > 0]
        start = np.cumsum(n) - n
        return Keyed(key[ragged(start[first], n[first])], n[first], cls[first], size[first])

    waiting = 0
    for p in parts:
        held.append(p)
        waiting += len(p.key)
        if waiting >= CHUNK:
            yield take()
            waiting = 0
    if held:
        yield take()


def live(rows: DataFrame, spell: Callable[[Iterator[pa.RecordBatch]], Iterator[Keyed]], rule: Rule, *, total: int, n_classes: int, bucket_entries: int) -> DataFrame:
    """(node): the classes of which other classes hold as many keys as a link takes.

    `total` and `n_classes` are about the numbers of keys and classes. Where a class has
    copies in several tasks, more of its keys may be counted, never fewer.
    """
    n_buckets, n_parts = max(8, -(-total // bucket_entries)), max(4, -(-n_classes // 100_000))
    part_of = lambda cls: ((cls & LOW) % np.uint64(n_parts)).astype(np.int64)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered(spell(batches)):
            if not len(x.key):
                continue
            owner = np.repeat(np.arange(len(x.cls)), x.n)
            order = np.argsort(x.key)
            new = _starts(x.key[order])
            alone = new & _ends(new)
            local = np.bincount(owner[order[~alone]], minlength=len(x.cls))
            # A key of several classes here goes on once, for nobody (class 0).
            first = order[new]
            mark = np.where(alone[new], x.cls[owner[first]], np.uint64(0))
            bucket = (x.key[first] % np.uint64(n_buckets)).astype(np.int64)
            key = (x.key[first] // np.uint64(n_buckets)).astype("<u4")

            def pack(at: np.ndarray, mark=mark, key=key) -> bytes:
                c = np.sort(mark[at])
                runs = np.flatnonzero(_starts(c))
                if 2 * len(runs) > len(at):  # few keys of a class meet here: each carries 48 bits of its class
                    c = mark[at] & LOW
                    return np.array([0, len(at)], "<i8").tobytes() + key[at].tobytes() + c.astype("<u4").tobytes() + (c >> np.uint64(32)).astype("<u2").tobytes()
                at = at[np.argsort(mark[at], kind="stable")]
                return np.array([len(runs), len(at)], "<i8").tobytes() + key[at].tobytes() + c[runs].tobytes() + np.diff(np.append(runs, len(at))).astype("<u4").tobytes()

            yield dealt(bucket, n_buckets, pack)
            need = rule.need(x.size)
            own = dealt(part_of(x.cls), n_parts, lambda at, x=x, need=need, local=local: np.int64(len(at)).tobytes() + x.cls[at].tobytes() + need[at].astype("<u4").tobytes() + local[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own.column(0).to_numpy() + np.int32(n_buckets)), own.column(1)], ["bucket", "body"])

    def count(group: pa.Table) -> pa.Table:
        number = group["bucket"][0].as_py()
        if number >= n_buckets:  # what tasks know of their classes passes through
            n = group.num_rows
            return pa.table({"part": pa.array([number - n_buckets] * n, pa.int32()), "own": pa.array([True] * n, pa.bool_()), "body": group["body"]})
        cls, key = [], []
        for raw in bodies_of(group):
            m, k = np.frombuffer(raw, "<i8", 2).tolist()
            key.append(np.frombuffer(raw, "<u4", k, 16))
            at = 16 + 4 * k
            if m:
                cls.append(np.repeat(np.frombuffer(raw, "<u8", m, at) & LOW, np.frombuffer(raw, "<u4", m, at + 8 * m)))
            else:
                cls.append(np.frombuffer(raw, "<u2", k, at + 4 * k).astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, "<u4", k, at))
        cls, key = np.concatenate(cls), np.concatenate(key)
        code = key.astype(np.uint64) << np.uint64(32) | cls & np.uint64(0xFFFFFFFF)
        order = np.argsort(code)
        code, cls = code[order], cls[order]
        # Equal pairs are one; classes that agree in 32 bits alone stay apart.
        once = _starts(code) | _starts(cls)
        cls, new = cls[once], _starts(code[once] >> np.uint64(32))
        cls = cls[~(new & _ends(new)) & (cls > 0)]
        cls, n = np.unique(cls, return_counts=True)
        out = dealt(part_of(cls), n_parts, lambda at: np.int64(len(at)).tobytes() + cls[at].tobytes() + n[at].astype("<u4").tobytes())
        return pa.table({"part": out.column(0), "own": pa.array([False] * out.num_rows, pa.bool_()), "body": out.column(1)})

    def decide(group: pa.Table) -> pa.Table:
        seen, own = [], []
        for mine, raw in zip(group["own"].to_pylist(), bodies_of(group), strict=True):
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            (own if mine else seen).append([np.frombuffer(raw, "<u8", m, 8)] + [np.frombuffer(raw, "<u4", m, 8 + (8 + 4 * k) * m) for k in range(1 + mine)])
        cls, need, n = (np.concatenate(x) for x in zip(*own, strict=True))
        # Copies of a class in several tasks: the least of their counts is enough beside what the buckets found.
        order = np.lexsort((n, cls))
        cls, need, n = cls[order], need[order], n[order].astype(np.int64)
        new = _starts(cls)
        cls, need, n = cls[new], need[new], n[new]
        if seen:
            other, more = (np.concatenate(x) for x in zip(*seen, strict=True))
            other, at = np.unique(other, return_inverse=True)
            more = np.bincount(at, more)
            at = np.minimum(np.searchsorted(other, cls & LOW), len(other) - 1)
            n = n + np.where(other[at] == cls & LOW, more[at], 0)
        return pa.table({"node": cls[n >= need].view(np.int64)})

    told = rows.mapInArrow(released(tell), "bucket int, body binary").groupBy("bucket").applyInArrow(released(count), "part int, own boolean, body binary")
    return told.groupBy("part").applyInArrow(released(decide), "node long")


def frequent(counts: DataFrame, *, least: int = LOCAL, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent values of (value, n) over `least`, sorted, and their grades: four for each doubling."""
    top = counts.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "value").limit(most).toArrow()
    value, n = top["value"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(value)
    return value[by], np.minimum(4 * np.log2(np.maximum(n[by], 2)), 255).astype(np.uint8)


class Entry(NamedTuple):
    """Some classes as :func:`candidates` takes them."""

    keyed: Keyed
    value: np.ndarray  # of each key, by which it may be frequent
    member: np.ndarray  # what the bitmaps hash
    ptr: np.ndarray
    spot: np.ndarray = np.zeros(0, np.int64)  # of each place of a class that has a key: the key's number


SLOTS = 1 << 20


def slots(value: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the values of each range of equal first bits begin in the sorted `value`, and the shift that leaves these bits."""
    shift = max(0, int(value[-1]).bit_length() - SLOTS.bit_length() + 1) if len(value) else 0
    return np.searchsorted(value >> np.uint64(shift), np.arange(SLOTS + 1, dtype=np.uint64)).astype(np.int32), shift


def graded(x: np.ndarray, value: np.ndarray, grade: np.ndarray, begin: np.ndarray, shift: int) -> np.ndarray:
    """The grade of each x, 0 if it is no value: a look at its slot in place of a binary search."""
    out = np.zeros(len(x), np.uint8)
    slot = np.minimum(x >> np.uint64(shift), np.uint64(SLOTS - 1)).astype(np.int64)
    at, end = begin[slot], begin[slot + 1]
    live = np.flatnonzero(at < end)
    at, end, x = at[live], end[live], x[live]
    while len(live):
        found = value[at]
        hit = found == x
        out[live[hit]] = grade[at[hit]]
        on = np.flatnonzero((found < x) & (at + 1 < end))
        live, at, end, x = live[on], at[on] + 1, end[on], x[on]
    return out


def candidates(rows: DataFrame, spell: Callable[[Iterator[pa.RecordBatch]], Iterator[Entry]], rule: Rule, late: tuple[np.ndarray, np.ndarray], *, total: int, bucket_entries: int, repeated: Bits | None = None, large: int | None = None, prefix: Callable[[Entry, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b): edges whose components hold every link among the classes of `rows`.

    `late` has values and their grades (see :func:`frequent`): keys of higher grades come
    later in the order; components hold every link in any order. `repeated` has the values
    that more than one class has, and maybe others. `prefix` tells by the places of keys in
    the order how many of them a class deals, in place of the rule's. `total` is about the
    number of keys that are dealt.
    """
    n_buckets = max(8, -(-total // bucket_entries))
    large, skip = LARGE if large is None else large, repeated is not None
    shared = rows.sparkSession.sparkContext.broadcast(((*late, *slots(late[0])), repeated))

    def grades(x: np.ndarray) -> np.ndarray:
        table, several = shared.value
        grade = graded(x, *table)
        return grade if several is None else np.maximum(grade, several.has(x))

    width_of = lambda size: np.searchsorted(WIDTHS[:-1], size * rule.bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in spell(batches):
            x, value, member, ptr, _ = e
            if not len(x.key):
                continue
            width = width_of(x.size)
            maps: list[np.ndarray] = []
            row = np.zeros(len(width), np.int64)
            for g, w in enumerate(WIDTHS):
                which = np.flatnonzero(width == g)
                row[which] = np.arange(len(which))
                parts = []
                for at in np.array_split(which, max(1, -(-len(which) * w // (8 << 20)))):
                    n = ptr[at + 1] - ptr[at]
                    parts.append(bitmap(member[ragged(ptr[at], n)], np.concatenate([[0], np.cumsum(n)]), w))
                maps.append(np.concatenate(parts))
            who = np.repeat(np.arange(len(x.n), dtype=np.uint64), x.n)
            grade = grades(value)
            code = who << np.uint64(44) | grade.astype(np.uint64) << np.uint64(36) | x.key >> np.uint64(28)
            order = np.argsort(code)
            if len(x.n) >= 1 << 20 or not _starts(code[order]).all():  # the whole key decides
                order = np.lexsort((x.key, grade, who))
            start = np.cumsum(x.n) - x.n
            if prefix is None:
                n_first = np.minimum(rule.prefix(x.size), x.n)
            else:
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(start, x.n)
                n_first = prefix(e, rank)
            take = order[ragged(start, n_first)]
            if skip:
                take = take[grade[take] > 0]
                if not len(take):
                    continue
            key, who, size = x.key[take], who[take].astype(np.int64), x.size
            # Of a key of many classes here, neighbours whose sizes fit connect, and one goes on for them, untested.
            order = np.argsort(key)
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(_starts(key[order])) - 1
            crowd = np.bincount(number, minlength=1)[number] > LOCAL
            at = np.flatnonzero(crowd)
            at = at[np.lexsort((x.cls[who[at]], size[who[at]], key[at]))]
            head = _starts(key[at])
            head[1:] |= ~rule.fits(size[who[at[:-1]]], size[who[at[1:]]])
            lead = at[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(at) else at
            a, b = forest(x.cls[who[lead[~head]]].view(np.int64), x.cls[who[at[~head]]].view(np.int64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % n_buckets], pa.int32()), pa.array([a.tobytes() + b.tobytes()], pa.binary())], ["bucket", "body"])
            most = np.zeros(len(key), np.int64)
            first = np.flatnonzero(head)
            most[at[first]] = size[who[at[np.append(first[1:], len(at)) - 1]]] if len(at) else 0
            good = np.flatnonzero(~crowd | (most > 0))
            key, who, most = key[good], who[good], most[good]
            bucket, rest = (key % np.uint64(n_buckets)).astype(np.int64), (key // np.uint64(n_buckets)).astype("<u4")

            def pack(at: np.ndarray, x=x, rest=rest, who=who, most=most, width=width, maps=maps, row=row) -> bytes:
                mine, place = np.unique(who[at], return_inverse=True)
                stand = np.flatnonzero(most[at])
                own = width[mine]
                head = [np.array([len(mine), len(at), len(stand)], "<i8"), x.cls[mine], x.size[mine].astype("<u4")]
                head += [maps[g][row[mine[own == g]]] for g in range(len(WIDTHS))]
                head += [rest[at], stand.astype("<u4"), most[at][stand].astype("<u4")]
                if len(mine) < len(at):
                    head.append(place.astype("<u4"))
                else:  # one key of each: in their order
                    head[-3], head[-2] = rest[at][np.argsort(place)], place[stand].astype("<u4")
                return b"".join([y.tobytes() for y in head])

            yield dealt(bucket, n_buckets, pack)

    def meet(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:  # edges found by the tasks
            a, b = forest(*np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in bodies_of(group)], axis=1))
            return pa.table({"a": a, "b": b})
        cls, size, key, who, most, base = [], [], [], [], [], 0
        maps: list[list] = [[np.zeros((0, w // 64), np.uint64)] for w in WIDTHS]
        for raw in bodies_of(group):
            m, k, z = np.frombuffer(raw, "<i8", 3).tolist()
            at = 24 + 12 * m
            cls.append(np.frombuffer(raw, "<u8", m, 24))
            size.append(np.frombuffer(raw, "<u4", m, 24 + 8 * m).astype(np.int64))
            n_of = np.bincount(width_of(size[-1]), minlength=len(WIDTHS))
            for g, w in enumerate(WIDTHS):
                if n_of[g]:
                    maps[g].append(np.frombuffer(raw, np.uint8, n_of[g] * w // 8, at).reshape(n_of[g], w // 8))
                    at += n_of[g] * w // 8
            key.append(np.frombuffer(raw, np.uint8, 4 * k, at).view("<u4"))
            stand, value = np.frombuffer(raw, np.uint8, 8 * z, at + 4 * k).view("<u4").reshape(2, -1)
            most.append(np.zeros(k, np.int64))
            most[-1][stand] = value
            who.append((np.frombuffer(raw, np.uint8, 4 * k, at + 4 * k + 8 * z).view("<u4").astype(np.int64) if m < k else np.arange(m)) + base)
            base += m
        cls, size, key, who, most = (np.concatenate(x) for x in (cls, size, key, who, most))
        width = width_of(size)
        row = np.zeros(len(cls), np.int64)
        for g in range(len(WIDTHS)):
            row[width == g] = np.arange(int((width == g).sum()))
            maps[g] = np.concatenate([x.view(np.uint64) for x in maps[g]])
        # Keys that meet others; a class's postings of a key, from several tasks, are one unless they stand for others too.
        order = np.argsort(key, kind="stable")
        new = _starts(key[order])
        order = order[~(new & _ends(new))]
        order = order[np.lexsort((cls[who[order]], size[who[order]], key[order]))]
        key, who, most = key[order], who[order], most[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (cls[who[1:]] == cls[who[:-1]]) & (most[1:] == 0)
        key, who, most = key[~again], who[~again], most[~again]
        new = _starts(key)
        number, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        count = np.diff(np.append(begin, len(key)))
        top = np.maximum(most, size[who])
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]

        def test(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Connects the pairs (i before j, so no larger) that sizes and bit counts don't rule out, and gives them."""
            good = rule.fits(top[i], size[who[j]]) & (cls[who[i]] != cls[who[j]])
            i, j = i[good], j[good]
            free = (most[i] > 0) | (most[j] > 0)
            left.append(cls[who[i[free]]])
            right.append(cls[who[j[free]]])
            met_i, met_j = [i[free]], [j[free]]
            i, j = i[~free], j[~free]
            x, y = who[i], who[j]
            for g in np.unique(width[x]).tolist():
                same = np.flatnonzero(width[x] == g)
                for s in range(0, len(same), 1 << 15):
                    p, q = x[same[s : s + (1 << 15)]], y[same[s : s + (1 << 15)]]
                    one, two = maps[g][row[p]], np.empty((len(q), WIDTHS[g] // 64), np.uint64)
                    for h in np.unique(width[q]).tolist():  # a wider bitmap folds to a narrower one
                        sel = np.flatnonzero(width[q] == h)
                        two[sel] = np.bitwise_or.reduce(maps[h][row[q[sel]]].reshape(len(sel), -1, WIDTHS[g] // 64), axis=1)
                    can = rule.may(size[p], size[q], np.bitwise_count(one & ~two).sum(1, dtype=np.int64), np.bitwise_count(two & ~one).sum(1, dtype=np.int64))
                    left.append(cls[p[can]])
                    right.append(cls[q[can]])
                    met_i.append(i[same[s : s + (1 << 15)]][can])
                    met_j.append(j[same[s : s + (1 << 15)]][can])
            if sum(map(len, left)) > 2_000_000:
                left[:], right[:] = [[z] for z in forest(np.concatenate(left), np.concatenate(right))]
            return np.concatenate(met_i), np.concatenate(met_j)

        # Neighbours by size first, in all keys at once: near copies connect by that, and pairs within a run need no test.
        linked = np.zeros(len(key), bool)
        crowd = count[number] > large
        near = np.flatnonzero((number[1:] == number[:-1]) & ~crowd[1:]) if len(key) else begin
        for s in range(0, len(near), 1 << 18):
            linked[test(near[s : s + (1 << 18)], near[s : s + (1 << 18)] + 1)[1]] = True
        run = np.cumsum(~linked)
        small = count[number] <= LOCAL
        for step in range(2, LOCAL):
            i = np.flatnonzero(small[:-step] & (number[step:] == number[:-step]) & (run[step:] != run[:-step])) if len(key) > step else np.zeros(0, np.int64)
            for s in range(0, len(i), 1 << 18):
                test(i[s : s + (1 << 18)], i[s : s + (1 << 18)] + step)
        for s, n in zip(begin[count > LOCAL].tolist(), count[count > LOCAL].tolist(), strict=True):
            if n > large:
                near = rule.fits(np.maximum.accumulate(top[s : s + n - 1]), size[who[s + 1 : s + n]])
                left.append(cls[who[s : s + n - 1][near]])
                right.append(cls[who[s + 1 : s + n][near]])
            elif run[s] != run[s + n - 1]:
                own, far = run[s : s + n], np.arange(n)
                step = max(1, (1 << 20) // n)
                for r in range(0, n, step):
                    i, j = np.nonzero((own[r : r + step, None] != own[None, :]) & (far[None, :] > far[r : r + step, None] + 1))
                    for a in range(0, len(i), 1 << 18):
                        test(s + r + i[a : a + (1 << 18)], s + j[a : a + (1 << 18)])
        a, b = forest(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.mapInArrow(released(deal), "bucket int, body binary").groupBy("bucket").applyInArrow(released(meet), "a long, b long")
