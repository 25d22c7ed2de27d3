"""Phrase collocations by sorted n-gram keys (operator 12).

Texts (ASCII letters lower-cased) are split into pieces at `. , ; : ! ?` and line ends, pieces into words at blanks and
tabs; everything is counted a language, null being `und`. Words of `least` or more occurrences are frequent and
get dense numbers, a number for each (language, word); only they can stand in a phrase of `least` occurrences, so
pieces are broken at all other words too. From every place the up to four numbers that follow are
packed into one 16-byte big-endian key, zeros after a break. A task adds up equal keys before it writes them. Keys are dealt by
ranges, a range is radix sorted by 16-bit digits, and one pass over the sorted keys counts the runs of equal
prefixes of two, three and four numbers: all phrases of every length from one sort. Runs cut by a range's border
are added up afterwards; all others of fewer than `least` go at once.

A phrase's cuts meet the counts of their parts, and phrases meet their longer ones, in joins on keys of the counted
phrases, which are a small part of the corpus. The first `top` of each language are taken in two steps: scores
below the one at which enough phrases are reached go, then shares of what is left keep their own first.

The numbers are broadcast where they take at most `dictionary_bytes`; beyond that every text gets its own part of the
dictionary from a join of the texts' distinct words, with the same keys. Words are told apart by 64-bit hashes.

Defined results: null and empty texts have no words; a language without words has no row; repeated rows and ids count
each; ties end by the phrase's bytes; further columns are not read; an empty table gives no rows. A very long text
costs its task about a hundred bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep
from .textkit import _BYTES, blocks, mix, spans, span_hash, tune

_BREAK = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_INSIDE = ~(_BREAK | (_BYTES == 32) | (_BYTES == 9))
WIDTH = 4
RUN = 2_000_000  # keys that a task adds up at a time
RANGE = 1_000_000  # rows in a range, about


def _language(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang if lang is not None else "und").encode(), digest_size=8).digest(), "big")


def _words(data: np.ndarray, off: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block's words: start, end, text, hash with their language's, and whether each goes on in the piece of the one before."""
    start, end, ptr = spans(data, off, _INSIDE)
    text = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
    breaks = np.cumsum(_BREAK[data])
    goes_on = np.zeros(len(start), bool)
    if len(start):
        goes_on[1:] = (breaks[start[1:]] == breaks[start[:-1]]) & (text[1:] == text[:-1])
    return start, end, text, mix(span_hash(data, start, end) ^ langs[text]), goes_on


def _hashed(lang: pa.Array) -> tuple[np.ndarray, list]:
    """A 64-bit number of each row's language, and the languages."""
    found = lang.dictionary_encode(null_encoding="encode")
    names = found.dictionary.to_pylist()
    return np.array([_language(x) for x in names], np.uint64)[found.indices.to_numpy()] if names else np.zeros(0, np.uint64), names


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an array of texts."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash, word, n) of each block's distinct words, and n of all words at a null word."""
    for b in batches:
        text, lang = b.column(0), b.column(1).fill_null("und")
        salt, _ = _hashed(lang)
        for i, j, data, off in blocks(text, 1 << 20):
            start, end, row, h, _ = _words(data, off, salt[i:j])
            if not len(h):
                continue
            value, first, n = np.unique(h, return_index=True, return_counts=True)
            own = lang.take(pa.array(row[first] + i))
            yield pa.RecordBatch.from_arrays([own, pa.array(value.view(np.int64)), cut_out(data, start[first], end[first]), pa.array(n)], ["lang", "hash", "word", "n"])
            total = pa.table({"lang": lang.slice(i, j - i), "n": np.bincount(row, minlength=j - i)}).group_by("lang").aggregate([("n", "sum")])
            total = total.filter(pa.compute.greater(total["n_sum"], 0)).combine_chunks()
            if total.num_rows:
                k = total.num_rows
                yield pa.RecordBatch.from_arrays([total["lang"].combine_chunks(), pa.array(np.zeros(k, np.int64)), pa.nulls(k, pa.string()), total["n_sum"].combine_chunks()], ["lang", "hash", "word", "n"])


def keyed(number: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (high and low half) of every place where two frequent words follow each other; `number` is 0 of other words."""
    if not len(number):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ids = number.astype(np.uint64)
    after = np.zeros((WIDTH, len(ids)), np.uint64)
    after[0] = ids
    joined = np.append(goes_on[1:], False)
    for k in range(1, WIDTH):
        moved = np.append(after[k - 1][1:], np.uint64(0))
        after[k] = np.where(joined & (ids > 0), moved, 0)
    after[2] *= after[1] > 0
    after[3] *= after[2] > 0
    good = (ids > 0) & (after[1] > 0)
    wide = np.uint64(32)
    return (after[0][good] << wide) | after[1][good], (after[2][good] << wide) | after[3][good]


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of the keys, by stable passes over their 16-bit digits; digits that are all alike are left out."""
    order = np.arange(len(high))
    for half in (low, high):
        for shift in (0, 16, 32, 48):
            digit = ((half >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _bytes(high: np.ndarray, low: np.ndarray, words: int) -> pa.Array:
    packed = np.ascontiguousarray(np.stack([high, low], 1).astype(">u8").view(np.uint8)[:, : 4 * words])
    size = 4 * words
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(np.arange(0, size * (len(high) + 1), size, dtype=np.int32)), pa.py_buffer(packed)])


def _halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _added(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = radix_order(high, low)
    high, low, n = high[order], low[order], n[order]
    first = np.ones(len(high), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    return high[at], low[at], np.add.reduceat(n, at) if len(at) else n


def _grams(numbers: Callable[[np.ndarray, pa.RecordBatch, np.ndarray], np.ndarray]):
    """(key, n) of texts; `numbers` gives the words' numbers from their hashes, the batch and the words' rows."""

    def run(batches):
        held, size = [], 0

        def out():
            high, low, n = _added(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            return pa.RecordBatch.from_arrays([_bytes(high, low, WIDTH), pa.array(n)], ["key", "n"])

        for b in batches:
            salt, _ = _hashed(b.column(1).fill_null("und"))
            for i, j, data, off in blocks(b.column(0), 1 << 20):
                _, _, row, h, goes_on = _words(data, off, salt[i:j])
                high, low = keyed(numbers(h, b, row + i), goes_on)
                held.append((high, low, np.ones(len(high), np.int64)))
                size += len(high)
                if size >= RUN:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def counted_runs(high: np.ndarray, low: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Of sorted keys, the runs of equal prefixes of each length: those of `least` or more, and the first and last, which a border may cut."""
    wide = np.uint64(32)
    for words in (2, 3, 4):
        tail = np.zeros(len(low), np.uint64) if words == 2 else (low >> wide) << wide if words == 3 else low
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (tail[1:] != tail[:-1])
        at = np.flatnonzero(first)
        total = np.add.reduceat(n, at)
        good = total >= least
        good[[0, -1]] = True
        good &= True if words == 2 else (tail[at] >> wide if words == 3 else low[at] & np.uint64(0xFFFFFFFF)) > 0
        yield _bytes(high[at[good]], tail[at[good]], words), total[good]


def _runs(least: int):
    def run(batches):
        got = [(*_halves(b.column(0)), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        high, low, n = _added(*(np.concatenate([g[i] for g in got]) for i in range(3)))
        for keys, total in counted_runs(high, low, n, least):
            yield pa.RecordBatch.from_arrays([keys, pa.array(total)], ["key", "n"])

    return run


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """`rows` with dense numbers from 1 in the order of `by`'s ranges, without a sort in one task."""
    spark = rows.sparkSession
    dealt = keep(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append((p, total))
        total += sizes.get(p, 0)
    starts = spark.createDataFrame(before, "_p long, _before long")
    return dealt.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(starts), "_p").withColumn("id", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_at", "_before")


def _key(number: Column) -> Column:
    """A word's number as four bytes."""
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def _part(key: Column | str, first: Column | int, words: Column | int) -> Column:
    at, size = (F.lit(x) if isinstance(x, int) else x for x in (first, words))
    return F.substring(key, at * 4 + 1, size * 4)


def grams(docs: DataFrame, words: DataFrame, dictionary_bytes: int) -> DataFrame:
    """(key, n) of `docs` (text, lang), added up by task; words are (id, hash)."""
    spark = docs.sparkSession
    if words.count() * 12 <= dictionary_bytes:
        table = words.select("hash", "id").toArrow()
        h, ids = table["hash"].to_numpy().view(np.uint64), table["id"].to_numpy().astype(np.uint32)
        order = np.argsort(h)
        shared = spark.sparkContext.broadcast((h[order], ids[order]))

        def numbers(h, batch, row):
            known, ids = shared.value
            if not len(known):
                return np.zeros(len(h), np.uint32)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            return np.where(known[at] == h, ids[at], 0)

        return docs.mapInArrow(_grams(numbers), "key binary, n long")

    # Each text meets its own part of the dictionary.
    named = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def distinct(batches):
        for b in batches:
            salt, _ = _hashed(b.column(1).fill_null("und"))
            for i, j, data, off in blocks(b.column(0), 1 << 20):
                _, _, row, h, _ = _words(data, off, salt[i:j])
                pairs = np.unique(np.stack([b.column(2).to_numpy()[row + i].astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["_row", "hash"])

    known = named.mapInArrow(distinct, "_row long, hash long").join(words, "hash").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("hash", "id"))).alias("_known"))
    dealt = named.join(known, "_row").select("text", "lang", F.col("_known.hash").alias("known"), F.col("_known.id").alias("ids"))

    def own_numbers(h, batch, row):
        out = np.zeros(len(h), np.uint32)
        for r in np.unique(row).tolist():
            known, ids = batch.column(2)[r].values.to_numpy().view(np.uint64), batch.column(3)[r].values.to_numpy()
            order = np.argsort(known)
            mine = row == r
            at = np.minimum(np.searchsorted(known[order], h[mine]), len(known) - 1)
            out[mine] = np.where(known[order][at] == h[mine], ids[order][at], 0)
        return out

    return dealt.mapInArrow(_grams(own_numbers), "key binary, n long")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, scale: int = 2_000_000, within: int = 80, dictionary_bytes: int = 64 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases.

    A phrase's score is the least, over its cuts in two, of floor(scale * a / (l + r)); phrases inside a longer one
    that has at least `within` hundredths of their occurrences are dropped.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(_counted, "lang string, hash long, word string, n long").groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))
    words = keep(counts.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    known = keep(numbered(words.where("word is not null"), "hash", "ranged"), "numbers")
    parts = keep(grams(rows, known.select("id", "hash"), dictionary_bytes), "grams")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // RANGE))
    runs = parts.repartitionByRange(ranges, "key").mapInArrow(_runs(least), "key binary, n long")
    phrases = keep(runs.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "phrases").withColumn("words", F.expr("length(key) div 4"))

    # The lowest-scoring cut.
    count = phrases.select("key", F.col("a").alias("f")).unionByName(known.select(_key(F.col("id")).alias("key"), F.col("n").alias("f")))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int"))))
    cuts = cuts.withColumns({"left": _part("key", 0, F.col("cut")), "right": _part("key", F.col("cut"), (F.col("words") - F.col("cut")).cast("int"))})
    cuts = cuts.join(count.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(count.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.groupBy("key", "a", "words").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))

    # What a longer phrase takes in.
    longer = phrases.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), (F.col("words") - 1).cast("int"))))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("words") - F.col("size")).cast("int"))))
    inside = longer.groupBy(_part("key", F.col("at"), F.col("size")).alias("key")).agg(F.max("a").alias("longer"))
    taken = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * within, F.lit(False))
    names = known.select("id", "lang", "word")
    own = names.select(_key(F.col("id")).alias("_first"), "lang")
    left = scored.join(inside, "key", "left").where(~taken).withColumn("_first", _part("key", 0, 1)).join(own, "_first").select("key", "lang", "a", "c.l", "c.r", "c.score")
    left = keep(left, "scored")

    # Scores that can be among the first, by a count of each score.
    ordered = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    enough = left.groupBy("lang", "score").count().withColumn("before", F.coalesce(F.sum("count").over(ordered), F.lit(0))).where(F.col("before") < top)
    first = left.join(enough.select("lang", "score"), ["lang", "score"], "left_semi")
    spelt = first.withColumn("at", F.explode(F.sequence(F.lit(0), F.expr("length(key) div 4 - 1").cast("int"))))
    spelt = spelt.withColumn("id", F.conv(F.hex(_part("key", F.col("at"), 1)), 16, 10).cast("long")).join(names.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "key", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("key"), F.lit(64))
    some = spelt.withColumn("_share", share).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
