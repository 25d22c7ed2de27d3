"""Language-model scores by a probabilistic suffix tree over words (operator 2).

The tree's root is the smoothed word distribution of the contract's base. A context of up
to `depth` words is a candidate if it occurs at least `context_least` times in the training
texts and the context without its first word is a state; it stays if predicting its next
words by its own distribution rather than its parent's gains at least `divergence` nats an
occurrence. A state's distribution discounts each next word that follows it at least
`entry_least` times and gives what is left to its parent, so every state sums to 1:

    P(w | c) = max(n(c, w) - d, 0) / n(c) + left(c) * P(w | parent of c)

A text's score is the sum over its tokens of log10 P(token | longest state that is a
suffix of what stands before it).

The least counts are numbers, not shares: a larger corpus has more words, contexts and next
words that reach them, and the tree grows with it; no word, context or next word is left out.
Every state before a token ends with the word before it, so tokens are dealt by that word: a
bucket has all tokens of its words, builds their subtrees from the training ones and scores
all of them at once; the sums come back packed, for some thousands of texts at a time. A word with
more than half of `bucket_tokens` tokens after it is heavy: tasks count what follows it, one group decides its
state from the counts of its next words, and its tokens are dealt by the last two words into parts that get its next words'
probabilities as a table. Heavy contexts of two and more words go the same way.
Only numbers of the `most` most frequent words are broadcast, some twenty bytes each. Every
text's other words go to buckets by hash, where they are counted; where these may be next words (the
corpus has over `most` words of `entry_least`), their tokens go on from there to the buckets of contexts.
`docs` is read three times, and once more for each number of words that heavy contexts have, and must give the same partitions each time, as files do.

Defined results: null texts are empty texts, which are one end token; a null doc_id
counts as the empty string in the fold rule; repeated rows are scored (and counted)
each; without training texts N and V are 0 and the score is the base score; further
columns are ignored; an empty table gives no rows. A very long text costs its task about two
hundred bytes a word; nothing is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .textkit import SPACED, blocks, mix, tune, words

END = np.uint64(0x454E44)
RARE = 0xFFFFFFFF
TOP = np.uint64(1 << 63)  # marks a hash among numbers of words
HOME = 12  # texts of equal row >> HOME get their sums together
MASK = (1 << HOME) - 1
UNIT = 2.0**-32  # of the sums that buckets give back: a text's sum of a bucket is rounded by 1.2e-10 at most


class Corpus(NamedTuple):
    n: int
    distinct: int
    word: np.ndarray  # frequent words' hashes, sorted
    count: np.ndarray

    def root(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.n + 0.1 * (self.distinct + 1)))


class Rule(NamedTuple):
    state_least: int
    entry_least: int
    divergence: float
    discount: float


class States(NamedTuple):
    """The states of one order. A key is the place of the state of one word fewer << 32 | first word; of order 1, the word."""

    key: np.ndarray  # sorted
    words: np.ndarray  # a row a state, oldest word first
    left: np.ndarray
    entry: np.ndarray  # place << 32 | frequent word, sorted
    share: np.ndarray


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, each text's end among them, and the texts' pointer."""
    w = words(data, off, SPACED)
    n = np.diff(w.ptr)
    ptr = np.concatenate([[0], np.cumsum(n + 1)])
    h = np.full(ptr[-1], END, np.uint64)
    own = np.ones(len(h), bool)
    own[ptr[1:] - 1] = False
    h[own] = w.hash
    return h, ptr


def _place(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in a sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return np.where(table[at] == x, at, -1)


def _chain(word: np.ndarray, ptr: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each order, the place of the state before each token in that order's sorted keys, or -1."""
    number = np.arange(len(word)) - np.repeat(ptr[:-1], np.diff(ptr))
    out, at = [], None
    for k, table in enumerate(tables, 1):
        first = np.full(len(word), -1, np.int64)
        first[k:] = word[:-k]
        good = (number >= k) & (first >= 0)
        if at is not None:
            good &= at >= 0
        some = np.flatnonzero(good)
        key = first[some] if at is None else at[some] << 32 | first[some]
        at = np.full(len(word), -1, np.int64)
        at[some] = _place(table, key)
        out.append(at)
    return out


def _state_of(words: np.ndarray, tree: list[States], order: int) -> np.ndarray:
    """Place of the state of the last `order` words of each row, or -1."""
    at = _place(tree[0].key, words[:, -1])
    for k in range(2, order + 1):
        some = np.flatnonzero(at >= 0)
        new = np.full(len(at), -1, np.int64)
        new[some] = _place(tree[k - 1].key, at[some] << 32 | words[some, -k])
        at = new
    return at


def _least(counts: DataFrame, least: int, most: int) -> int:
    """`least`, or the smallest count above it that at most `most` rows of `counts` (n) reach."""
    held = 0
    for r in counts.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        held += r["c"]
        if held > most:
            return r["n"] + 1
    return least


def _held(ids: list, mod: int) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % mod == 0 for i in ids], bool)


def _pairs(found: dict[str, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(found["key"]), np.concatenate(found["n"])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _count(docs: DataFrame, mod: int, keys_of) -> DataFrame:
    """(key, n) over all training texts of what keys_of(hashes, pointer) gives, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {"key": [], "n": []}
        waiting = 0

        def rows() -> pa.RecordBatch:
            key, n = _pairs(found)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for b in batches:
            train = ~_held(b.column(0).to_pylist(), mod)
            for i, j, data, off in blocks(b.column(1)):
                h, ptr = tokens(data, off)
                key = keys_of(h, ptr)
                key = key[0][key[1] & np.repeat(train[i:j], np.diff(ptr))]
                if not len(key):
                    continue
                key, n = np.unique(key, return_counts=True)
                found["key"].append(key)
                found["n"].append(n)
                waiting += len(key)
                if waiting > 3_000_000:
                    key, n = _pairs(found)
                    if len(key) > 1_500_000:
                        yield rows()
                        key, n = key[:0], n[:0]
                    found["key"], found["n"] = [key], [n]
                    waiting = len(key)
        if waiting:
            yield rows()

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, mod: int, least: int, most: int) -> tuple[DataFrame, Corpus, int]:
    """Counts of all training words (key, n), the `most` most frequent of at least `least`, and the count these reach."""
    counted = keep(_count(docs, mod, lambda h, ptr: (h, np.ones(len(h), bool))), "lm-words")
    total = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    cut = _least(counted, least, most)
    frequent = counted.where(F.col("n") >= cut).toArrow()
    hashes = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return counted, Corpus(total["n"] or 0, total["v"], hashes[order], frequent["n"].to_numpy()[order]), cut


def train(docs: DataFrame, *, mod: int = 10, context_least: int = 64, entry_least: int = 4, most: int = 2_000_000, divergence: float = 0.002, depth: int = 3, discount: float = 0.5) -> tuple[Corpus, list[States]]:
    """The most frequent part of the tree of the training texts of `docs` as local arrays, to look at; :func:`score` has no such bound and does not use it."""
    spark = docs.sparkSession
    _, corpus, _ = count_words(docs, mod, entry_least, most)
    tree: list[States] = []
    root = 10.0 ** corpus.root(corpus.count)
    # Candidates: a row of words, oldest first, and its key among the states of one word fewer.
    words = np.flatnonzero((corpus.count >= context_least) & (corpus.word != END)).astype(np.int64)[:, None]
    keys = words[:, 0]
    for k in range(1, depth + 1):
        if not len(keys):
            break
        shared = spark.sparkContext.broadcast((corpus.word, [t.key for t in tree] + [keys]))

        def keys_of(h: np.ndarray, ptr: np.ndarray, shared=shared) -> tuple[np.ndarray, np.ndarray]:
            vocabulary, tables = shared.value
            word = _place(vocabulary, h)
            at = _chain(word, ptr, tables)[-1]
            return at << 32 | np.where(word < 0, RARE, word), at >= 0

        pairs = keep(_count(docs, mod, keys_of), f"lm-order{k}")
        place = F.shiftright("key", 32)
        sums = pairs.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).toArrow()
        n_of = np.zeros(len(keys))
        n_of[sums["place"].to_numpy()] = sums["n"].to_numpy()
        known = pairs.where(F.col("key").bitwiseAND(RARE) != RARE)
        rows = known.where(F.col("n") >= _least(known, entry_least, most)).toArrow()
        shared.unpersist()
        entry, count = rows["key"].to_numpy(), rows["n"].to_numpy()
        by = np.argsort(entry)
        entry, count = entry[by], count[by].astype(float)
        place, word = entry >> 32, entry & RARE
        share = np.maximum(count - discount, 0) / n_of[place]
        left = np.maximum(1 - np.bincount(place, share, minlength=len(keys)), 1e-12)
        # The parent's probability of each entry: through the states of all lower orders.
        parent = root[word]
        for j in range(1, k):
            above = tree[j - 1]
            at = _state_of(words[:, -j:], tree, j)[place]
            hit = _place(above.entry, np.maximum(at, 0) << 32 | word)
            held = np.where(hit >= 0, above.share[hit] if len(above.share) else 0, 0) + above.left[np.maximum(at, 0)] * parent
            parent = np.where(at >= 0, held, parent)
        own = share + left[place] * parent
        gain = np.bincount(place, count * np.log(own / parent), minlength=len(keys)) + (n_of - np.bincount(place, count, minlength=len(keys))) * np.log(left)
        stay = (n_of > 0) & (gain >= divergence * n_of)
        new = np.cumsum(stay) - 1
        good = stay[place]
        tree.append(States(keys[stay], words[stay], left[stay], new[place[good]] << 32 | word[good], share[good]))
        # Candidates one word longer: contexts and next words frequent enough together, whose last words are a state.
        longer = np.flatnonzero((count >= context_least) & (corpus.word[word] != END))
        words = np.concatenate([words[place[longer]], word[longer, None]], axis=1)
        at = _state_of(words, tree, k)
        words, at = words[at >= 0], at[at >= 0]
        keys = at << 32 | words[:, 0]
        by = np.argsort(keys)
        keys, words = keys[by], words[by]
    return corpus, tree


def _pack(x: np.ndarray) -> bytes:
    """Integers from 0 on as planes of their bytes, as many as the greatest needs."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(raw: pa.Buffer, at: int, n: int) -> tuple[np.ndarray, int]:
    width = int(np.frombuffer(raw, np.uint8, 1, at)[0])
    out = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
    return out.view("<u4" if width <= 4 else "<u8").ravel(), at + 1 + n * width


def _ids(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of pairs (group, x), in their order."""
    if len(x) and int(x.max()) >> 32:
        x = np.unique(x, return_inverse=True)[1].astype(np.uint32)
    key = group.astype(np.uint64)
    key <<= np.uint64(32)
    np.bitwise_or(key, x, out=key)
    order = np.argsort(key)
    key = key[order]
    ids = np.empty(len(key), np.uint32)
    ids[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.uint32)])[: len(key)]
    return ids


def grow(context: list[np.ndarray], w: np.ndarray, p: np.ndarray, train: np.ndarray, rule: Rule, start: int = 1) -> np.ndarray:
    """Probabilities of tokens `w` (0: too rare to be a next word), by the subtree of the states from order `start` on.

    context[k - 1] is the k-th word before each token (0: none); `p` its probability by lower orders. All tokens that share
    their last `start` words of context must be here, the training ones among them marked.
    """
    p = p.copy()
    live, group = np.arange(len(w), dtype=np.uint32), np.zeros(len(w), np.uint32)
    for k, c in enumerate(context, 1):
        good = c[live] != 0
        live, group = live[good], group[good]
        if not len(live):
            break
        group = _ids(group, c[live])
        if k < start:
            continue
        n_of = np.bincount(group, train[live])
        good = (n_of >= rule.state_least)[group]
        live, group = live[good], group[good]
        if not len(live):
            break
        pair = _ids(group, w[live])
        size = int(pair.max()) + 1
        state, word, parent = np.empty(size, np.int64), np.empty(size, w.dtype), np.empty(size)
        state[pair], word[pair], parent[pair] = group, w[live], p[live]  # alike for all tokens of a pair
        n = np.bincount(pair, train[live], minlength=size)
        n[(n < rule.entry_least) | (word == 0)] = 0
        share = np.maximum(n - rule.discount, 0) / np.maximum(n_of[state], 1)
        left = np.maximum(1 - np.bincount(state, share, minlength=len(n_of)), 1e-12)
        own = share + left[state] * parent
        gain = np.bincount(state, n * np.log(own / parent), minlength=len(n_of)) + (n_of - np.bincount(state, n, minlength=len(n_of))) * np.log(left)
        stay = (gain >= rule.divergence * n_of)[group]
        live, group = live[stay], group[stay]
        p[live] = own[pair[stay]]
    return p


def _read(bodies: list[pa.Buffer], depth: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(row of each text, its number of tokens, then of each token: train, w, contexts, p or 0) of bodies of :func:`_body`; `wide`: hashes may stand among numbers."""
    bodies = [pa.decompress(raw[8:], int(np.frombuffer(raw, "<i8", 1)[0]), codec="zstd") for raw in bodies]
    heads = [np.frombuffer(raw, "<i8", 4).tolist() for raw in bodies]
    size = sum(n for _, _, n, _ in heads)
    w, *context = (np.zeros(size, np.uint64 if wide else np.uint32) for _ in range(depth + 1))
    train, p = np.zeros(size, bool), np.zeros(size if wide else 0)
    rows, each_of, t = [], [], 0
    for raw, (base, n_texts, n, given) in zip(bodies, heads, strict=True):
        text, at = _unpack(raw, 32, n_texts)
        each, at = _unpack(raw, at, n_texts)
        rows.append(base + np.cumsum(text >> 1, dtype=np.int64))
        each_of.append(each.astype(np.int64))
        train[t : t + n] = np.repeat(text & 1, each)
        for x in (w, *context):
            x[t : t + n], at = _unpack(raw, at, n)
        if given:
            p[t : t + n] = np.frombuffer(raw, "<f8", n, at)
        t += n
    return np.concatenate(rows), np.concatenate(each_of), train, w, context, p


def _body(base: int, text: np.ndarray, train: np.ndarray, w: np.ndarray, context: list[np.ndarray], p: np.ndarray | None = None) -> bytes:
    """Tokens in the order of their texts (numbers from `base` on; `train`: marks of the tokens)."""
    own, first, each = np.unique(text, return_index=True, return_counts=True)
    head = np.array([base, len(own), len(w), p is not None], "<i8").tobytes()
    raw = head + _pack(np.diff(own, prepend=0) << 1 | train[first]) + _pack(each) + b"".join(map(_pack, [w, *context])) + (b"" if p is None else p.astype("<f8").tobytes())
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of these columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sums(unit: np.ndarray, x: np.ndarray, n: np.ndarray, p: np.ndarray | None = None) -> tuple:
    """Distinct (unit, x), sorted, the sums of their n and their p."""
    order = np.lexsort((x, unit)) if len(x) and int(x.max()) >> 32 else np.argsort(unit.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64))
    unit, x, n = unit[order], x[order], n[order]
    first = _starts(unit, x)
    return unit[first], x[first], np.add.reduceat(n, first) if len(n) else n, None if p is None else p[order][first]


class Counts(NamedTuple):
    """What follows heavy contexts: their next words (the training tokens' number, and probability at the root if it is known), and the heavy words before them."""

    unit: np.ndarray
    word: np.ndarray
    n: np.ndarray
    p: np.ndarray | None
    before: tuple[np.ndarray, np.ndarray, np.ndarray]  # unit, word, number of all tokens

    def body(self, words: np.ndarray, before: np.ndarray) -> bytes:
        """These places of either list, of one unit."""
        head = np.array([len(words), len(before), self.p is not None], "<i8").tobytes()
        own = _pack(self.word[words]) + _pack(self.n[words]) + (b"" if self.p is None else self.p[words].astype("<f8").tobytes())
        return head + own + _pack(self.before[1][before]) + _pack(self.before[2][before])

    @staticmethod
    def of(bodies: list[pa.Buffer]) -> "Counts":
        """The sums of bodies of one unit."""
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for raw in bodies:
            n, m, given = np.frombuffer(raw, "<i8", 3).tolist()
            at = 24
            for k, size in ((0, n), (1, n), (2, n * given), (3, m), (4, m)):
                if k == 2:
                    x = np.frombuffer(raw, "<f8", size, at)
                    at += 8 * size
                else:
                    x, at = _unpack(raw, at, size)
                columns[k].append(x)
        word, n, p, c, m = (np.concatenate(x) for x in columns)
        zero = lambda x: np.zeros(len(x), np.int64)
        return Counts(*_sums(zero(word), word, n.astype(np.int64), p if len(p) else None), _sums(zero(c), c, m.astype(np.int64))[:3])


def _table(start: int, w: np.ndarray, p: np.ndarray) -> bytes:
    """Probabilities of next words at a heavy context, and the order from which states are looked for below it."""
    return np.array([-1, start, len(w), 0], "<i8").tobytes() + _pack(w) + p.astype("<f8").tobytes()


def _table_of(raw: pa.Buffer) -> tuple[int, np.ndarray, np.ndarray]:
    _, start, n, _ = np.frombuffer(raw, "<i8", 4).tolist()
    w, at = _unpack(raw, 32, n)
    return start, w, np.frombuffer(raw, np.uint8, 8 * n, at).view("<f8")


class Heavy(NamedTuple):
    """The heavy contexts of one number of words. A key is the place of the context without its first word << 32 | first word; of one word, the word."""

    key: np.ndarray  # sorted
    start: np.ndarray  # the order from which states are looked for below
    first: np.ndarray  # the first bucket
    parts: np.ndarray  # the number of buckets


def deepest(context: list[np.ndarray], keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, how many words the longest heavy context before it has, and that one's place."""
    level, at = np.zeros(len(context[0]), np.int64), np.zeros(len(context[0]), np.int64)
    live = np.arange(len(level))
    for k, table in enumerate(keys):
        c = context[k][live].astype(np.uint64)
        good = (c > 0) & (c < TOP)
        live, c = live[good], c[good].astype(np.int64)
        spot = _place(table, at[live] << 32 | c)
        live, spot = live[spot >= 0], spot[spot >= 0]
        level[live], at[live] = k + 1, spot
    return level, at


def score(docs: DataFrame, *, mod: int = 10, context_least: int = 64, entry_least: int = 4, most: int = 2_000_000, divergence: float = 0.002, depth: int = 3, discount: float = 0.5, bucket_tokens: int = 1_500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    rule = Rule(max(context_least, entry_least), entry_least, divergence, discount)
    _, corpus, cut = count_words(docs, mod, entry_least, most)
    rank = np.empty(len(corpus.word), np.uint32)
    by = np.lexsort((corpus.word, -corpus.count))
    rank[by] = np.arange(1, len(by) + 1)
    falling = -corpus.count[by]
    n_state = int(np.searchsorted(falling, -rule.state_least, side="right"))  # words up to this rank may be contexts
    limit = bucket_tokens // 2
    n_heavy = int(np.searchsorted(falling[:n_state], -limit))  # words up to this one have more tokens after them than `limit`
    far_words, far_contexts = cut > entry_least, cut > rule.state_least
    n_buckets = max(8, -(-int(corpus.n + falling[:n_heavy].sum()) // bucket_tokens))
    by_rank = np.append(1.0, 10.0 ** corpus.root(corpus.count[by]))
    shared, shared_root = spark.sparkContext.broadcast((corpus.word, rank)), spark.sparkContext.broadcast(by_rank)
    corpus_n, distinct = corpus.n, corpus.distinct
    head = np.dtype([("row", "<i8"), ("doc", "<i8"), ("null", "?"), ("train", "?"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8")])

    def texts(batches: Iterator[pa.RecordBatch]):
        """Of each block: its first row, ids, held-out marks, pointer, tokens' hashes, words (0: no number), contexts, whether a token's word has no number."""
        known, number = shared.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids = b.column(0).to_pylist()
            held = _held(ids, mod)
            for i, j, data, off in blocks(b.column(1), 4 << 20):
                h, ptr = tokens(data, off)
                value, at = np.unique(h, return_inverse=True)
                spot = _place(known, value)
                far = spot < 0
                w = np.zeros(len(value), np.uint64)
                w[~far] = number[spot[~far]]
                before = np.where(w <= n_state, w, np.uint64(0))
                if far_contexts:
                    before[far] = value[far] | TOP
                w, far, before = w[at], far[at], before[at]
                nth = np.arange(len(h)) - np.repeat(ptr[:-1], np.diff(ptr))
                context, good = [], np.ones(len(h), bool)
                for k in range(1, depth + 1):
                    x = np.zeros(len(h), np.uint64)
                    x[k:] = before[:-k]
                    good &= (nth >= k) & (x != 0)
                    x[~good] = 0
                    context.append(x)
                yield row, ids[i:j], held[i:j], ptr, h, w, context, far
                row += j - i

    def dealt(base: int, bucket, n: int, text, train, w, context, p=None) -> tuple[list[int], list[bytes]]:
        """Bodies of tokens by their buckets, which are below n; tokens of bucket -1 go nowhere."""
        order = np.argsort((bucket + 1).astype(np.uint16) if n + 1 < 1 << 16 else bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [order[cuts[k] : cuts[k + 1]] for k in full]
        return full, [_body(base, text[o], train[o], w[o], [c[o] for c in context], None if p is None else p[o]) for o in parts]

    def light(c1: np.ndarray) -> np.ndarray:
        """Buckets of last words; ranks in turn, so that each bucket has as many frequent words. In it a word's quotient (from 1 on) stands for it."""
        return (c1 % np.uint64(n_buckets)).astype(np.int64)

    def numbered(batches: Iterator[pa.RecordBatch]):
        """Of each block, the tokens with a context: first row, texts, train, words, contexts, no probabilities. Words without a number that may be next words come another way."""
        for row, _, held, ptr, _, w, context, far in texts(batches):
            o = np.flatnonzero((context[0] != 0) & ~(far & far_words))
            text = np.repeat(np.arange(len(held)), np.diff(ptr))[o]
            yield row, text, ~held[text], w[o], [c[o] for c in context], None

    def told_apart(batches: Iterator[pa.RecordBatch]):
        """The same of bodies of :func:`settle`."""
        for b in batches:
            for body in b.column(0):
                row, each, train, w, context, p = _read([body.as_buffer()], depth, True)
                yield int(row[0]), np.repeat(row - row[0], each), train, w, context, p

    def counted(source, keys: list[np.ndarray], slices: np.ndarray):
        """(unit, slice, body): counts of what follows the heavy contexts of as many words as `keys` has lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, waiting = [], 0

            def rows() -> pa.RecordBatch:
                # A probability of 0 stands for one that the word's number tells.
                join = lambda k: np.concatenate([x[k] for x in held])
                x = Counts(*_sums(join(0), join(1), join(2), join(3) if far_words else None), _sums(join(4), join(5), join(6))[:3])
                slot = (x.word.astype(np.uint64) % slices[x.unit].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((slot, x.unit))
                first = _starts(x.unit[order], slot[order])
                out = []
                for o in np.split(order, first[1:]):
                    unit, number = int(x.unit[o[0]]), int(slot[o[0]])
                    a, b = np.searchsorted(x.before[0], [unit, unit + 1])
                    own = np.arange(a, b) if not len(out) or out[-1][0] != unit else np.zeros(0, np.int64)
                    out.append((unit, number, x.body(o, own)))
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["unit", "slice", "body"])

            for _, _, train, w, context, p in source(batches):
                level, at = deepest(context, keys)
                o = np.flatnonzero(level == len(keys))
                if not len(o):
                    continue
                p = np.zeros(len(w)) if p is None else p
                unit, word, n, root = _sums(at[o], w[o], train[o].astype(np.int64), p[o])
                c = context[len(keys)][o] if len(keys) < depth else np.zeros(len(o), np.uint64)
                near = np.flatnonzero((c > 0) & (c <= n_heavy))
                held.append((unit, word, n, root, *_sums(at[o][near], c[near], np.ones(len(near), np.int64))[:3]))
                waiting += len(unit)
                if waiting > 2_000_000:
                    yield rows()
                    held.clear()
                    waiting = 0
            if held:
                yield rows()

        return run

    def add(group: pa.Table) -> pa.Table:
        x = Counts.of([x.as_buffer() for chunk in group["body"].chunks for x in chunk])
        body = x.body(np.arange(len(x.word)), np.arange(len(x.before[1])))
        return pa.table({"unit": group["unit"][:1], "above": pa.array([False]), "body": pa.array([body], pa.binary())})

    def decide(k: int):
        """Of one heavy context of k words: whether it is a state, the training tokens after it, its table, and the heavy words before it."""

        def run(group: pa.Table) -> pa.Table:
            bodies = [x.as_buffer() for chunk in group["body"].chunks for x in chunk]
            above = group["above"].to_pylist()
            x = Counts.of([b for b, up in zip(bodies, above, strict=True) if not up])
            parent = started(shared_root.value, x.word, x.p if x.p is not None else np.zeros(0))
            for b in (b for b, up in zip(bodies, above, strict=True) if up):
                _, w, p = _table_of(b)
                parent = p[np.searchsorted(w, x.word)]
            n_of = int(x.n.sum())
            n = np.where((x.n >= rule.entry_least) & (x.word != 0), x.n, 0)
            share = np.maximum(n - rule.discount, 0) / max(n_of, 1)
            left = max(1 - share.sum(), 1e-12)
            own = share + left * parent
            gain = (n * np.log(own / parent)).sum() + (n_of - n.sum()) * np.log(left)
            stay = bool(n_of >= rule.state_least and gain >= rule.divergence * n_of)
            heavy = x.before[2] > limit
            table = _table(k + 1 if stay else depth + 1, x.word, own if stay else parent)
            out = {"unit": group["unit"][:1], "stay": pa.array([stay]), "n": pa.array([n_of]), "body": pa.array([table], pa.binary())}
            return pa.table(out | {name: pa.array([v[heavy].tolist()], pa.list_(pa.int64())) for name, v in (("before", x.before[1]), ("n_before", x.before[2]))})

        return run

    def deal(source, levels: list[Heavy], n: int):
        """Tokens by the bucket of the last word before them, or the part of the longest heavy context before them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, text, train, w, context, p in source(batches):
                c1 = context[0].astype(np.uint64)
                bucket = light(c1)
                level, at = deepest(context, [x.key for x in levels])
                for k, x in enumerate(levels, 1):
                    o = np.flatnonzero(level == k)
                    spot, by = at[o], (row + text[o]).astype(np.uint64)
                    if k < depth:
                        c = context[k][o].astype(np.uint64)
                        by = np.where((c > 0) & (x.start[spot] <= depth), c, by)
                    parts = x.parts[spot]
                    bucket[o] = np.where(parts > 0, x.first[spot] + (mix(by) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), -1)
                c1 = np.where(level == 0, c1 // np.uint64(n_buckets) + np.uint64(1), c1)
                buckets, bodies = dealt(row, bucket, n, text, train, w, [c1, *context[1:]], p)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

        return run

    def deal_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, and their words without a number by hash, with contexts if these words may be next words."""
        root = np.log10(shared_root.value)
        for row, ids, held, ptr, h, w, context, far in texts(batches):
            n = len(ids)
            doc = np.repeat(np.arange(n), np.diff(ptr))
            table = np.zeros(n, head)
            table["row"] = row + np.arange(n)
            table["doc"] = [0 if x is None else x for x in ids]
            table["null"] = [x is None for x in ids]
            table["train"] = ~held
            table["tokens"] = np.diff(ptr)
            table["known"] = np.bincount(doc[~far], minlength=n)
            table["base"] = np.bincount(doc[~far], root[w[~far].astype(np.int64)], minlength=n)
            home = row // 512 % n_buckets  # of all texts of the block
            o = np.flatnonzero(far)
            bucket = (h[o] % np.uint64(n_buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[sort], np.arange(n_buckets + 1))
            full = np.union1d(np.flatnonzero(np.diff(cuts)), [home]).tolist()
            bodies = []
            for k in full:
                mine = o[sort[cuts[k] : cuts[k + 1]]]
                own = table.tobytes() if k == home else b""
                held_contexts = [x[mine] for x in context] if far_words else [np.zeros(0, np.uint64)] * depth
                bodies.append(np.array([row, len(own), len(mine), len(held_contexts[0])], "<i8").tobytes() + own + h[mine].tobytes() + _pack(doc[mine] << 1 | ~held[doc[mine]]) + b"".join(map(_pack, held_contexts)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def settle(group: pa.Table) -> pa.Table:
        """Texts and sums for them, and tokens with their words' probabilities for the buckets of contexts (-1: heavy)."""
        tables, values, marks, bases, contexts = [], [], [], [], []
        for body in (x.as_buffer() for chunk in group["body"].chunks for x in chunk):
            base, size, m, n = np.frombuffer(body, "<i8", 4).tolist()
            tables.append(np.frombuffer(body, head, size // head.itemsize, 32))
            at = 32 + size
            values.append(np.frombuffer(body, "<u8", m, at))
            mark, at = _unpack(body, at + 8 * m, m)
            marks.append(mark.astype(np.int64))
            bases.append(base)
            own = []
            for _ in range(depth):
                x, at = _unpack(body, at, n)
                own.append(x.astype(np.uint64))
            contexts.append(own)
        value = np.concatenate(values)
        train = (np.concatenate(marks) & 1).astype(bool)
        where = np.concatenate([b + (m >> 1) for b, m in zip(bases, marks, strict=True)])
        word = np.unique(value, return_inverse=True)[1]
        count = np.bincount(word, train, minlength=1)[word] if len(word) else np.zeros(0)
        p = (count + 0.1) / (corpus_n + 0.1 * (distinct + 1))
        row, text = np.unique(where, return_inverse=True)
        log = np.bincount(text, np.log10(p), minlength=len(row))
        known = np.bincount(text, count > 0, minlength=len(row)).astype(np.int64)
        table = np.concatenate(tables)
        homes, bodies = by_home(table["row"], lambda o: b"\0" + table[o].tobytes())
        more = by_home(row, lambda o: b"\1" + len(o).to_bytes(8, "little") + _pack(row[o] & MASK) + _pack(known[o]) + log[o].astype("<f8").tobytes())
        homes, bodies = homes + more[0], bodies + more[1]
        out = [pa.table({"home": pa.array(homes, pa.int64()), "bucket": pa.nulls(len(homes), pa.int32()), "body": pa.array(bodies, pa.binary())})]
        if far_words:
            buckets, bodies, at = [], [], 0
            told = np.where(count >= entry_least, value | TOP, np.uint64(0))
            p = np.where(count >= entry_least, p, 1.0)
            for base, mark, own in zip(bases, marks, contexts, strict=True):
                o = np.flatnonzero(own[0])
                c1 = own[0][o]
                apart = np.where(c1 <= n_heavy, 0, light(c1) + 1)
                c1 = np.where(apart > 0, c1 // np.uint64(n_buckets) + np.uint64(1), c1)
                found = dealt(base, apart, n_buckets + 1, mark[o] >> 1, mark[o] & 1, told[at + o], [c1, *(c[o] for c in own[1:])], p[at + o])
                buckets += [k - 1 for k in found[0]]
                bodies += found[1]
                at += len(mark)
            out.append(pa.table({"home": pa.nulls(len(bodies), pa.int64()), "bucket": pa.array(buckets, pa.int32()), "body": pa.array(bodies, pa.binary())}))
        return pa.concat_tables(out)

    def by_home(row: np.ndarray, pack) -> tuple[list[int], list[bytes]]:
        order = np.argsort(row, kind="stable")
        home = row[order] >> HOME
        first = _starts(home)
        return home[first].tolist(), [pack(o) for o in np.split(order, first[1:])] if len(first) else []

    def descend(group: pa.Table) -> pa.Table:
        bodies = [x.as_buffer() for chunk in group["body"].chunks for x in chunk]
        tables = [x for x in bodies if np.frombuffer(x, "<i8", 1)[0] < 0]
        bodies = [x for x in bodies if np.frombuffer(x, "<i8", 1)[0] >= 0]
        if not bodies:
            return pa.table({"home": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        row, each, train, w, context, p = _read(bodies, depth, far_words)
        del bodies
        start, known, at_known = _table_of(tables[0]) if tables else (1, None, None)
        root, gain = shared_root.value, np.zeros(len(w))
        pieces = max(1, len(w) >> 18)  # the contexts of some words at a time
        part = (context[min(start, depth) - 1].astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(pieces)
        for k in range(pieces):
            o = np.flatnonzero(part == k)
            first = started(root, w[o], p[o] if len(p) else p)
            begun = first if known is None else at_known[np.searchsorted(known, w[o])]
            gain[o] = np.log10((grow([c[o] for c in context], w[o], begun, train[o], rule, start) if start <= depth else begun) / first)
        gain = np.add.reduceat(gain, np.cumsum(each) - each)
        some = np.flatnonzero(gain)
        row, units = row[some], np.rint(gain[some] / UNIT).astype(np.int64)

        def pack(o: np.ndarray) -> bytes:
            low = int(units[o].min())
            raw = _pack(np.diff(row[o] & MASK, prepend=0)) + _pack(units[o] - low)
            return b"".join([b"\2", *(x.to_bytes(8, "little", signed=True) for x in (len(o), low, len(raw))), pa.compress(raw, codec="zstd", asbytes=True)])

        homes, bodies = by_home(row, pack)
        return pa.table({"home": pa.array(homes, pa.int64()), "body": pa.array(bodies, pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        """The rows of the texts of a home."""
        tables, known, log, units = [np.zeros(0, head)], *(np.zeros(1 << HOME, t) for t in (np.int64, np.float64, np.int64))
        for raw in (x.as_buffer() for chunk in group["body"].chunks for x in chunk):
            kind = raw[0:1].to_pybytes()
            if kind == b"\0":
                tables.append(np.frombuffer(raw, head, offset=1))
                continue
            n = int.from_bytes(raw[1:9].to_pybytes(), "little")
            if kind == b"\1":
                spot, at = _unpack(raw, 9, n)
                x, at = _unpack(raw, at, n)
                np.add.at(known, spot, x.astype(np.int64))
                np.add.at(log, spot, np.frombuffer(raw, np.uint8, 8 * n, at).view("<f8"))
            else:
                low, size = np.frombuffer(raw, "<i8", 2, 9).tolist()
                step, at = _unpack(body := pa.decompress(raw[25:], size, codec="zstd"), 0, n)
                np.add.at(units, np.cumsum(step, dtype=np.int64), _unpack(body, at, n)[0].astype(np.int64) + low)
        table = np.concatenate(tables)
        spot = table["row"] & MASK
        base = table["base"] + log[spot]
        columns = [pa.array(table["doc"], mask=table["null"]), ~table["train"], table["tokens"], table["known"] + known[spot], np.full(len(table), corpus_n, np.int64), base, base + units[spot] * UNIT]
        return pa.table([pa.array(c) for c in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def started(root: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Words' probabilities at the root: what came with them, or that of their numbers."""
        return np.where(p > 0, p, root[np.where(p > 0, 0, w)]) if len(p) else root[w]

    found = docs.mapInArrow(deal_rare, "bucket int, body binary").groupBy("bucket").applyInArrow(settle, "home long, bucket int, body binary")
    if far_words:
        found = keep(found, "lm-rare")
    passed = found.where("home is null")
    late = passed.where("bucket < 0").select("body")

    levels: list[Heavy] = []
    placed = []  # (bucket, body) of the heavy contexts' tables
    keys = np.setdiff1d(np.arange(1, n_heavy + 1), rank[corpus.word == END]).astype(np.int64)
    expected = corpus.count[by][keys - 1]
    n = n_buckets
    tables = None
    while len(keys):
        k = len(levels) + 1
        run = [[x.key for x in levels] + [keys], np.maximum(1, -(-expected // (4 * bucket_tokens))).astype(np.int64)]
        counts = docs.mapInArrow(counted(numbered, *run), "unit int, slice int, body binary")
        if far_words:
            counts = counts.unionByName(late.mapInArrow(counted(told_apart, *run), "unit int, slice int, body binary"))
        counts = counts.groupBy("unit", "slice").applyInArrow(add, "unit int, above boolean, body binary")
        if tables is not None:  # what the context without its first word gives to each next word
            own = spark.createDataFrame([(i, int(key >> 32)) for i, key in enumerate(keys.tolist())], "child int, unit int")
            counts = counts.unionByName(tables.join(F.broadcast(own), "unit").select(F.col("child").alias("unit"), F.lit(True).alias("above"), "body"))
        tables = keep(counts.groupBy("unit").applyInArrow(decide(k), "unit int, stay boolean, n long, body binary, before array<long>, n_before array<long>"), "lm-heavy")
        size = len(keys)
        start, parts = np.full(size, depth + 1), np.zeros(size, np.int64)
        below, more = [], []
        for r in tables.select("unit", "stay", "n", "before", "n_before").toLocalIterator():
            u = r["unit"]
            if not r["stay"] and k == 1:
                continue  # its tokens keep what the root gives them
            rest = r["n"]
            if r["stay"]:
                start[u] = k + 1
                below += [u << 32 | c for c in r["before"]]
                more += r["n_before"]
                rest -= sum(r["n_before"])
            parts[u] = max(1, -(-rest * 5 // (4 * bucket_tokens)))
        first = n + np.cumsum(parts) - parts
        n += int(parts.sum())
        levels.append(Heavy(keys, start, first, parts))
        buckets = [(u, int(first[u]) + i) for u in range(size) for i in range(int(parts[u]))]
        if buckets:
            placed.append(tables.join(F.broadcast(spark.createDataFrame(buckets, "unit int, bucket int")), "unit").select("bucket", "body"))
        order = np.argsort(np.array(below, np.int64))
        keys, expected = np.array(below, np.int64)[order], np.array(more, np.int64)[order]

    bodies = docs.mapInArrow(deal(numbered, levels, n), "bucket int, body binary")
    if far_words:
        bodies = bodies.unionByName(passed.where("bucket >= 0").select("bucket", "body"))
        if levels:
            bodies = bodies.unionByName(late.mapInArrow(deal(told_apart, levels, n), "bucket int, body binary"))
    for t in placed:
        bodies = bodies.unionByName(t)
    gains = bodies.groupBy("bucket").applyInArrow(descend, "home long, body binary")
    back = found.where("home is not null").select("home", "body").unionByName(gains)
    return back.groupBy("home").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, *, mod: int = 10, **options) -> DataFrame:
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, mod=mod, **options)
