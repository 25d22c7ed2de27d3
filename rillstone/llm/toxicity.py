"""Toxicity from the nearest labelled examples by weighted TF-IDF cosine (operator 5).

Terms are a text's words (ASCII letters lower-cased), all of them. A bounded sample of
labelled rows (`max_examples`, the least hashes of their ids, half of each label at most)
makes the examples. Plain TF-IDF cosine finds texts of the same prose rather than of the same
label (its ranking errs three to ten times as often on held-out rows), so a term's weight
also has its evidence in the examples: the square of the standard score of its log odds
between the labels. No term is left out; document frequencies are counted over all
documents.

The examples' vectors form an inverted index in blocks of examples with the greatest weight
of each term in each block. A query adds up its heaviest terms first; once no example
unseen so far can reach the k-th best cosine, only blocks that hold one that still can are
read for the other terms. Neighbours and cosines are exact.

A score is the neighbours' vote, weighted by squared cosine and smoothed towards the rate of
examples without terms, then mapped to the rate observed for such votes on a held part of the
examples by a monotone step function. Examples that tie at the k-th place share what is left
of the k votes, so that no id decides. Each example stands for as many training rows as its
label has for one example, in votes, rates and calibration, so that scores follow the training
rows' label rates whatever the sample's are.

Defined results: null, empty and unknown-word texts have no terms and get the smoothed
rate of examples without terms; null or missing labels don't count; a row that repeats
is scored each time (as an example its least text counts once); a labelled row is among its
own neighbours; without labels of both kinds every score is 0; further columns pass
through and clashing names are replaced (see `prefix`). A very long text costs its task about
a hundred bytes a word; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, blocks, extended, ragged, released, tune, words

BLOCK = 64
TERMS = 16  # of a query, added up at first


def counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of a term, how often) of a block of texts."""
    w = words(data, off, ALNUM)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(w.ptr))
    order = np.lexsort((w.hash, doc))
    value, doc = w.hash[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(value)))


class Index(NamedTuple):
    vocabulary: np.ndarray  # the examples' terms, sorted
    factor: np.ndarray  # of a term's weight: inverse document frequency times evidence
    ids: np.ndarray  # examples with terms, ascending
    label: np.ndarray
    stands: np.ndarray  # relative weight of each example: its label's share of training rows over that of examples
    ptr: np.ndarray  # postings of a term
    example: np.ndarray
    weight: np.ndarray
    bptr: np.ndarray  # blocks of a term
    block: np.ndarray
    most: np.ndarray  # greatest weight of the term in the block
    at: np.ndarray  # where the block's postings begin; one more at the end
    top: np.ndarray  # greatest weight of the term
    bare: float  # smoothed rate among examples without terms
    k: int
    edges: np.ndarray  # calibration: votes from edges[i] on score levels[i]
    levels: np.ndarray

    def nearest(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the k best cosines to a unit vector and all that tie with the last of them, best first."""
        score = np.zeros(len(self.ids))
        order = np.argsort(-w * self.top[t], kind="stable")
        t, w = t[order], w[order]
        rest = np.append(np.cumsum((w * self.top[t])[::-1])[::-1], 0.0)
        i, step, least = 0, TERMS, 0.0
        while i < len(t):
            j = min(i + step, len(t))
            n = self.ptr[t[i:j] + 1] - self.ptr[t[i:j]]
            r = ragged(self.ptr[t[i:j]], n)
            score += np.bincount(self.example[r], self.weight[r] * np.repeat(w[i:j], n), minlength=len(score))
            if skip >= 0:
                score[skip] = 0
            i, step = j, step * 2
            least = np.partition(score, -self.k)[-self.k] if len(score) > self.k else 0.0
            if rest[i] < least - 1e-9:
                break
        if i < len(t):
            # No unseen example can reach the k-th best now: the other terms are read where one that can still lies.
            n = self.bptr[t[i:] + 1] - self.bptr[t[i:]]
            r = ragged(self.bptr[t[i:]], n)
            weight = np.repeat(w[i:], n)
            bound = np.bincount(self.block[r], self.most[r] * weight, minlength=-(-len(score) // BLOCK))
            high = np.maximum.reduceat(score, np.arange(0, len(score), BLOCK))
            good = (high + bound >= least - 1e-9)[self.block[r]]
            r, weight = r[good], weight[good]
            n = self.at[r + 1] - self.at[r]
            p = ragged(self.at[r], n)
            score += np.bincount(self.example[p], self.weight[p] * np.repeat(weight, n), minlength=len(score))
            if skip >= 0:
                score[skip] = 0
        score = np.round(score, 12)
        least = max(np.partition(score, -self.k)[-self.k], 1e-12) if len(score) > self.k else 1e-12
        found = np.flatnonzero(score >= least)
        found = found[np.lexsort((found, -score[found]))]
        return found, score[found]

    def vote(self, t: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, cosine = self.nearest(t, w, skip)
        power = cosine**2 * self.stands[found]
        if len(found) > self.k:
            tied = cosine == cosine[-1]
            power[tied] *= (self.k - (~tied).sum()) / tied.sum()
        return float((power @ self.label[found] + 0.3 * self.bare) / (power.sum() + 0.3)), found[: self.k], cosine[: self.k]

    def calibrated(self, vote: float) -> float:
        return float(self.levels[max(int(np.searchsorted(self.edges, vote, side="right")) - 1, 0)]) if len(self.levels) else 0.0

    def unit_vectors(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pointer by text, known terms and their weights in the texts' vectors, at length 1."""
        doc, value, tf = counts(data, off)
        at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
        good = self.vocabulary[at] == value
        return _unit(doc[good], at[good], tf[good], self.factor, len(off) - 1)


def _unit(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, factor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = (1 + np.log(tf)) * factor[term]
    norm = np.sqrt(np.bincount(doc, w * w, minlength=n))
    return np.searchsorted(doc, np.arange(n + 1)), term, w / np.where(norm[doc] > 0, norm[doc], 1)


def build(ids: np.ndarray, label: np.ndarray, doc: np.ndarray, value: np.ndarray, tf: np.ndarray, vocabulary: np.ndarray, df: np.ndarray, total: int, k: int, stands: tuple[float, float] = (1.0, 1.0)) -> Index:
    """The index of examples `ids` (ascending) whose terms `value` stand in `tf` times in texts `doc`; an example of label x stands for stands[x] rows."""
    term = np.searchsorted(vocabulary, value)
    bad = np.bincount(term, label[doc], minlength=len(vocabulary))
    good = np.bincount(term, minlength=len(vocabulary)) - bad
    n_bad, n_good = label.sum(), len(label) - label.sum()
    odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((good + 0.5) / (n_good - good + 0.5))
    evidence = odds**2 / (1 / (bad + 0.5) + 1 / (good + 0.5) + 1 / (n_bad - bad + 0.5) + 1 / (n_good - good + 0.5))
    factor = (np.log((1 + total) / (1 + df)) + 1) * np.maximum(evidence, 1e-6)
    ptr, term, weight = _unit(doc, term, tf, factor, len(ids))
    full = np.flatnonzero(np.diff(ptr) > 0)
    bare = [float((np.diff(ptr) == 0)[label == x].sum()) * stands[x] for x in (0, 1)]
    rate = (bare[1] + 0.5) / (sum(bare) + 10)
    who = np.searchsorted(full, doc)
    by = np.lexsort((who, term))
    p_who, p_term, p_weight = who[by], term[by], weight[by]
    new = np.ones(len(by), bool)
    new[1:] = (p_who[1:] // BLOCK != p_who[:-1] // BLOCK) | (p_term[1:] != p_term[:-1])
    first = np.flatnonzero(new)
    at = np.arange(len(vocabulary) + 1)
    most = np.maximum.reduceat(p_weight, first) if len(first) else p_weight
    t_ptr = np.searchsorted(p_term, at)
    marks = label[full].astype(int)
    index = Index(
        vocabulary, factor, ids[full], marks.astype(float), np.array(stands)[marks], t_ptr, p_who, p_weight, np.searchsorted(p_term[first], at), p_who[first] // BLOCK, most, np.append(first, len(by)),
        np.maximum.reduceat(p_weight, t_ptr[:-1]) if len(by) else p_weight, rate, k, np.zeros(0), np.zeros(0),
    )
    # Calibration: votes of up to about 2,000 examples without themselves, pooled to a monotone function.
    held = list(range(0, len(full), max(1, len(full) // 2000)))
    ptr = np.searchsorted(who, np.arange(len(full) + 1))
    votes = np.array([index.vote(term[ptr[x] : ptr[x + 1]], weight[ptr[x] : ptr[x + 1]], x)[0] for x in held] + [rate])
    truth = np.array([marks[x] for x in held] + [rate])
    mass = np.array([stands[marks[x]] for x in held] + [10.0])
    pools: list[list[float]] = []  # sum, mass, least vote
    for x in np.argsort(votes, kind="stable").tolist():
        pools.append([truth[x] * mass[x], mass[x], votes[x]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, m, _ = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += m
    return index._replace(edges=np.array([p[2] for p in pools]), levels=np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools]))


def toxicity(docs: DataFrame, labels: DataFrame, *, train_mod: int = 5, max_examples: int = 4000, k: int = 15, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` and held_out, score, predicted, neighbours (ids of k examples that vote, best first) and cosines, `prefix` before each name.

    Labels are learnt only from rows whose crc32 of the id as text leaves a remainder by
    `train_mod`. At most `max_examples` of them make the index (half of each label at
    most), whose term counts are what comes to the driver and is broadcast.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % train_mod != 0)
    rows_of = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = []
    for mark in (0, 1):
        picked += known.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2).collect()
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id long, mark int")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("mark").alias("mark"), F.min("text").alias("text"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in blocks(b.column(2)):
                doc, value, tf = counts(data, off)
                cut = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                own = lambda x, cut=cut: pa.ListArray.from_arrays(cut, pa.array(x, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), own(value.view(np.int64)), own(tf)], ["doc_id", "mark", "terms", "tf"])

    index = None
    if all(rows_of.get(mark) for mark in (0, 1)):
        told = sample.mapInArrow(released(tell), "doc_id long, mark int, terms array<bigint>, tf array<bigint>").toArrow().combine_chunks().sort_by("doc_id")
        ids, mark = told["doc_id"].to_numpy(), told["mark"].to_numpy().astype(float)
        flat = lambda name: told[name].combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(ids)), np.array([len(x) for x in told["terms"]], np.int64)) if len(ids) else np.zeros(0, np.int64)
        value, tf = flat("terms").view(np.uint64), flat("tf")
        vocabulary = np.unique(value)
        if len(vocabulary) and 0 < mark.sum() < len(mark):
            shared_terms = spark.sparkContext.broadcast(vocabulary)

            def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                terms = shared_terms.value
                df, n = np.zeros(len(terms), np.int64), 0
                for b in batches:
                    n += b.num_rows
                    for _, _, data, off in blocks(b.column(0)):
                        found = counts(data, off)[1]
                        at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
                        df += np.bincount(at[terms[at] == found], minlength=len(terms))
                some = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

            rows = plain.select("text").mapInArrow(released(frequency), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
            at, n = rows["term"].to_numpy(), rows["n"].to_numpy()
            df = np.zeros(len(vocabulary), np.int64)
            df[at[at >= 0]] = n[at >= 0]
            # A label's share of the training rows over its share of the examples: 1 while all rows are examples.
            stands = tuple(rows_of[x] / max((mark == x).sum(), 1) * len(mark) / sum(rows_of.values()) for x in (0, 1))
            index = build(ids, mark, doc, value, tf, vocabulary, df, int(n[at < 0].sum()), k, stands)
    shared = spark.sparkContext.broadcast(index)
    added = [prefix + c for c in ("held_out", "score", "predicted", "neighbours", "cosines")]
    docs = docs.drop(*added)
    names = docs.columns
    at = names.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index | None = shared.value
        for b in batches:
            out, who, how = [], [], []
            for i, j, data, off in blocks(b.column(at)):
                if ix is None:
                    out += [0.0] * (j - i)
                    who += [[]] * (j - i)
                    how += [[]] * (j - i)
                    continue
                ptr, t, w = ix.unit_vectors(data, off)
                for a, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                    vote, found, cosine = ix.vote(t[a:e], w[a:e]) if e > a else (ix.bare, np.zeros(0, np.int64), np.zeros(0))
                    out.append(ix.calibrated(vote))
                    who.append(ix.ids[found].tolist())
                    how.append(cosine.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64()), pa.array(who, pa.list_(pa.int64())), pa.array(how, pa.list_(pa.float64()))], [*names, added[1], added[3], added[4]])

    scored = docs.mapInArrow(released(score), extended(docs.schema, f"`{added[1]}` double, `{added[3]}` array<bigint>, `{added[4]}` array<double>"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % train_mod == 0
    return scored.select(*names, held.alias(added[0]), added[1], (F.col(added[1]) >= 0.5).cast("int").alias(added[2]), added[3], added[4])
