"""Toxicity against brute-force cosines, ties that no id decides, label rates, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import toxicity as T
from rillstone.llm.textkit import blocks


def vectors(texts):
    (_, _, data, off), *more = blocks(pa.array(texts))
    assert not more
    return T.counts(data, off), (data, off)


def test_neighbours_by_brute_force():
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7))}"
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) + (" vile scum" if i % 7 == 0 else "") for i in range(900)]
    texts += texts[:40]  # copies tie
    (doc, value, tf), _ = vectors(texts)
    label = np.array([float(i % 7 == 0) for i in range(900)] + [float(i % 7 == 0) for i in range(40)])
    vocabulary = np.unique(value)
    df = np.bincount(np.searchsorted(vocabulary, value)) + 3
    ix = T.build(np.arange(940) * 3, label, doc, value, tf, vocabulary, df, 2000, 9)
    full = np.zeros((940, len(vocabulary)))
    full[doc, np.searchsorted(vocabulary, value)] = (1 + np.log(tf)) * ix.factor[np.searchsorted(vocabulary, value)]
    norm = np.linalg.norm(full, axis=1)
    full = full[norm > 0] / norm[norm > 0][:, None]
    asked = texts[:60] + [" ".join(word() for _ in range(30)) + " vile unseen" for _ in range(60)]
    _, (data, off) = vectors(asked)
    ptr, t, w = ix.unit_vectors(data, off)
    for a, e in zip(ptr[:-1], ptr[1:]):
        if e == a:
            continue
        q = np.zeros(len(vocabulary))
        q[t[a:e]] = w[a:e]
        cosine = np.round(full @ q, 10)
        best = np.sort(cosine)[::-1][8]
        found, score = ix.nearest(t[a:e], w[a:e])
        assert set(found.tolist()) == set(np.flatnonzero((cosine >= best) & (cosine > 1e-12)).tolist())
        assert np.allclose(score, np.sort(cosine[found])[::-1], atol=1e-9)


def test_no_id_decides_a_tie(spark):
    rows = [(i, "same words here") for i in range(1, 61)] + [(i, f"fine day {i}") for i in range(61, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for flip in (False, True):  # the same labels, dealt to the copies the other way round
        labels = spark.createDataFrame([(i, int((i > 30) == flip) if i <= 60 else 0) for i in range(1, 200)], "doc_id long, toxic int")
        got.append(T.toxicity(docs, labels, k=5).where("doc_id in (5, 55)").select("score").collect())
    assert got[0][0] == got[0][1] and abs(got[0][0][0] - got[1][0][0]) < 0.15


def test_label_rates_do_not_depend_on_the_sample(spark):
    # One text for both labels, an eighth of it toxic: its score is that rate whether or not the sample is one to one.
    rows = [(i, "same words here" if i % 2 else f"vile scum {i}" if i % 16 == 0 else f"fine day {i}", int(i % 16 in (0, 1))) for i in range(2000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    for most in (8000, 400):
        got = {r["doc_id"]: r for r in T.toxicity(docs, labels, max_examples=most, k=60).where("doc_id < 20").collect()}
        assert got[1]["score"] < 0.35 and got[3]["predicted"] == 0 and got[16]["predicted"] == 1


def test_clashing_names_and_prefix(spark):
    docs = spark.createDataFrame([(1, "a b", 0.25, "x"), (2, None, 0.5, "y"), (2, None, 0.5, "y")], "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert T.toxicity(docs, labels).columns == ["doc_id", "text", "held_out", "score", "predicted", "neighbours", "cosines"]
    kept = T.toxicity(docs, labels, prefix="_").collect()
    assert [r["score"] for r in kept] == [0.25, 0.5, 0.5] and all(0 <= r["_score"] <= 1 for r in kept)
