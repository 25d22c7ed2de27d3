"""The Jaccard join against brute force: near copies, copies, shared passages, ties and crowded groups."""

import random

import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import jaccard, near


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}, links


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for n in (1, 3, 5, 6, 8, 12, 20, 40, 90, 300, 700):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(base)
            for edits in (0, 1, max(1, n // 40), max(1, n // 28), max(1, n // 15)):
                other = list(base)
                for _ in range(edits):
                    other[rng.randrange(len(other))] = word()
                texts.append(other if rng.random() < 0.7 else other[: max(1, int(len(other) * 0.85))])
    for p in passage:  # unrelated texts that share a passage
        texts += [[word() for _ in range(rng.randrange(5, 200))] + p + [word() for _ in range(20)] for _ in range(25)]
    crowd = [word() for _ in range(80)]  # a large group of near copies
    for k in range(40):
        other = list(crowd)
        other[k] = "x"
        texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"cap": 8, "bucket_entries": 5000}), (3, {"tight": True})])
def test_groups_by_brute_force(spark, monkeypatch, seed, options):
    rows = corpus(seed)
    expect, links = brute(rows)
    assert links > 500
    if options.pop("tight", False):  # every path for crowded shingles
        monkeypatch.setattr(near, "LOCAL", 3)
        monkeypatch.setattr(near, "LARGE", 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, **options).collect()}
    assert got == expect


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (7, "A  b c\nd e f g", None), (None, "a b c d e f g", None), (3, None, None), (4, "", None), (5, "two words", None), (6, "two  words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (7, 3, 1), (None, 3, None), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5)], key=str)
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0
