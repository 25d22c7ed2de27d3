"""The suffix tree's scores against a plain model over tuples of words."""

import math
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import suffix_tree_lm as L


def plain(rows, *, context_least, entry_least, divergence, depth, discount=0.5, mod=10):
    """{doc: score} by dictionaries of word tuples."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % mod == 0
    texts = {i: (t or "").lower().split() + [None] for i, t in rows}
    train = [w for i, w in texts.items() if not held(i)]
    count = Counter(t for w in train for t in w)
    n, v = sum(count.values()), len(count)
    root = lambda w: (count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
    frequent = {w for w, c in count.items() if c >= entry_least}
    states = {}  # context -> (left, shares)

    def p(context, w):
        value = root(w)
        for k in range(1, len(context) + 1):
            c = context[len(context) - k :]
            if c not in states:
                break
            left, shares = states[c]
            value = shares.get(w, 0.0) + left * value
        return value

    candidates = {(w,) for w in frequent if w is not None and count[w] >= context_least}
    for k in range(1, depth + 1):
        after = {}
        for w in train:
            for at in range(k, len(w)):
                c = tuple(w[at - k : at])
                if c in candidates and all(c[len(c) - j :] in states for j in range(1, k)):
                    after.setdefault(c, Counter())[w[at]] += 1
        found = {}
        for c, nxt in after.items():
            total = sum(nxt.values())
            known = {w: m for w, m in nxt.items() if m >= entry_least and w in frequent}
            shares = {w: max(m - discount, 0) / total for w, m in known.items()}
            left = max(1 - sum(shares.values()), 1e-12)
            gain = sum(m * math.log((shares[w] + left * p(c[1:], w)) / p(c[1:], w)) for w, m in known.items()) + (total - sum(known.values())) * math.log(left)
            if gain >= divergence * total:
                found[c] = (left, shares)
        longer = {(*c, w) for c, nxt in after.items() for w, m in nxt.items() if m >= context_least and m >= entry_least and w is not None and w in frequent}
        states.update(found)
        candidates = {c for c in longer if c[1:] in states}
    scores = {i: sum(math.log10(p(tuple(w[max(0, at - depth) : at]), w[at])) for at in range(len(w))) for i, w in texts.items()}
    return scores, states


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    phrases = [[f"a{rng.randrange(40)}" for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(12):
            w += rng.choice(phrases) if rng.random() < 0.7 else [f"b{rng.randrange(200)}"]
        rows.append((i, " ".join(w)))
    rows += [(500, ""), (501, None), (502, "unseen words only here")]
    options = {"context_least": 6, "entry_least": 3, "divergence": 0.01, "depth": 4}
    want, states = plain(rows, **options)
    assert max(map(len, states)) == 4 and len({c for c in states if len(c) > 2}) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in L.lm_scores(docs, **options).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_the_tree_is_bounded_by_its_most_frequent(spark):
    rows = [(i, "x y z " * 30 + f"r{i} r{i} r{i} r{i} r{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    corpus, tree = L.train(docs, most=5, context_least=10)
    assert len(corpus.word) <= 5 and tree and all(len(t.entry) <= 5 for t in tree)
    assert all(r["score"] < 0 for r in L.lm_scores(docs, most=5).collect())


@pytest.mark.parametrize("options", [{"most": 12}, {"most": 12, "bucket_tokens": 150}, {"bucket_tokens": 60}])
def test_no_bound_changes_a_score(spark, options):
    """Few numbers for words, or contexts with more tokens after them than a bucket takes: the whole tree's scores all the same."""
    rng = random.Random(9)
    phrases = [[f"a{rng.randrange(30)}" for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(8):
            w += rng.choice(phrases) if rng.random() < 0.7 else ["a1", "a2", f"b{rng.randrange(60)}"]
        rows.append((i, " ".join(w)))
    rows += [(500, ""), (501, None), (None, "a1 a2 unseen"), (502, "a1 a2 b3 unseen")]
    rule = {"context_least": 6, "entry_least": 3, "divergence": 0.01, "depth": 3}
    want, states = plain(rows, **rule)
    assert len(states) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in L.lm_scores(docs, **rule, **options).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_no_row_a_token_or_text(spark, monkeypatch):
    """Heavy contexts of one, two and three words are kept as one row each, and sums come back for many texts at a time."""
    rows = [(i, "p a b c q e b f " * 5 + f"p a b z{i % 7} " * (i % 4) + f"e b q{i % 5}") for i in range(90)]
    rule = {"context_least": 6, "entry_least": 3, "divergence": 0.01, "depth": 3}
    want, _ = plain(rows, **rule)
    kept, real = {}, L.keep

    def keep(df, name):
        out = real(df, name)
        kept.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(L, "keep", keep)
    scored = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), **rule, bucket_tokens=120)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    assert len(kept["lm-heavy"]) == 3 and sum(kept["lm-heavy"]) < 60
