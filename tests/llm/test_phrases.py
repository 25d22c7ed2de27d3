"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, score string, n int, rank int"


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in dropped:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, "s", 0, 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def made(seed, n=2500):
    rng = random.Random(seed)
    words = ["a", "B", "ab", "é", "New", "York", "x-y", "梦", "U+2581", "the", "of"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(words))]
    for i in range(n):
        t = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", ""]) for w in rng.choices(words, weights, k=rng.randrange(0, 60)))
        yield t + (" New York city hall" if i % 3 == 0 else ""), rng.choice(["en", "en", "en", None, "und", "fr", ""])


@pytest.mark.parametrize("dictionary_bytes", [64 << 20, 0])
def test_brute_force(spark, dictionary_bytes):
    rows = [*made(1), (None, "en"), ("", "fr"), (" \t.,", None), ("one two " * 3000, "long"), ("ab" * 20000, "long"), ("tie one. " * 30 + "tie two. " * 30, "t")]
    rows += rows[:5]
    got = sorted(tuple(r) for r in P.collocations(table(spark, rows), dictionary_bytes=dictionary_bytes).collect())
    assert got == brute(rows) and len(got) > 40 and {r[0] for r in got} >= {"en", "und", "long", "t"}


def test_top_and_empty(spark):
    rows = list(made(2))
    got = sorted(tuple(r) for r in P.collocations(table(spark, rows), least=5, top=7).collect())
    assert got == brute(rows, 5, 7)
    assert P.collocations(table(spark, rows[:0])).count() == 0 and P.collocations(table(spark, [(None, None), ("x", "y")])).count() == 0


def test_radix_sort_and_runs_over_borders():
    rng = np.random.default_rng(7)
    high, low = rng.integers(1, 1 << 63, 500, np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)
    order = P.radix_order(high, low)
    assert (order == np.lexsort((low, high))).all()
    ids = rng.integers(0, 4, 3000).astype(np.uint32)
    goes_on = rng.random(3000) < 0.9
    plain = Counter()
    for i in range(3000):
        run = []
        for j in range(i, min(i + 4, 3000)):
            if ids[j] == 0 or (j > i and not goes_on[j]):
                break
            run.append(int(ids[j]))
            if len(run) > 1:
                plain[tuple(run)] += 1
    high, low, n = P._added(*P.keyed(ids, goes_on), np.ones(len(P.keyed(ids, goes_on)[0]), np.int64))
    got = Counter()
    for a, b in ((0, 5), (5, 6), (6, len(high))):
        for keys, total in P.counted_runs(high[a:b], low[a:b], n[a:b], 1 << 40):
            got.update({tuple(np.frombuffer(k, ">u4").tolist()): int(t) for k, t in zip(keys.to_pylist(), total, strict=True)})
    border = {k: v for k, v in got.items() if v == plain[k]}
    assert border and all(v <= plain[k] for k, v in got.items())
    whole = Counter()
    for keys, total in P.counted_runs(high, low, n, 1):
        whole.update({tuple(np.frombuffer(k, ">u4").tolist()): int(t) for k, t in zip(keys.to_pylist(), total, strict=True)})
    assert whole == plain
