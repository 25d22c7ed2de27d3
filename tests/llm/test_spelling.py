"""Spelling variants against plain counts and all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rillstone.llm")
from rillstone.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, path string, root string"


def one_edit(s, t):
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t, strict=True)) == 1
    if len(s) > len(t):
        s, t = t, s
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def counts(rows, modulus=199):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % modulus == 0 else w] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def brute(words):
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def typo(w, rng):
    i, c = rng.randrange(len(w)), rng.choice("abé")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéÿ", k=rng.randrange(5, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaab", "Ünïcöde", "straße", "×÷×÷×÷", "x" * 300, "x" * 301]
    words = base + [typo(w, rng) for w in base for _ in range(3)]
    for i in range(600):
        some = rng.choices(base, k=20) + rng.choices(words, k=6)
        yield i % 500, rng.choice([" ", "-", "1", "Ā", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in some)


@pytest.mark.parametrize("limit", [4096, 3])
def test_brute_force(spark, limit):
    rows = [*corpus(1), (None, "nullid word nullid " * 5), (700, None), (701, ""), (702, "12 ; 梦"), (703, "repeat " * 9000), *((710 + k, ("chained" + "xyzu"[:k] + " ") * (6 * 6**k)) for k in range(5))]
    rows += rows[:3]
    df = spark.createDataFrame([(i, t, "w", 1, "p", "r") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in S.variants(df, limit=limit).collect()), key=lambda r: r[0])
    assert got == brute(counts(rows)) and sum(r[1] is not None for r in got) > 20 and any(r[2] not in (r[0], r[1]) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.variants(df).count() == 0


def test_pairs_of_a_group():
    """Rests of every length, short ones too, against all pairs; bounds lose none."""
    rng = random.Random(2)
    for size in (0, 1, 2, 3, 6):
        rests = sorted({"".join(rng.choices("abÿ", k=rng.randrange(size, size + 2))) for _ in range(80)})
        got = sorted(tuple(sorted((rests[i], rests[j]))) for i, j in S.near_pairs(rests))
        assert got == sorted((s, t) for k, s in enumerate(rests) for t in rests[k + 1 :] if one_edit(s, t))


def test_merge_skips_nothing():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9))]
        bound = rng.randrange(1, 5)
        c = Counter(x for one in lists for x in one)
        assert list(S.reaching(lists, bound)) == sorted(x for x, n in c.items() if n >= bound)


def test_checksums_add_up():
    rng = np.random.default_rng(4)
    first, second = [rng.bytes(k) for k in range(40)], [rng.bytes(int(k)) for k in rng.integers(0, 256, 40)]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    got = S.joined_crc(crc(first), crc(second), np.array([len(b) for b in second]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, second, strict=True)]
