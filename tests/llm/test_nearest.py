"""Nearest neighbours by one-bit codes against all distances: recall, error bounds, and awkward rows."""

import math

import numpy as np
import pytest

pytest.importorskip("rillstone.llm")
from pyspark.sql import functions as F

from rillstone.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, score string"


def brute(rows, k=10):
    """{query: [(vec_id, distance)]} by plain loops over valid rows."""
    x = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    width = max((len(v) for _, v in x), default=0)
    x = [(i, v) for i, v in x if len(v) == width]
    out = {}
    for q, v in x:
        if q % 100 == 0:
            best = {}
            for i, w in x:
                if i != q:
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((v - w) ** 2).sum())))
            out[q] = sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], SCHEMA).repartition(3)
    return got(N.nearest(df, df.where(F.col("vec_id") % 100 == 0), **options))


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, rows[3][1]), (200, rows[3][1]), (61, rows[3][1]), (62, None), (63, [0.0] * 8), (64, [math.nan] * 8), (300, [1.0] * 3), (65, [None] * 8), (66, [math.inf] + [0.0] * 7), (None, rows[4][1])]
    rows += [(7, rows[7][1]), (500 + 1, rows[9][1])]
    found, expected = run(spark, rows), brute(rows)
    assert found.keys() == expected.keys()
    for q in expected:
        assert [i for i, _ in found[q]] == [i for i, _ in expected[q]] and np.allclose([d for _, d in found[q]], [d for _, d in expected[q]])
    few = rows[:4]
    assert {q: [i for i, _ in v] for q, v in run(spark, few).items()} == {q: [i for i, _ in v] for q, v in brute(few).items()}
    assert run(spark, []) == {} and run(spark, [(0, None)]) == {} and run(spark, [(0, [1.0, 2.0])]) == {}


def test_many_copies_in_many_tiles(spark):
    """Two thirds of the rows are one vector: ties go to the least ids across tiles."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else rng.standard_normal(4).astype(np.float32).tolist()) for i in range(900)]
    found, expected = run(spark, rows, cell_rows=100, coverage=1.0, tile_bytes=8 * 4 * 64), brute(rows)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall_over_cells(spark, spread):
    """Clusters near and far: at least nine of ten true neighbours are found with cells, tiles and parts of queries."""
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((12, 32)) * spread
    rows = [(i, (middles[i % 12] + rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(6000)]
    found, expected = run(spark, rows, cell_rows=300, tile_bytes=8 * 32 * 200), brute(rows)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert found.keys() == expected.keys() and hits >= 0.95 * sum(map(len, expected.values()))


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((2000, 48)), rng.standard_normal((20, 48))
    model = N.fit(x, 1)
    _, code, square, factor, spread = N.encode(x, model)
    r = q - model.centers[0]
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    estimate = square[None] + (r * r).sum(1)[:, None] - 2 * (N.rotated(r, model.flips) @ signs.T) * factor[None]
    error = np.abs(estimate - ((q[:, None] - x[None]) ** 2).sum(2)) / (2 * np.sqrt((r * r).sum(1))[:, None] * spread[None])
    assert np.mean(error <= 3) > 0.995 and 0.5 < np.sqrt((error**2).mean()) < 1.5
    assert np.allclose(((N.rotated(r, model.flips)) ** 2).sum(1), (r * r).sum(1))
