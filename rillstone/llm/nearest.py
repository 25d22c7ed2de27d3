"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 11).

Vectors are dealt to cells by their nearest centre (k-means over a bounded sample). Of a vector's
residual to its centre the signs of its randomly rotated components are kept, one bit each,
packed, with three scalars: its squared norm, what the code's inner product is divided by, and the
spread of that estimate. A query's squared distance to a coded vector is estimated from the bits and
the scalars; the estimate errs by more than `eps` spreads only rarely. Of each tile the best estimates are
measured exactly first; then every vector whose lower bound does not pass the k-th of those distances is
measured too, so inside a tile the bounds decide what is read, not a fixed number of candidates.
The rotation is three rounds of sign flips and a Walsh-Hadamard transform over components padded
with zeros to a power of two, so no matrix is sent.

How it is dealt: the index is one pass and a table; a cell of many vectors is split into tiles by the
hash of their ids, and tiles meet the queries that look into their cell in one shuffle, so no side is
broadcast and no table is read again for each block of queries. What is broadcast is the centres and their sample
(`sample_bytes`, at most `max_cells` centres). How many cells a query looks into is found on the
sample: so many that `coverage` of the sample's own neighbours lie in them. Of equal vectors in a tile only the
k + 1 least ids can be in any result, so no others are coded against a query.

Defined results: ids or vectors that are null, vectors that are zero, hold a null or a component that isn't finite,
or are shorter than the longest, take no part. A query is not its own neighbour: no row of its id is. Rows that
repeat an id are one candidate, at its least distance, and one query, by the least vector. Ties go to the smaller id;
fewer candidates than k give as many rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep
from .textkit import tune

FOUND = "query_id long, vec_id long, score double"


class Model(NamedTuple):
    centers: np.ndarray  # (cells, width), double
    flips: np.ndarray  # (3, bits) of -1 and 1
    probes: int


def rotated(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Rows of `x`, padded with zeros, under one random orthogonal map."""
    n, bits = len(x), flips.shape[1]
    y = np.zeros((n, bits))
    y[:, : x.shape[1]] = x
    for flip in flips:
        y *= flip
        h = 1
        while h < bits:
            pair = y.reshape(n, -1, 2, h)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, bits)
            h *= 2
        y /= np.sqrt(bits)
    return y


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]


def fit(sample: np.ndarray, cells: int, k: int = 10, coverage: float = 0.99, seed: int = 11) -> Model:
    """Centres of at most `cells` cells, the rotation, and how many cells cover the sample's own k nearest."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    bits = max(128, 1 << max(width - 1, 1).bit_length())
    flips = rng.choice([-1.0, 1.0], (3, bits))
    sample = sample.astype(np.float64)
    cells = max(1, min(cells, len(sample)))
    centers = sample[rng.choice(len(sample), cells, replace=False)] if len(sample) else np.zeros((1, width))
    if cells == 1 or not len(sample):
        return Model(sample.mean(0, keepdims=True) if len(sample) else centers, flips, 1)
    for _ in range(10):
        own = np.concatenate([_squares(sample[i : i + 4096], centers).argmin(1) for i in range(0, len(sample), 4096)])
        size = np.bincount(own, minlength=cells)
        total = np.zeros_like(centers)
        np.add.at(total, own, sample)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], sample[rng.choice(len(sample), cells)])
    home = np.concatenate([_squares(sample[i : i + 4096], centers).argmin(1) for i in range(0, len(sample), 4096)])
    asked = sample[rng.choice(len(sample), min(256, len(sample)), replace=False)]
    near = np.argsort(_squares(asked, sample), 1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(_squares(asked, centers), 1, kind="stable"), 1)
    at = np.take_along_axis(place, home[near], 1).ravel()
    reached = np.cumsum(np.bincount(at, minlength=cells)) / max(len(at), 1)
    return Model(centers, flips, int(np.searchsorted(reached, coverage - 1e-12)) + 1)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def encode(x: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Of each row: its cell, packed signs, squared norm of the residual, factor of the estimate, and its spread."""
    cell = _squares(x, model.centers).argmin(1)
    residual = x - model.centers[cell]
    y = rotated(residual, model.flips)
    bits = y.shape[1]
    square = (residual * residual).sum(1)
    norm = np.sqrt(square)
    cosine = np.where(norm > 0, np.abs(y).sum(1) / np.sqrt(bits) / np.where(norm > 0, norm, 1), 1.0)
    factor = norm / (cosine * np.sqrt(bits))
    spread = norm * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(bits - 1)
    return cell.astype(np.int32), np.packbits(y >= 0, axis=1), square, factor, spread


def _index(model: Model, width: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                cell, code, *scalars = encode(matrix(b.column(1), width).astype(np.float64), model)
                step = code.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(np.arange(0, code.size + step, step, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), packed, *[pa.array(s.astype(np.float32)) for s in scalars]], ["id", "vector", "cell", "code", "square", "factor", "spread"])

    return run


def _routes(model: Model, sizes: np.ndarray, width: int, least: int):
    """Adds to each query the cells it looks into: the nearest `probes`, and more until they hold `least` vectors."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                order = np.argsort(_squares(matrix(b.column(1), width).astype(np.float64), model.centers), 1, kind="stable").astype(np.int32)
                held = np.cumsum(sizes[order], 1)
                n = np.minimum(np.maximum((held < least).sum(1) + 1, model.probes), len(sizes))
                taken = np.arange(len(sizes))[None] < n[:, None]
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(order[taken]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], ["id", "vector", "cells"])

    return run


def _firsts(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of distinct (id, vector), of equal vectors the `most` least ids."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, s = order[fresh], s[fresh]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return order[rank < most]


def distances(a: np.ndarray, b: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Euclidean distance of rows of `a` and `b`, summed in double precision."""
    out, step = np.empty(len(a)), max(1, block // max(a.shape[1], 1))
    for i in range(0, len(a), step):
        d = a[i : i + step].astype(np.float64) - b[i : i + step].astype(np.float64)
        out[i : i + step] = np.sqrt((d * d).sum(1))
    return out


def _ranked(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k least (score, id) of each `who`, each id once."""
    order = np.lexsort((score, ids, who))
    who, ids, score = who[order], ids[order], score[order]
    once = np.ones(len(who), bool)
    once[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
    who, ids, score = who[once], ids[once], score[once]
    order = np.lexsort((ids, score, who))
    who, ids, score = who[order], ids[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    good = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
    return who[good], ids[good], score[good]


def search_tile(model: Model, cell: int, ids: np.ndarray, x: np.ndarray, code: np.ndarray, square: np.ndarray, factor: np.ndarray, spread: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest of one tile's vectors to each query, by estimates first."""
    at = _firsts(ids, x, k + 1)
    ids, x, code, square, factor, spread = (a[at] for a in (ids, x, code, square, factor, spread))
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    once = len(np.unique(ids)) == len(ids)  # else a k-th distance may belong to fewer than k ids
    found = []
    step = max(1, min(256, (1 << 23) // max(len(ids), 1)))
    for a in range(0, len(q), step):
        own_ids, part = query_ids[a : a + step], q[a : a + step]
        r = part.astype(np.float64) - model.centers[cell]
        rr = (r * r).sum(1)
        estimate = (rotated(r, model.flips).astype(np.float32) @ signs.T) * (-2 * factor)[None] + square[None] + rr.astype(np.float32)[:, None]
        estimate[own_ids[:, None] == ids[None]] = np.inf
        first = min(4 * k, len(ids))
        best = np.argpartition(estimate, first - 1, 1)[:, :first] if first < len(ids) else np.broadcast_to(np.arange(len(ids)), (len(part), len(ids)))
        limit = np.full(len(part), np.inf)
        if once and first >= k:
            d = distances(x[best.ravel()], np.repeat(part, first, 0)).reshape(-1, first)
            d[~np.isfinite(np.take_along_axis(estimate, best, 1))] = np.inf
            limit = np.sort(d, 1)[:, k - 1] ** 2
        bound = (2 * eps * np.sqrt(rr)).astype(np.float32)[:, None] * spread[None] + np.float32(1e-5) * (square[None] + rr.astype(np.float32)[:, None])
        who, place = np.nonzero((estimate - bound <= limit.astype(np.float32)[:, None]) & np.isfinite(estimate))
        who, got, score = _ranked(who, ids[place], distances(x[place], part[who]), k)
        found.append((own_ids[who], got, score))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _search(model: Model, width: int, k: int, eps: float):
    kinds = (pa.int64(), pa.int64(), pa.float64())

    def run(key, tile: pa.Table, asked: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if tile.num_rows and asked.num_rows:
            code = np.frombuffer(b"".join(tile["code"].to_pylist()), np.uint8).reshape(tile.num_rows, -1)
            scalars = [tile[c].to_numpy() for c in ("square", "factor", "spread")]
            out = search_tile(model, key[0].as_py(), tile["id"].to_numpy(), matrix(tile["vector"], width), code, *scalars, asked["id"].to_numpy(), matrix(asked["vector"], width), k, eps)
        return pa.Table.from_arrays([pa.array(a, t) for a, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])

    return run


def valid(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no component that isn't finite, not all zero."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", eps: float = 3.0, coverage: float = 0.99, cell_rows: int = 2048, max_cells: int = 1024, sample_bytes: int = 16 << 20, tile_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each of `queries` the k nearest of `vectors` found, nearest first."""
    spark = vectors.sparkSession
    tune(spark)
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))

    rows = plain(vectors)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, width = stats["n"], stats["d"] or 1
    rows = rows.where(F.size("vector") == width)
    wanted = max(256, sample_bytes // (8 * width))
    share = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(n, 1)))
    sample = rows.where(share).select("vector").limit(2 * wanted).toArrow()["vector"]
    model = fit(matrix(sample, width), min(max_cells, max(1, n // cell_rows)), k, coverage)
    index = keep(rows.mapInArrow(_index(model, width), f"id long, vector array<{kind}>, cell int, code binary, square float, factor float, spread float"), "codes")
    sizes = np.zeros(len(model.centers), np.int64)
    for r in index.groupBy("cell").count().collect():  # a row a cell
        sizes[r["cell"]] = r["count"]
    asked = plain(queries).where(F.size("vector") == width).groupBy("id").agg(F.min("vector").alias("vector"))
    routed = keep(asked.mapInArrow(_routes(model, sizes, width, k + 1), f"id long, vector array<{kind}>, cells array<int>"), "routes")
    asking = np.zeros(len(sizes), np.int64)
    for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        asking[r["cell"]] = r["count"]
    most = max(1, tile_bytes // (8 * width))
    tiles, parts = (F.array([F.lit(int(-(-x // most)) or 1) for x in a]) for a in (sizes, asking))
    whole = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    dealt = index.withColumn("tile", F.pmod(F.xxhash64("id"), F.get(tiles, F.col("cell"))).cast("int")).withColumn("part", whole(F.get(parts, F.col("cell"))))
    looking = routed.select("id", "vector", F.explode("cells").alias("cell"))
    looking = looking.withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell"))).cast("int")).withColumn("tile", whole(F.get(tiles, F.col("cell"))))
    keys = ["cell", "tile", "part"]
    found = dealt.groupBy(*keys).cogroup(looking.groupBy(*keys)).applyInArrow(_search(model, width, k, eps), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
