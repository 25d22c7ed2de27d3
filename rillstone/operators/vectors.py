"""Exact vector search of many queries: corpus cells met only by the queries that they can matter to.

Unit vectors are dealt to the nearest of a few pivots; a cell's or a home's radius is the greatest angle to its pivot. A query's
k-th best product in a sample of the corpus is a floor of its k-th best in all of it. By the triangle inequality of
angles no pair of a home's query and a cell's vector has a greater product than the cosine of what is left between the
pivots less both radii; where that is below the home's least floor, the two never meet. All others meet in tiles of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.sources.store import kept

SLACK = 1e-7


class Cells(NamedTuple):
    pivots: np.ndarray
    sample: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _placed(cells: Cells, width: int, k: int | None):
    """Adds each vector's cell and angle, and with k its floor: the k-th best product in the sample."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column(1), width)
            near = v @ cells.pivots.T
            at = near.argmax(1) if len(v) else np.zeros(0, np.int64)
            columns = [b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(_angles(near[np.arange(len(v)), at]))]
            if k is not None:
                held = v @ cells.sample.T
                floor = np.partition(held, held.shape[1] - k, 1)[:, held.shape[1] - k] if held.shape[1] >= k else np.full(len(v), -2.0)
                columns.append(pa.array(floor))
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "angle", *(["floor"] if k is not None else [])])

    return run


def best_of(ids: np.ndarray, m: np.ndarray, corpus_ids: np.ndarray, v: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, ...]:
    """(query, id, product) of the k best of `v` for each query: products at nine decimals, ties to the lesser id."""
    score, found = best_among([(corpus_ids, v)], m, k, step)
    good = np.isfinite(score)
    return np.repeat(ids, good.sum(1)), found[good], score[good]


def best_among(blocks: Iterable[tuple[np.ndarray, np.ndarray]], m: np.ndarray, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Products and ids of the k best of all (ids, vectors) for each row of `m`; what is wanting has a product of -inf.

    Blocks come one by one, and `step` rows of `m` meet `step` vectors at a time, so only the k best grow with `m`.
    """
    score, found = np.full((len(m), k), -np.inf), np.full((len(m), k), np.iinfo(np.int64).max)
    for corpus_ids, v in blocks:
        for q in range(0, len(m), step):
            s, f = score[q : q + step], found[q : q + step]
            for a in range(0, len(v), step):
                new = np.round(m[q : q + step] @ v[a : a + step].T, 9)
                some, own = np.concatenate([s, new], 1), np.concatenate([f, np.broadcast_to(corpus_ids[a : a + step], new.shape)], 1)
                best = np.lexsort((own, -some), axis=1)[:, :k]
                s, f = np.take_along_axis(some, best, 1), np.take_along_axis(own, best, 1)
            score[q : q + step], found[q : q + step] = s, f
    return score, found


def spread_out(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: each next one is the vector farthest from all before, so that no dense part is without."""
    nearest, picked = np.full(len(sample), -np.inf), []
    for _ in range(min(most, len(sample))):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[picked[-1]])
    return sample[picked]


def bounded_topk(queries: DataFrame, vectors: DataFrame, width: int, k: int, *, pivots: int = 256, sample_bytes: int = 8 << 20, block_bytes: int = 16 << 20) -> tuple[DataFrame, float]:
    """(query_id, id, score) of each tile's k best for each query that it may matter to, and the share of pairs that bounds have spared.

    Both sides are (id, v): unit vectors of `width`. What comes to the driver is a sample of bounded bytes and a row a cell.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    wanted = max(k, sample_bytes // (8 * width))
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(n, 1)))
    table = vectors.where(share).limit(2 * wanted).toArrow()
    sample = _matrix(table["v"], width)
    cells = Cells(spread_out(sample, min(pivots, max(1, n // 64))) if len(sample) else np.zeros((1, width)), sample)
    kinds = "id long, v array<double>, cell int, angle double"
    placed = kept(vectors.mapInArrow(_placed(cells, width, None), kinds), "cells")
    asked = kept(queries.mapInArrow(_placed(cells, width, k), f"{kinds}, floor double"), "homes")
    own = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # a row a cell
    homes = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"), F.min("floor").alias("floor")).collect()
    most = max(1, block_bytes // (8 * width))
    pairs, met, possible = [], 0, 0
    for h in homes:
        for c in own:
            between = 0.0 if h["cell"] == c["cell"] else float(_angles(cells.pivots[h["cell"]] @ cells.pivots[c["cell"]]))
            possible += h["n"] * c["n"]
            if np.cos(max(0.0, between - h["r"] - c["r"])) >= h["floor"] - SLACK:
                met += h["n"] * c["n"]
                pairs.append((h["cell"], c["cell"], -(-h["n"] // most), -(-c["n"] // most)))
    # As many rows as pairs of cells at most, whatever the tables' sizes.
    meets = F.broadcast(spark.createDataFrame(pairs, "home int, cell int, parts int, tiles int"))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    mine = lambda size: F.pmod(F.xxhash64("id"), F.col(size)).cast("int")
    left = placed.select("id", "v", "cell").join(meets, "cell").withColumn("tile", mine("tiles")).withColumn("part", every("parts"))
    right = asked.select("id", "v", F.col("cell").alias("home")).join(meets, "home").withColumn("part", mine("parts")).withColumn("tile", every("tiles"))
    keys = ["home", "cell", "part", "tile"]

    def search(tile: pa.Table, part: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if tile.num_rows and part.num_rows:
            out = best_of(part["id"].to_numpy(), _matrix(part["v"], width), tile["id"].to_numpy(), _matrix(tile["v"], width), k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.select(*keys, "id", "v").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double")
    return found, 1 - met / max(possible, 1)
