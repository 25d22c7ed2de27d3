"""Connected groups from candidate edges, and their exact verification.

:func:`components` contracts a graph round by round in DataFrames: nothing of it comes
to the driver. :func:`verified` decides exactly, within candidate components, which
nodes are linked. A component of at most `cap` nodes is decided in one task. A larger
one is dealt into chunks of about `cap`; each chunk is decided, then one node of every
cluster meets the others of its component, and what is still apart from the
component's largest cluster is compared with every chunk in blocks. No task holds more
than a few times `cap` nodes, and no pair that could be a link goes unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep
from .textkit import released


class Forest:
    """Union-find over 0 .. n-1; a tree's root is its least node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> list[int]:
        return [self.find(x) for x in range(len(self.up))]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes, one fewer than nodes a component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    f = Forest(len(nodes))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        f.join(x, y)
    root = np.array(f.roots(), np.int64)
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's edges (of a million at a time)."""
    a = np.zeros(0, np.int64)
    b = np.zeros(0, np.int64)

    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1_000_000:
            a, b = forest(a, b)
            if len(a) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a long, b long); root is some node of its component, one for all."""
    live = keep(edges.select("a", "b").where("a <> b").mapInArrow(released(_thin), "a long, b long").distinct(), "edges")
    if live.isEmpty():
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = None
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "hooks")
        jump = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        up = keep(up.join(jump, "root").select("node", F.col("next").alias("root")), "hooks")
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = keep(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        pa_, pb_ = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = keep(live.join(pa_, "a").join(pb_, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if live.isEmpty():
            return labels


FEW = 12  # nodes of a group up to which its pairs are looked at one by one


def few(n: int, linked: Callable[[int, int], bool], order: np.ndarray, forest: Forest, free: np.ndarray | None) -> None:
    """Joins the linked pairs of a small group, whose nodes stand by size in `order`."""
    place = order.tolist()
    for i in range(n):
        for j in range(i + 1, n):
            if (free is None or free[i] or free[j]) and forest.find(place[i]) != forest.find(place[j]) and linked(i, j):
                forest.join(place[i], place[j])


#: (bodies, sizes, present labels, which may start a pair) -> index pairs that are links between different labels.
Linker = Callable[[list, np.ndarray, Forest, np.ndarray | None], None]


def _decide(frame: DataFrame, keys: list[str], link: Linker, *, start: bool = False) -> DataFrame:
    """(root, node, label) of each group of `frame` (keys, root, node, size, body[, label, loose])."""
    columns = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        done: list[list] = [[], [], []]  # of small groups, some thousand rows to a batch

        def finish() -> None:
            nodes: dict[int, tuple] = {}
            for row in sorted(held, key=lambda r: (r["node"], start and not r["loose"])):
                nodes.setdefault(row["node"], row)
            rows = list(nodes.values())
            f = Forest(len(rows))
            if start:
                first: dict[int, int] = {}
                for i, r in enumerate(rows):
                    f.join(i, first.setdefault(r["label"], i))
            loose = np.array([r["loose"] for r in rows]) if start else None
            link([r["body"] for r in rows], np.array([r["size"] for r in rows], np.int64), f, loose)
            name = [r["label"] if start else r["node"] for r in rows]
            done[0] += [r["root"] for r in rows]
            done[1] += name
            done[2] += [name[x] for x in f.roots()]

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done], ["root", "node", "label"])
            done[:] = [[], [], []]
            return out

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last and held:
                    finish()
                    held = []
                    if len(done[0]) > 4096:
                        yield batch_of()
                last = key
                held.append(row)
        if held:
            finish()
        if done[0]:
            yield batch_of()

    return frame.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(run), "root long, node long, label long")


def verified(ids: DataFrame, fetch: Callable[[DataFrame], DataFrame], link: Linker, *, cap: int = 4096, cap_size: int = 4 << 20) -> DataFrame:
    """(node, label): exact groups of `ids` (root, node, size and what fetch needs).

    fetch gives (root, chunk, node, size, body) of such rows once they have a chunk; it is
    called once, and bodies are shuffled once unless their component is large. A chunk has
    about `cap` nodes, whose sizes come to `cap_size`, at most.
    """
    chunks = F.ceil(F.greatest(F.count("*") / cap, F.sum("size") / cap_size))
    sizes = keep(ids.groupBy("root").agg(chunks.alias("n_chunks")), "component-sizes")
    ids = keep(ids.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int")), "members")
    bodies = keep(fetch(ids).select("root", "chunk", "node", "size", "body"), "bodies")
    first = keep(_decide(bodies, ["root", "chunk"], link), "decided")
    large = ids.where(F.col("n_chunks") > 1).select("root", "node", "size", "n_chunks", "chunk")
    if large.isEmpty():
        return first.select("node", "label")
    text = bodies.select("node", "size", "body")
    clustered = keep(large.join(first.select("node", "label"), "node"), "clusters")
    # One node of each cluster meets the others of its component, again in chunks of at most about cap.
    heads = clustered.where("node = label").select("root", "node", "size")
    n_heads = keep(heads.groupBy("root").agg(chunks.alias("h")), "heads")
    heads = heads.join(n_heads, "root").select("root", "node", F.pmod(F.xxhash64("node"), F.col("h")).cast("int").alias("chunk"))
    second = _decide(text.join(heads, "node").select("root", "chunk", "node", "size", "body"), ["root", "chunk"], link)
    clustered = clustered.join(second.select(F.col("node").alias("label"), F.col("label").alias("label2")), "label").select("root", "node", "size", "n_chunks", "chunk", F.col("label2").alias("label"))
    clustered = keep(clustered, "clusters")
    most = keep(clustered.groupBy("root", "label").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main")), "main")
    clustered = clustered.join(most, "root").withColumn("loose", F.col("label") != F.col("main"))
    loose = clustered.where("loose")
    counted = keep(loose.groupBy("root").agg(chunks.cast("int").alias("blocks")), "blocks")
    # Every loose node meets every chunk: blocks of loose nodes by chunks of all.
    there = clustered.join(counted, "root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("loose", F.lit(False))
    here = loose.join(counted, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks").cast("int") - 1)))
    columns = ["root", "chunk", "block", "node", "label", "loose"]
    met = text.join(here.select(*columns).unionByName(there.select(*columns)), "node").select("root", "chunk", "block", "node", "size", "body", "label", "loose")
    third = _decide(met, ["root", "chunk", "block"], link, start=True)
    merged = components(third.select(F.col("node").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("label"), F.col("root").alias("final"))
    final = clustered.select("node", "label").join(merged, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    small = first.join(large.select("node"), "node", "left_anti").select("node", "label")
    return small.unionByName(final)
