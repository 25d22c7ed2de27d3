"""Search trees: nodes from maps, paths, branch points, what a path has seen, best leaves, serial form, and tree search itself.

Node tables are (tree, node, parent, ...). A root is its own parent or has one that is not in the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.sources.store import kept


def nodes_of(rows: DataFrame, key: str, nodes: str, prefix: str = "intermediate_node_") -> DataFrame:
    """(key, node, value) of a map whose keys end in node numbers; keys without a number are left out."""
    number = F.regexp_extract("k", rf"^{prefix}(\d+)$", 1)
    return rows.select(key, F.explode(nodes).alias("k", "value")).withColumn("node", F.nullif(number, F.lit("")).cast("long")).where("node is not null").select(key, "node", "value")


def climbed(nodes: DataFrame, carried: Column | None = None) -> DataFrame:
    """(tree, node, root, depth[, way]) of every node; `way` has `carried` of the nodes from the root's first child down to the node.

    Pointers double: a node that points `up` steps high takes over the pointer of the node it points at, so after k rounds
    it points 2^k steps high or at its root. A round moves one row a node that has not arrived, with the way it
    has gone, and no pair of node and ancestor. Nodes in or below a cycle never arrive and have no row. Rounds start from written tables.
    """
    own = nodes.select("tree", "node", "parent", *([carried.alias("_c")] if carried is not None else []))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    own = own.join(known, ["tree", "parent"], "left").withColumn("_root", F.col("known").isNull() | (F.col("node") == F.col("parent")))
    way = [F.when(F.col("_root"), F.slice(F.array("_c"), 1, 0)).otherwise(F.array("_c")).alias("way")] if carried is not None else []
    state = kept(own.select("tree", "node", F.when(F.col("_root"), F.col("node")).otherwise(F.col("parent")).alias("far"), (~F.col("_root")).cast("long").alias("up"), F.col("_root").alias("done"), *way), "pointers")
    # A node arrives when what it points at is a root; roots have arrived.
    arrived, going, rounds = state.where("done"), state.where("not done"), 0
    most = max(1, state.count()).bit_length() + 1
    while rounds <= most and not going.isEmpty():
        every = arrived.unionByName(going)
        on = every.select("tree", F.col("node").alias("far"), F.col("far").alias("_far"), F.col("up").alias("_up"), F.col("done").alias("_done"), *([F.col("way").alias("_way")] if way else []))
        moved = going.join(on, ["tree", "far"]).select("tree", "node", F.col("_far").alias("far"), (F.col("up") + F.col("_up")).alias("up"), F.col("_done").alias("done"), *([F.concat("_way", "way").alias("way")] if way else []))
        moved = kept(moved, "pointers")
        arrived, going, rounds = arrived.unionByName(moved.where("done")), moved.where("not done"), rounds + 1
    return arrived.select("tree", "node", F.col("far").alias("root"), F.col("up").alias("depth"), *(["way"] if way else []))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, node, root, depth, path): path is the nodes from the root down."""
    return climbed(nodes, F.col("node")).select("tree", "node", "root", "depth", F.concat(F.array("root"), "way").alias("path"))


def branch_points(nodes: DataFrame, value: str, content: Column, least: int = 2) -> DataFrame:
    """(tree, node, children, same_value, same_content) of nodes with `least` children or more."""
    kids = nodes.where("node <> parent").groupBy("tree", F.col("parent").alias("node"))
    found = kids.agg(F.count("*").alias("children"), (F.count_distinct(value) == 1).alias("same_value"), (F.count_distinct(content) == 1).alias("same_content")).where(F.col("children") >= least)
    return found.join(nodes.select("tree", "node"), ["tree", "node"], "left_semi")


def least_similarity(nodes: DataFrame, content: str, *, tile: int = 128) -> DataFrame:
    """(tree, node, similarity): the least Ratcliff-Obershelp ratio of any two children of a node with two or more, the one of lesser number first.

    Equal texts are one, with the first and the last child that has it. Texts of a node are dealt into tiles of about `tile`, and
    two tiles meet in one task's group, so a node of very many children is spread and no pair is a row. In a group, pairs
    whose ratio is known to be no less than the least one so far are left out: no common character makes it 0 at once, and
    a text within another of under 200 characters (longer ones have junk) gives its ratio by their lengths.
    """
    import pyarrow as pa

    kids = nodes.where("node <> parent").select("tree", F.col("parent").alias("at"), "node", F.coalesce(content, F.lit("")).alias("text"))
    texts = kept(kids.groupBy("tree", "at", "text").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")), "texts")
    sizes = texts.groupBy("tree", "at").agg(F.count("*").alias("kinds"), F.sum("n").alias("children"), F.max("n").alias("most")).where("children > 1")
    rows = texts.join(sizes, ["tree", "at"]).where("kinds > 1").withColumn("tiles", F.ceil(F.col("kinds") / tile))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("text"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = rows.select("tree", "at", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "text", "first", "last").withColumn("group", F.struct("tree", "at", "a", "b"))

    def least(group: list[tuple]) -> float:
        from difflib import SequenceMatcher

        best, across = 1.0, group[0][0]["a"] != group[0][0]["b"]
        letters = [set(g[2]) for g in group]
        for j, (_, own, right, _, right_last) in enumerate(group):
            matcher = SequenceMatcher(None)
            matcher.set_seq2(right)  # what is prepared for the second text serves all first ones
            for i, (_, other, left, left_first, _) in enumerate(group):
                if i == j or (across and own == other) or left_first > right_last:
                    continue
                if not letters[i] & letters[j]:
                    return 0.0
                # A text within the other matches whole (in texts too short to have junk): that can't be less than the least so far.
                if len(right) < 200 and left in right and 2 * len(left) / (len(left) + len(right)) >= best:
                    continue
                matcher.set_seq1(left)
                best = min(best, matcher.ratio())
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[0][0]:
                    found.append((held[0][0]["tree"], held[0][0]["at"], least(held)))
                    held = []
                held.append(row)
        if held:
            found.append((held[0][0]["tree"], held[0][0]["at"], least(held)))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["tree", "node", "similarity"])

    dealt = dealt.withColumn("group", F.struct(F.col("tree").cast("long").alias("tree"), F.col("at").cast("long").alias("at"), "a", "b"))
    parts = dealt.select("group", "own", "text", "first", "last").repartition("group").sortWithinPartitions("group").mapInArrow(run, "tree long, node long, similarity double")
    # Equal texts alone are all alike; beside others a ratio of 1 changes nothing.
    alike = sizes.where("kinds = 1").select(F.col("tree").cast("long").alias("tree"), F.col("at").cast("long").alias("node"), F.lit(1.0).alias("similarity"))
    return parts.unionByName(alike).groupBy("tree", "node").agg(F.min("similarity").alias("similarity"))


def best_leaf(nodes: DataFrame, visits: str, answered: Column, order: str) -> DataFrame:
    """(tree, node, visits): of each tree's answered leaves the most visited one; the first in `order` of equals."""
    leaves = nodes.join(nodes.where("node <> parent").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    return leaves.where(answered).groupBy("tree").agg(F.max_by("node", F.struct(F.col(visits), -F.col(order))).alias("node"), F.max(visits).alias("visits"))


def serialized(nodes: DataFrame, depth: str = "depth") -> DataFrame:
    """(tree, listed): nodes as level:node<parent, breadth first, joined by spaces."""
    one = F.concat(F.col(depth).cast("string"), F.lit(":"), F.col("node").cast("string"), F.lit("<"), F.col("parent").cast("string"))
    return nodes.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(depth, "node", one.alias("one")))), lambda x: x["one"]), " ").alias("listed"))


def tree_search(questions: DataFrame, key: str, expand: Callable[[dict, int], dict], value: Callable[[dict], float], *, rollouts: int = 16, width: int = 3, depth: int = 4, c: float = 1.4) -> DataFrame:
    """(key, node, parent, depth, visits, q): upper-confidence tree search for each row of `questions`.

    Each rollout goes down by the greatest mean and exploration bonus, adds one child, values it and updates
    means up to the root. `expand(parent, number)` makes a child's state and `value(state)` scores it; a row's search is
    sequential by nature, rows are independent, so it runs in Arrow batches with a bounded tree a row.
    """
    import math

    import pyarrow as pa

    names = questions.columns

    def search(row: dict) -> Iterator[tuple]:
        states, parent, kids, level, n, q = [row], [-1], [[]], [0], [0], [0.0]
        for _ in range(rollouts):
            at = 0
            while level[at] < depth and len(kids[at]) >= width:
                at = max(kids[at], key=lambda k: float("inf") if n[k] == 0 else q[k] + c * math.sqrt(math.log(max(n[at], 1)) / n[k]))
            if level[at] >= depth:
                child = at  # a leaf at full depth is valued again
            else:
                child = len(states)
                states.append(expand(states[at], child))
                parent.append(at)
                kids.append([])
                kids[at].append(child)
                level.append(level[at] + 1)
                n.append(0)
                q.append(0.0)
            v = value(states[child])
            while child >= 0:
                n[child] += 1
                q[child] += (v - q[child]) / n[child]
                child = parent[child]
        return zip(range(len(states)), parent, level, n, q, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row[key], *x) for row in b.to_pylist() for x in search(row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], [key, "node", "parent", "depth", "visits", "q"])

    return questions.select(*names).withColumn(key, F.col(key).cast("long")).mapInArrow(run, f"{key} bigint, node bigint, parent bigint, depth bigint, visits bigint, q double")


def open_gaps(question: Column, response: Column, evidence_before: Column) -> Column:
    """No gap once an answer follows stated evidence; else the question."""
    return F.when(F.contains(response, F.lit("<answer>")) & evidence_before, F.array().cast("array<string>")).otherwise(F.array(question))


def seen_on_path(nodes: DataFrame, value: Column, name: str) -> DataFrame:
    """(tree, node, name): the values that are not null of a node's ancestors, from the root down, without its own."""
    way = climbed(nodes, F.struct(value.alias("v")))
    roots = nodes.select("tree", F.col("node").alias("root"), F.struct(value.alias("v")).alias("_r"))
    above = F.when(F.col("depth") > 0, F.concat(F.array("_r"), F.slice("way", 1, F.size("way") - 1))).otherwise(F.slice(F.array("_r"), 1, 0))
    values = F.transform(F.filter(above, lambda x: x["v"].isNotNull()), lambda x: x["v"])
    got = way.join(roots, ["tree", "root"]).select("tree", "node", values.alias(name))
    return nodes.select("tree", "node").join(got, ["tree", "node"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
