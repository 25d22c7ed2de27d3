"""Tree search in lockstep: all questions' trees are a table that goes on by one rollout at a time.

A rollout is one pass of columns down every tree, one batch call of the model for all trees that grow, one
batch call of the judge, and one pass of columns back up. A row holds its tree, which has at most a node a rollout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.sources.store import kept

NODES = "array<struct<id:int,parent:int,level:int,action:string,method:string,next:string,failure:string,response:string,thoughts:array<string>,visits:bigint,q:double>>"

#: What a failure of the parent makes of its next action, and which action follows that.
REPAIRS = {"query_fail": ("query_rewrite", "document_analysis"), "claim_fail": ("evidence_reexamine", "reasoning"), "stop_fail": ("force_continue", "document_analysis")}

#: (rows with question, thoughts, action, method) -> the rows with `response`, or null where the model has none.
Model = Callable[[DataFrame], DataFrame]
#: (rows with question, thoughts, action, method, response, level, node) -> the rows with `failure` and `score`.
Judge = Callable[[DataFrame], DataFrame]


def next_action(action: Column, response: Column, last: Column) -> Column:
    """What follows a response: null where the path ends."""
    has = lambda tag: F.contains(response, F.lit(f"<{tag}>"))
    onward = has("query") | (action == "document_analysis")
    return (
        F.when(last | (action == "answer_generation") | has("answer"), F.lit(None).cast("string"))
        .when(onward & action.isin("begin_reasoning", "reasoning"), "document_analysis")
        .when(onward & (action == "document_analysis"), "reasoning")
        .when(has("evidence"), "reasoning")
    )


def _at(nodes: Column, index: Column) -> Column:
    return F.get(nodes, index)


def descended(nodes: Column, width: int, depth: int, c: float) -> Column:
    """Index of the node where a rollout stops: one that may have another child, ends its path, or is at full depth.

    Down it goes to the child of greatest mean and exploration bonus, unvisited ones before all, the first of equals.
    """

    def step(at: Column, _: Column) -> Column:
        node = _at(nodes, at)
        kids = F.filter(nodes, lambda x: x["parent"] == at)
        bonus = lambda k: F.when(k["visits"] == 0, float("inf")).otherwise(k["q"] + c * F.sqrt(F.log(F.greatest(node["visits"], F.lit(1)).cast("double")) / k["visits"]))
        best = F.array_max(F.transform(kids, lambda k: F.struct(bonus(k).alias("b"), (-k["id"]).alias("k"))))
        onward = node["next"].isNotNull() & (node["level"] < depth) & (F.size(kids) >= width)
        return F.when(onward, -best["k"]).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def way_up(nodes: Column, index: Column, depth: int) -> Column:
    """Indices from a node to its root."""
    start = F.array(index)
    up = lambda way, _: F.when(F.element_at(way, -1) > 0, F.concat(way, F.array(_at(nodes, F.element_at(way, -1))["parent"]))).otherwise(way)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth + 1)), start, up)


def lockstep_search(questions: DataFrame, key: str, model: Model, judge: Judge, *, attributed: bool = True, rollouts: int = 16, width: int = 3, depth: int = 4, c: float = 1.4) -> DataFrame:
    """(key, node, parent, depth, action, method, failure, response, visits, q) of each question's search tree.

    Each rollout adds one child where the descent stops, or values again a node that ends its path; the score is averaged
    into all nodes up to the root. With `attributed`, a parent whose step failed is not just gone on from: a failed
    query is rewritten, failed evidence examined again, and a stop that came too early goes on with a new query, each with
    the action that has to follow. A model without a response there is asked for the normal step, and without one there either
    the tree stays as it is in this rollout. Visits and means are those of :func:`rillstone.operators.trees.tree_search`.
    """
    root = F.struct(
        F.lit(0).alias("id"), F.lit(-1).alias("parent"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("action"), F.lit("normal").alias("method"), F.lit("begin_reasoning").alias("next"),
        F.lit("success").alias("failure"), F.lit(None).cast("string").alias("response"), F.array().cast("array<string>").alias("thoughts"), F.lit(0).cast("bigint").alias("visits"), F.lit(0.0).alias("q"),
    )
    names = [*questions.columns, "nodes"]
    state = questions.withColumn("nodes", F.array(root).cast(NODES))
    repair = lambda which: F.coalesce(*[F.when(F.col("_from.failure") == k, v[which]) for k, v in REPAIRS.items()])
    for _ in range(rollouts):
        found = state.withColumn("_stop", descended(F.col("nodes"), width, depth, c))
        found = found.withColumn("_from", _at(F.col("nodes"), F.col("_stop")))
        grows = F.col("_from.next").isNotNull() & (F.col("_from.level") < depth)
        mended = repair(0) if attributed else F.lit(None).cast("string")
        found = kept(found.withColumns({"_grows": grows, "thoughts": F.col("_from.thoughts"), "action": F.col("_from.next"), "method": F.coalesce(mended, F.lit("normal"))}), "descended")
        asked = model(found.where("_grows"))
        if attributed:
            # Only repairs without a response are asked again, as normal steps.
            asked = kept(asked, "asked")
            again = asked.where("method <> 'normal' and (response is null or response = '')")
            if not again.isEmpty():
                asked = asked.where("method = 'normal' or response <> ''").unionByName(model(again.drop("response").withColumn("method", F.lit("normal"))))
        same = found.where("not _grows").withColumns({"response": F.col("_from.response"), "action": F.col("_from.action"), "method": F.col("_from.method")})
        both = asked.unionByName(same.select(*asked.columns))
        grown = F.col("_grows") & (F.coalesce("response", F.lit("")) != "")
        both = both.withColumn("_grown", grown).withColumn("thoughts", F.when(F.col("_grown"), F.concat("thoughts", F.array("response"))).otherwise(F.col("thoughts")))
        both = both.withColumns({"node": F.when(F.col("_grown"), F.size("nodes")).otherwise(F.col("_stop")), "level": F.col("_from.level") + F.col("_grown").cast("int")})
        # A tree that should have grown but has no response is not valued.
        void = F.col("_grows") & ~F.col("_grown")
        judged = judge(both)
        follows = next_action(F.col("action"), F.col("response"), F.col("level") >= depth)
        if attributed:
            follows = F.coalesce(*[F.when(F.col("method") == v[0], v[1]) for v in REPAIRS.values()], follows)
        child = F.struct(
            F.col("node").alias("id"), F.col("_stop").alias("parent"), F.col("level").alias("level"), F.col("action").alias("action"), F.col("method").alias("method"), follows.alias("next"),
            F.col("failure").alias("failure"), F.col("response").alias("response"), F.col("thoughts").alias("thoughts"), F.lit(0).cast("bigint").alias("visits"), F.lit(0.0).alias("q"),
        )
        nodes = F.when(F.col("_grown"), F.concat("nodes", F.array(child).cast(NODES))).otherwise(F.col("nodes"))
        judged = judged.withColumn("nodes", nodes).withColumn("_way", F.when(~void, way_up(F.col("nodes"), F.col("node"), depth)).otherwise(F.array().cast("array<int>")))

        def valued(x: Column) -> Column:
            q = x["q"] + (F.col("score") - x["q"]) / (x["visits"] + 1)
            return F.when(F.array_contains(F.col("_way"), x["id"]), x.withField("q", q).withField("visits", x["visits"] + 1)).otherwise(x)

        state = kept(judged.withColumn("nodes", F.transform("nodes", valued)).select(*names), "trees")
    n = state.select(key, F.explode("nodes").alias("n"))
    return n.select(key, F.col("n.id").alias("node"), F.col("n.parent").alias("parent"), F.col("n.level").alias("depth"), "n.action", "n.method", "n.failure", "n.response", "n.visits", "n.q")
