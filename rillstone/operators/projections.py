"""Projections of nested run records: what a run did, what it retrieved, a tree's children as jobs, and rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators.trees import climbed

STEP = "struct<query:string,exact_duplicate:boolean,search_executed:boolean,retrieval_error:string,docs:array<struct<title:string,text:string>>>"
#: A run's record as it stands in a trace; every field may be missing.
INFO = (
    f"struct<retrieved_steps:array<{STEP}>,num_turns:bigint,actual_retrieval_rpc_count:bigint,logical_search_count:bigint,finish_reason:string,max_searches:bigint,top_k:bigint,forced_answer:boolean,"
    "forced_answer_valid:boolean,forced_answer_protocol:string,reasoner_token_count:bigint,evidence_token_count:bigint,forced_answer_token_count:bigint,force_reason:string>"
)
TRACE = f"array<struct<rollout_infos:{INFO}>>"


def behavior_of(info: Column, max_turns: int = 6) -> Column:
    """struct of what a run did, from its record (see INFO): recorded counts, or those of its steps where it has none.

    A step was searched unless it says otherwise. Without recorded turns a run counts as exhausted from max_turns - 1 steps on, else
    from max_turns turns; that decides how it finished where the record doesn't say.
    """
    steps = F.coalesce(info["retrieved_steps"], F.array().cast(f"array<{STEP}>"))
    n = F.size(steps).cast("long")
    dup, ran = lambda s: F.coalesce(s["exact_duplicate"], F.lit(False)), lambda s: F.coalesce(s["search_executed"], F.lit(True))
    many = lambda which: F.size(F.filter(steps, which)).cast("long")
    forms = F.filter(F.transform(steps, lambda s: T.query_form(s["query"])), lambda q: q != "")
    repeats = (F.size(forms) - F.size(F.array_distinct(forms))).cast("long")
    searched = F.coalesce(info["actual_retrieval_rpc_count"], many(ran))
    turns = F.coalesce(F.nullif(info["num_turns"], F.lit(0)), n)
    exhausted = F.when(info["num_turns"].isNull(), n >= max(0, max_turns - 1)).otherwise(turns >= max_turns)
    zero = lambda name: F.coalesce(info[name], F.lit(0).cast("long")).alias(name)
    no = lambda name: F.coalesce(info[name], F.lit(False)).alias(name)
    return F.struct(
        turns.alias("num_turns"), n.alias("num_queries"), F.coalesce(info["logical_search_count"], n).alias("logical_search_count"), searched.alias("actual_search_count"), searched.alias("actual_retrieval_rpc_count"),
        many(dup).alias("exact_duplicate_count"), many(lambda s: dup(s) & ~ran(s)).alias("intercepted_repeat_count"), repeats.alias("repeat_count_from_text"), ((many(dup) > 0) | (repeats > 0)).alias("has_exact_duplicate"),
        info["max_searches"].alias("max_searches"), info["top_k"].alias("top_k"), no("forced_answer"), no("forced_answer_valid"), info["forced_answer_protocol"].alias("forced_answer_protocol"),
        zero("reasoner_token_count"), zero("evidence_token_count"), zero("forced_answer_token_count"), info["force_reason"].alias("force_reason"),
        many(lambda s: F.coalesce(s["retrieval_error"], F.lit("")) != "").alias("retrieval_error_count"),
        F.coalesce(F.nullif(info["finish_reason"], F.lit("")), F.when(exhausted, "max_turns_exceeded").otherwise("stopped")).alias("finish_reason"),
    )


def first_steps(trace: Column) -> Column:
    """The steps of the first record in a trace that has a list of them; an empty list without one."""
    lists = F.filter(F.transform(trace, lambda t: t["rollout_infos"]["retrieved_steps"]), lambda x: x.isNotNull())
    return F.coalesce(F.get(lists, F.lit(0)), F.array().cast(f"array<{STEP}>"))


def retrieved_docs(trace: Column) -> Column:
    """All documents of all steps of all records in a trace, in order."""
    some = lambda x, kind: F.coalesce(x, F.array().cast(kind))
    steps = F.flatten(F.transform(some(trace, TRACE), lambda t: some(t["rollout_infos"]["retrieved_steps"], f"array<{STEP}>")))
    return F.flatten(F.transform(steps, lambda s: some(s["docs"], "array<struct<title:string,text:string>>")))


def child_jobs(nodes: DataFrame, thought: Column) -> DataFrame:
    """A row for each child of a node with two or more: (tree, parent, node, parent_q, child_q, n_siblings, q_all_same, response_len, thoughts).

    `nodes` has q and response, too. Thoughts are those of the path from the root down to the child, blank ones left out.
    """
    kids = nodes.where("node <> parent")
    branches = kids.groupBy("tree", "parent").agg(F.count("*").alias("n_siblings"), (F.count_distinct("q") == 1).alias("q_all_same")).where("n_siblings > 1")
    above = nodes.select("tree", F.col("node").alias("parent"), F.col("q").alias("parent_q"))
    roots = nodes.select("tree", F.col("node").alias("root"), F.struct(thought.alias("t")).alias("_r"))
    way = climbed(nodes, F.struct(thought.alias("t"))).join(roots, ["tree", "root"])
    thoughts = F.transform(F.filter(F.concat(F.array("_r"), "way"), lambda x: F.trim(F.coalesce(x["t"], F.lit(""))) != ""), lambda x: x["t"])
    own = kids.select("tree", "parent", "node", F.col("q").alias("child_q"), F.length(F.coalesce("response", F.lit(""))).alias("response_len"))
    jobs = own.join(branches, ["tree", "parent"]).join(above, ["tree", "parent"])
    return jobs.join(way.select("tree", "node", thoughts.alias("thoughts")), ["tree", "node"])


def mean(value: Column) -> Column:
    """The mean of what is neither null nor NaN; null of nothing."""
    return F.avg(F.when(~F.isnan(value), value))


def preference_row(system: Column, user: Column, chosen: Column, rejected: Column) -> Column:
    """struct(status, row) for preference training: ok, empty (one of the two is blank) or equal; row only where ok."""
    text = lambda c: F.coalesce(c, F.lit(""))
    status = F.when((T.squeeze(text(chosen)) == "") | (T.squeeze(text(rejected)) == ""), "empty").when(chosen == rejected, "equal").otherwise("ok")
    row = F.struct(text(system).alias("system"), text(user).alias("instruction"), F.lit("").alias("input"), chosen.alias("chosen"), rejected.alias("rejected"))
    return F.struct(status.alias("status"), F.when(status == "ok", row).alias("row"))


def canonical_answer(answer: Column, gold: Column) -> Column:
    """struct(answer, how) of a step that ends with an answer: the gold in its place, and whether that replaced it, was the same, or is missing; both null for steps without an answer."""
    form = lambda c: F.lower(T.squeeze(F.coalesce(c, F.lit(""))))
    some, known = F.coalesce(answer, F.lit("")) != "", F.coalesce(gold, F.lit("")) != ""
    how = F.when(some, F.when(~known, "missing_gold").when(form(answer) == form(gold), "answer_already_same").otherwise("answer_replaced"))
    return F.struct(F.when(some, F.when(known, gold).otherwise(answer)).alias("answer"), how.alias("how"))
