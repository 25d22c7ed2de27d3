"""Whether runs keep to their protocol: every broken rule as a row, and a summary of each run with its failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.sources.store import kept

RUN = ["config", "dataset"]
#: Fields that a trace must not carry.
GOLD = ("gold", "golden_answers")


def row_rules(protocol: str) -> dict[str, Column]:
    """Which rules a result breaks, by name.

    A result is (config, dataset, id, max_searches, top_k, behavior struct, steps array<struct<search_executed, exact_duplicate,
    retrieval_error, n_docs>>, answer, message_keys array<string>); max_searches and top_k are what its config wants. A step
    that doesn't say so was executed.
    """
    b = lambda name, default=-1: F.coalesce(F.col("behavior")[name].cast("long"), F.lit(default))
    kinds = {"search_executed": "boolean", "exact_duplicate": "boolean", "retrieval_error": "string", "n_docs": "bigint"}
    own = F.transform("steps", lambda s: F.struct(*[s[n].cast(t).alias(n) for n, t in kinds.items()]))
    empty = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in kinds.items())}>>")
    steps = F.when(F.col("steps").isNull(), empty).otherwise(own)
    ran = lambda s: F.coalesce(s["search_executed"], F.lit(True))
    executed, logical, rpc = F.size(F.filter(steps, ran)), b("logical_search_count"), b("actual_retrieval_rpc_count")
    differs = lambda name, want: ~F.col("behavior")[name].eqNullSafe(want)
    forced = F.coalesce(F.col("behavior")["forced_answer"], F.lit(False))
    valid = F.coalesce(F.col("behavior")["forced_answer_valid"], F.lit(False))
    return {
        "wrong_max_searches": differs("max_searches", F.col("max_searches")),
        "wrong_top_k": differs("top_k", F.col("top_k")),
        "wrong_protocol": differs("forced_answer_protocol", F.lit(protocol)),
        "logical_searches": (logical != F.size(steps)) | (logical > F.col("max_searches")),
        "retrieval_calls": (rpc != executed) | (rpc > logical),
        "calls_without_budget": (F.col("max_searches") == 0) & (rpc != 0),
        "duplicate_executed": F.exists(steps, lambda s: F.coalesce(s["exact_duplicate"], F.lit(False)) & ran(s)),
        "documents_found": F.exists(steps, lambda s: ran(s) & (F.coalesce(s["retrieval_error"], F.lit("")) == "") & (F.coalesce(s["n_docs"], F.lit(0)) != F.col("top_k"))),
        "invalid_forced_answer": forced & (~valid | F.col("answer").isNull()),
        "gold_in_trace": F.exists(F.coalesce("message_keys", F.array().cast("array<string>")), lambda k: k.isin(*GOLD)),
    }


def validated(results: DataFrame, expected: DataFrame, protocol: str, max_failure_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(violations, summary) of `results`; `expected` is (config, dataset, rows) of all runs that there have to be.

    Violations are (config, dataset, rule, id or null, n): broken rules of results, and of runs missing_results, row_count, duplicate_ids,
    id_set_differs (from that of the dataset's first config), format_failure_rate and service_failure_rate. The summary
    has each run's counts, means and whether it passed.
    """
    rules = row_rules(protocol)
    b = lambda name: F.coalesce(F.col("behavior")[name].cast("long"), F.lit(0))
    rows = kept(results.withColumn("_broken", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))), "protocol")
    broken = rows.select(*RUN, F.explode("_broken").alias("rule"), F.col("id").cast("string").alias("id"), F.lit(1).cast("long").alias("n"))

    forced = F.coalesce(F.col("behavior")["forced_answer"], F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    runs = rows.groupBy(*RUN).agg(
        F.count("*").alias("n"), count(forced).alias("forced_answers"), count(forced & F.col("behavior")["forced_answer_valid"]).alias("forced_valid"), count(F.col("error") == "forced_answer_format_failure").alias("format_failures"), count(b("retrieval_error_count") > 0).alias("service_failures"),
        F.avg(F.coalesce(F.col("behavior")["logical_search_count"].cast("long"), F.lit(-1))).alias("avg_logical_searches"), F.avg(F.coalesce(F.col("behavior")["actual_retrieval_rpc_count"].cast("long"), F.lit(-1))).alias("avg_actual_retrieval_rpcs"), F.sum(F.size("_broken")).alias("_rows_broken"),
    )
    # Ids: each config's against the first config that has the dataset.
    ids = rows.groupBy(*RUN, "id").agg((F.count("*") - 1).alias("_more"))
    first = ids.groupBy("dataset").agg(F.min("config").alias("_first"))
    sizes = ids.groupBy(*RUN).agg(F.count("*").alias("_ids"), F.sum("_more").alias("_more"))
    own = ids.join(first, "dataset")
    firsts = own.where("config = _first").select(F.col("dataset").alias("_d"), F.col("id").alias("_id"))
    shared = own.join(firsts, (F.col("dataset") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_id")))
    met = shared.groupBy(*RUN).agg(F.count("*").alias("_met"))
    counts = sizes.join(met, RUN, "left").join(first, "dataset")
    reference = sizes.select("dataset", F.col("config").alias("_first"), F.col("_ids").alias("_wanted"))
    counts = counts.join(reference, ["dataset", "_first"]).select(*RUN, "_more", ((F.coalesce("_met", F.lit(0)) != F.col("_ids")) | (F.col("_ids") != F.col("_wanted"))).alias("_other"))
    all_runs = expected.select(*RUN, F.col("rows").alias("_rows")).join(runs, RUN, "left").join(counts, RUN, "left")
    rate = lambda c: F.col(c) / F.col("n") > max_failure_rate
    of_runs = {
        "missing_results": (F.col("n").isNull(), F.lit(1)),
        "row_count": (F.col("n") != F.col("_rows"), F.col("n")),
        "duplicate_ids": (F.col("_more") > 0, F.col("_more")),
        "id_set_differs": (F.col("_other"), F.lit(1)),
        "format_failure_rate": (rate("format_failures"), F.col("format_failures")),
        "service_failure_rate": (rate("service_failures"), F.col("service_failures")),
    }
    checked = all_runs.withColumn("_bad", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("rule"), n.cast("long").alias("n"))) for k, (c, n) in of_runs.items()])))
    checked = kept(checked, "runs")
    whole = checked.select(*RUN, F.explode("_bad").alias("x")).select(*RUN, "x.rule", F.lit(None).cast("string").alias("id"), "x.n")
    passed = (F.size("_bad") == 0) & (F.coalesce("_rows_broken", F.lit(0)) == 0)
    summary = checked.select(*RUN, F.coalesce("n", F.lit(0)).alias("n"), "forced_answers", "forced_valid", "format_failures", "service_failures", "avg_logical_searches", "avg_actual_retrieval_rpcs", passed.alias("passed"))
    return broken.unionByName(whole), summary
