"""Summaries of answered questions: quality, behaviour, contingency, audits, and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """A ratio rounded half to even, 0 where there is nothing to divide by."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


def _exact(p: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.array_join(g, " ") == F.array_join(p, " ")).cast("double")


def _overlap(p: Column, golds: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, lambda g: T.overlap_f1(p, g))), F.lit(0.0))


def _covered(p: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: T.holds_in_a_row(p, g)).cast("double")


#: Metrics by name: functions of an answer's tokens and of its golds' tokens (an array of arrays).
METRICS: dict[str, Callable[[Column, Column], Column]] = {"em": _exact, "f1": _overlap, "cover": _covered}


def scored(rows: DataFrame, pred: str = "answer", golds: str = "gold", names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """`rows` and the named metrics (em, f1, cover) of each answer against its golds (an array); 0 where there is no answer.

    Tokens are made once, as columns of their own; each metric reads them.
    """
    if unknown := sorted(set(names) - set(METRICS)):
        raise ValueError(f"unknown metrics {unknown}; there are {', '.join(METRICS)}")
    own = rows.withColumn("_p", T.tokens(T.answer_form(F.col(pred)))).withColumn("_g", F.transform(golds, lambda g: T.tokens(T.answer_form(g))))
    some = lambda c: F.when(F.col(pred).isNull(), 0.0).otherwise(c)
    return own.withColumns({name: some(METRICS[name](F.col("_p"), F.col("_g"))) for name in names}).drop("_p", "_g")


def selector_report(steps: DataFrame) -> DataFrame:
    """(selector, n_steps, hit, recall, noise, item_hit_pct, n_items) of steps (selector, item, step, picked, gold).

    An item's golds are those of all its steps together. Items without golds count in no mean, and as not hit.
    """
    gold = steps.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_set("gold"))).alias("_gold"))
    hits = F.size(F.array_intersect(F.array_distinct("picked"), "_gold")).cast("double")
    some = F.size("_gold") > 0
    m = steps.join(gold, "item").select(
        "selector", "item", F.when(some, (hits > 0).cast("double")).alias("h"), F.when(some, hits / F.size("_gold")).alias("r"), F.when(some, F.when(F.size("picked") > 0, 1 - hits / F.size("picked")).otherwise(0.0)).alias("x")
    )
    # Sums by item first, so that a selector of very many items is combined on the way.
    items = m.groupBy("selector", "item").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in ("h", "r", "x") for k, f in (("s", F.sum), ("c", F.count))], F.max(F.coalesce("h", F.lit(0.0))).alias("any"))
    mean = lambda c: F.bround(F.try_divide(F.sum(f"s{c}"), F.sum(f"c{c}")), 4)
    return items.groupBy("selector").agg(F.sum("n").alias("n_steps"), mean("h").alias("hit"), mean("r").alias("recall"), mean("x").alias("noise"), F.bround(F.avg("any") * 100, 1).alias("item_hit_pct"), F.count("*").alias("n_items"))


def summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quality and behaviour of scored results in one pass.

    `rows` has em, f1, cover, answer, error, history (array<struct<evidence>>), latency_s and behavior (struct).
    Denominators are all rows, but for those of forced answers, queries and evidence, which are their own.
    """
    b = lambda name: F.col("behavior")[name]
    n, hist = F.count("*"), F.size("history")
    forced = F.coalesce(b("forced_answer"), F.lit(False))
    valid = F.count_if(forced & F.coalesce(b("forced_answer_valid"), F.lit(False)))
    n_forced = F.count_if(forced)
    total = lambda c, default=0: F.sum(F.coalesce(c, F.lit(default) if isinstance(default, int) else default))
    blank = F.size(F.filter("history", lambda h: F.lower(F.trim(F.coalesce(h["evidence"], F.lit("")))).isin("none", "")))
    mean = lambda c, places: rate(c, n, places)
    answered, over = F.count("answer"), F.count_if(F.col("error") == "max_turns_exceeded")
    budget, bad, failed = F.count_if(b("force_reason") == "search_budget"), F.count_if(F.col("error") == "forced_answer_format_failure"), F.count_if(F.coalesce(b("retrieval_error_count"), F.lit(0)) > 0)
    out = {
        "n_total": n, "n_answered": answered, "n_max_turns_exceeded": over, "n_forced_answer": n_forced, "n_forced_answer_valid": valid, "n_search_budget_hit": budget, "n_format_failures": bad, "n_service_failures": failed,
        "em": mean(F.sum("em"), 4), "cover_em": mean(F.sum("cover"), 4), "f1": mean(F.sum("f1"), 4), "answer_rate": mean(answered, 4), "forced_answer_rate": mean(n_forced, 4), "forced_answer_valid_rate": rate(valid, n_forced),
        "forced_answer_em": rate(F.sum(F.when(forced, F.col("em"))), n_forced), "forced_answer_f1": rate(F.sum(F.when(forced, F.col("f1"))), n_forced), "search_budget_hit_rate": mean(budget, 4),
        "avg_turns": mean(total(b("num_turns"), hist), 3), "avg_logical_searches": mean(total(b("logical_search_count"), hist), 3), "avg_actual_retrieval_rpcs": mean(total(b("actual_retrieval_rpc_count"), F.coalesce(b("actual_search_count"), hist)), 3),
        "avg_reasoner_tokens": mean(total(b("reasoner_token_count")), 3), "avg_evidence_tokens": mean(total(b("evidence_token_count")), 3), "avg_forced_answer_tokens": mean(total(b("forced_answer_token_count")), 3),
        "repeat_query_rate": rate(total(b("exact_duplicate_count"), F.coalesce(b("repeat_count_from_text"), F.lit(0))), total(b("num_queries"), hist)),
        "format_failure_rate": mean(bad, 4), "service_failure_rate": mean(failed, 4), "max_turns_rate": mean(over, 4), "empty_evidence_rate": rate(F.sum(blank), F.sum(hist)), "avg_latency_s": mean(total(F.col("latency_s")), 2),
    }
    return rows.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])


def _at_places(rows: DataFrame, value: Column, places: dict[str, Callable[[Column], Column]], by: Sequence[str], width: float) -> DataFrame:
    """(by, _n, one column a name): values at places (from 0, functions of the group's size) of each group's sorted values.

    Equal values are counted before anything is shuffled, and running counts are taken over buckets of
    values (each `width` wide) first, so no task holds a whole group.
    """
    groups = list(by)
    counts = rows.groupBy(*groups, value.alias("_v")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_b", F.floor(F.col("_v") / width))
    sums = counts.groupBy(*groups, "_b").agg(F.sum("_c").alias("_s"))
    over = Window.partitionBy(*groups).orderBy("_b")
    sums = sums.withColumns({"_before": F.sum("_s").over(over) - F.col("_s"), "_n": F.sum("_s").over(Window.partitionBy(*groups))})
    # Only buckets that hold a wanted place are looked into: at most one a place and group.
    index = {k: f(F.col("_n")).cast("long") for k, f in places.items()}
    wanted = sums.where(F.greatest(*[(F.col("_before") <= i) & (i < F.col("_before") + F.col("_s")) for i in index.values()], F.lit(False)))
    same = [counts[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    named = wanted.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_at"), "_s", "_before", "_n")
    inner = counts.join(F.broadcast(named) if not groups else named, [counts["_b"] == F.col("_at"), *same]).drop("_at", *[f"_g{i}" for i in range(len(groups))])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*groups, "_b").orderBy("_v"))
    inner = inner.withColumn("_upto", upto)
    picks = [F.min(F.when((F.col("_upto") > i) & (F.col("_before") <= i) & (i < F.col("_before") + F.col("_s")), F.col("_v"))) for i in index.values()]
    return inner.groupBy(*groups).agg(F.max("_n").alias("_n"), *[p.alias(k) for p, k in zip(picks, index, strict=True)])


def ranked_value(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), places: int = 3, width: float = 1.0) -> DataFrame:
    """Nearest-rank percentiles: the value at index round((n - 1) q), halves to even, of the sorted values of each group; null is 0."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    found = _at_places(rows, v, {k: lambda n, q=q: F.bround((n - 1) * q) for k, q in shares.items()}, by, width)
    return found.select(*by, *[F.bround(k, places).alias(k) for k in shares])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), width: float = 1.0) -> DataFrame:
    """Exact quantiles of each group, linear between the two values around the place (n - 1) q; nulls don't count."""
    near = {f"{k}_{side}": lambda n, q=q, f=f: f((n - 1) * F.lit(q)) for k, q in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = _at_places(rows.where(F.col(value).isNotNull()), F.col(value).cast("double"), near, by, width)
    between = lambda k, q: F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * ((F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q)))
    return found.select(*by, *[between(k, q).alias(k) for k, q in shares.items()])


# Bootstrap -----------------------------------------------------------------------------
#: Poisson(1) distribution function: a uniform number above its k first values draws more than k times.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
PRIME = 2147483647


def draws(keys, rounds: int, seed: int):
    """How often each key (whole number) is drawn in each round: Poisson(1), from arithmetic that SQL can repeat."""
    import numpy as np

    r = np.arange(rounds, dtype=np.int64)
    x = (np.mod(keys, PRIME)[:, None] * 16807 % PRIME + r[None, :] * 48271 + seed) % PRIME
    for _ in range(3):
        x = (x * (x % 65536 + 1) + 12345) % PRIME
    u = x / float(PRIME)
    return sum((u > e).astype(np.int64) for e in POISSON)


def group_seed(seed: int, pair: str, group: str) -> int:
    from hashlib import sha256

    return int.from_bytes(sha256(f"{seed}:{pair}:{group}".encode()).digest()[:8], "big") % PRIME


def bootstrap_sums(rows: DataFrame, key: str, values: Sequence[str], by: str | None = None, *, rounds: int = 1000, seed: int = 7, pair: str | None = None) -> DataFrame:
    """(group, round, m, one sum of each of `values`): resampled sums of each group.

    A Poisson bootstrap: each row draws its own multiplicity for each round from its key, so rows never
    meet; a task sums its batches in one matrix product and sends `rounds` rows a group. A key that is null or no whole
    number is an error, since such rows would share their draws. `pair` (names of what is compared) gives each group a seed of its
    own: the first eight bytes of the SHA-256 of seed, pair and group.
    """
    import numpy as np
    import pyarrow as pa

    number = F.expr(f"try_cast(`{key}` as bigint)")
    whole = F.when(number.isNull() | (number.cast("double") != F.expr(f"try_cast(`{key}` as double)")), F.raise_error(F.lit("a bootstrap's key is not a whole number")).cast("long")).otherwise(number)
    picked = rows.select((F.col(by).cast("string") if by else F.lit("")).alias("group"), whole.alias("key"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    names = [f"s{i}" for i in range(len(values))]

    def run(batches):
        held: dict[str, object] = {}
        for b in batches:
            groups, keys = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.stack([np.ones(b.num_rows), *[b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(values))]])
            for a in range(0, b.num_rows, 2000):
                for g in np.unique(groups[a : a + 2000]):
                    own = np.flatnonzero(groups[a : a + 2000] == g) + a
                    m = draws(keys[own], rounds, seed if pair is None else group_seed(seed, pair, g))
                    held[g] = held.get(g, 0) + data[:, own] @ m
        for g, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * rounds), pa.array(np.arange(rounds, dtype=np.int64)), *[pa.array(np.asarray(x, float)) for x in sums]], ["group", "round", "m", *names])

    parts = picked.mapInArrow(run, "group string, round bigint, m double, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("group", "round").agg(F.sum("m").alias("m"), *[F.sum(n).alias(n) for n in names])


def tail(value: Column, threshold: float, side: str) -> Column:
    """Add-one share of values at most (le) or at least (ge) the threshold."""
    hit = value <= threshold if side == "le" else value >= threshold
    return (F.count_if(hit) + 1) / (F.count(value) + 1)


def bootstrap_summary(sums: DataFrame, column: str = "s0") -> DataFrame:
    """low and high (2.5 and 97.5 %), and add-one p of a mean of resamples being 0 or less, 0 or more, and two-sided; groups' means count alike."""
    means = sums.where("m > 0").groupBy("round").agg(F.avg(F.col(column) / F.col("m")).alias("mean"))
    le, ge = tail(F.col("mean"), 0.0, "le"), tail(F.col("mean"), 0.0, "ge")
    found = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"), le.alias("p_le"), ge.alias("p_ge"))
    return found.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_le", "p_ge")))


def accepted(deltas: DataFrame, least: float, positive: int = 2, rate_drop: float = 0.02) -> DataFrame:
    """One row: whether mean `delta` reaches `least`, `positive` groups gain, and no group's `rate_delta` falls below -rate_drop."""
    found = deltas.agg(F.avg("delta").alias("macro_delta"), F.count_if(F.col("delta") > 0).alias("n_positive"), F.min("rate_delta").alias("worst_rate"))
    return found.withColumn("passed", (F.col("macro_delta") >= least) & (F.col("n_positive") >= positive) & (F.col("worst_rate") >= -rate_drop))
