"""Queries over answers: quality and behaviour summaries, percentiles, bootstrap intervals, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators import metrics as M
from rillstone.plans.registry import query

P = r"[!-/:-@\[-`{-~]"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def answer_tokens(x: str) -> str:
    """Tokens of the answer form; RE2 knows ASCII word borders only, so articles go by token."""
    return f"list_filter(string_split({squeeze(f"regexp_replace(lower(coalesce({x}, '')), '{P}', '', 'g')")}, ' '), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


TURNS = "SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations"


def turns(read) -> DataFrame:
    return read("conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))


_OVERLAP = "coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0)"
# Each turn is an answer to score against the next turn; its behaviour comes from its numbers.
_RESULTS = f"""t AS ({TURNS}), k AS (SELECT *, CASE WHEN turn % 5 <> 4 THEN text END AS answer, {answer_tokens('text')} AS pt, {answer_tokens('nxt')} AS gt FROM t WHERE nxt IS NOT NULL),
 r AS (SELECT *, {_OVERLAP} AS o, CASE WHEN turn = 6 THEN 'max_turns_exceeded' WHEN turn = 4 THEN 'forced_answer_format_failure' END AS error, turn % 3 = 1 AS forced, length(text) / 100.0 AS latency,
   CASE WHEN conv_id % 2 = 0 THEN turn + 1 END AS num_turns, CASE WHEN turn % 2 = 0 THEN 'none' ELSE text END AS evidence FROM k),
 s AS (SELECT *, CASE WHEN answer IS NULL THEN 0.0 WHEN pt = gt THEN 1.0 ELSE 0.0 END AS em,
   CASE WHEN answer IS NULL THEN 0.0 WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 WHEN o = 0 THEN 0.0 ELSE 2.0 * o / (len(pt) + len(gt)) END AS f1,
   CASE WHEN answer IS NOT NULL AND len(gt) > 0 AND contains(' ' || array_to_string(pt, ' ') || ' ', ' ' || array_to_string(gt, ' ') || ' ') THEN 1.0 ELSE 0.0 END AS cover FROM r)"""


def results(read) -> DataFrame:
    t = turns(read).where("nxt is not null")
    behavior = F.struct(
        (F.col("turn") % 3 == 1).alias("forced_answer"), (F.col("conv_id") % 3 == 0).alias("forced_answer_valid"), F.when(F.col("turn") % 4 == 1, "search_budget").alias("force_reason"), (F.col("turn") % 2).alias("retrieval_error_count"),
        F.when(F.col("conv_id") % 2 == 0, F.col("turn") + 1).alias("num_turns"), F.lit(None).cast("long").alias("logical_search_count"), F.lit(None).cast("long").alias("actual_retrieval_rpc_count"), F.col("turn").alias("actual_search_count"),
        F.length("text").cast("long").alias("reasoner_token_count"), F.col("turn").alias("evidence_token_count"), F.lit(None).cast("long").alias("forced_answer_token_count"), F.lit(None).cast("long").alias("exact_duplicate_count"),
        (F.col("turn") % 2).alias("repeat_count_from_text"), (F.col("turn") + 1).alias("num_queries"),
    )
    history = F.array(F.struct(F.when(F.col("turn") % 2 == 0, "none").otherwise(F.col("text")).alias("evidence")))
    rows = t.select("conv_id", "turn", "role", F.when(F.col("turn") % 5 != 4, F.col("text")).alias("answer"), F.array("nxt").alias("gold"), F.when(F.col("turn") == 6, "max_turns_exceeded").when(F.col("turn") == 4, "forced_answer_format_failure").alias("error"), history.alias("history"), (F.length("text") / 100.0).alias("latency_s"), behavior.alias("behavior"))
    return M.scored(rows)


_RATE = lambda a, b, n=4: f"coalesce(round_even(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), {n}), 0)"


@query(f"""WITH {_RESULTS} SELECT role, count(*) AS n_total, count(answer) AS n_answered, count(*) FILTER (error = 'max_turns_exceeded') AS n_max_turns_exceeded, count_if(forced) AS n_forced_answer, count_if(forced AND conv_id % 3 = 0) AS n_forced_answer_valid,
 count_if(turn % 4 = 1) AS n_search_budget_hit, count(*) FILTER (error = 'forced_answer_format_failure') AS n_format_failures, count_if(turn % 2 > 0) AS n_service_failures,
 {_RATE('sum(em)', 'count(*)')} AS em, {_RATE('sum(cover)', 'count(*)')} AS cover_em, {_RATE('sum(f1)', 'count(*)')} AS f1, {_RATE('count(answer)', 'count(*)')} AS answer_rate, {_RATE('count_if(forced)', 'count(*)')} AS forced_answer_rate,
 {_RATE('count_if(forced AND conv_id % 3 = 0)', 'count_if(forced)')} AS forced_answer_valid_rate, {_RATE('sum(em) FILTER (forced)', 'count_if(forced)')} AS forced_answer_em, {_RATE('sum(f1) FILTER (forced)', 'count_if(forced)')} AS forced_answer_f1,
 {_RATE('count_if(turn % 4 = 1)', 'count(*)')} AS search_budget_hit_rate, {_RATE('sum(coalesce(num_turns, 1))', 'count(*)', 3)} AS avg_turns, 1.0::DOUBLE AS avg_logical_searches, {_RATE('sum(turn)', 'count(*)', 3)} AS avg_actual_retrieval_rpcs,
 {_RATE('sum(length(text))', 'count(*)', 3)} AS avg_reasoner_tokens, {_RATE('sum(turn)', 'count(*)', 3)} AS avg_evidence_tokens, 0.0::DOUBLE AS avg_forced_answer_tokens, {_RATE('sum(turn % 2)', 'sum(turn + 1)')} AS repeat_query_rate,
 {_RATE("count(*) FILTER (error = 'forced_answer_format_failure')", 'count(*)')} AS format_failure_rate, {_RATE('count_if(turn % 2 > 0)', 'count(*)')} AS service_failure_rate, {_RATE("count(*) FILTER (error = 'max_turns_exceeded')", 'count(*)')} AS max_turns_rate,
 {_RATE("count_if(lower(trim(coalesce(evidence, ''))) IN ('none', ''))", 'count(*)')} AS empty_evidence_rate, {_RATE('sum(latency)', 'count(*)', 2)} AS avg_latency_s FROM s GROUP BY role""")
def answer_quality(read):
    return M.summary(results(read), ["role"])


@query(f"""WITH {_RESULTS} SELECT role, round_even(list_sort(list(latency::DOUBLE))[round_even((count(*) - 1) * 0.5, 0)::INT + 1], 3) AS latency_p50_s, round_even(list_sort(list(latency::DOUBLE))[round_even((count(*) - 1) * 0.95, 0)::INT + 1], 3) AS latency_p95_s FROM s GROUP BY role""")
def answer_latency(read):
    rows = turns(read).where("nxt is not null").select("role", (F.length("text") / 100.0).alias("latency_s"))
    return M.ranked_value(rows, "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95}, ["role"])


@query("""SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.5) AS median, list_sort(list(value))[round_even((count(value) - 1) * 0.95, 0)::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_percentiles(read):
    e = read("events").where("value is not null")
    mean = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return mean.join(M.quantiles(e, "value", {"median": 0.5}, ["event_type"]), "event_type").join(M.ranked_value(e, "value", {"p95": 0.95}, ["event_type"], places=9), "event_type")


# Orders in two halves: a customer's totals stand for a candidate's and a baseline's scores.
_HALVES = """h AS (SELECT o_custkey AS k, c_mktsegment AS grp, coalesce(sum(o_totalprice) FILTER (o_orderkey % 2 = 0), 0)::DOUBLE AS x, coalesce(sum(o_totalprice) FILTER (o_orderkey % 2 = 1), 0)::DOUBLE AS y,
 count_if(o_orderkey % 2 = 0) AS nx, count_if(o_orderkey % 2 = 1) AS ny FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def halves(read) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    o = read("orders").groupBy(F.col("o_custkey").alias("k")).agg(*[F.coalesce(F.sum(F.when(c, F.col("o_totalprice"))), F.lit(0.0)).cast("double").alias(n) for c, n in ((even, "x"), (~even, "y"))], F.count_if(even).alias("nx"), F.count_if(~even).alias("ny"))
    return o.join(read("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("grp")), "k")


def _draw_sql(rounds: int, seed: int | str) -> str:
    step = lambda x: f"(({x} * ({x} % 65536 + 1) + 12345) % {M.PRIME})"
    cases = " + ".join(f"(x3 / {M.PRIME}.0::DOUBLE > {e})::INT" for e in M.POISSON)
    return f"""d0 AS (SELECT h.*, r.range AS round, ((k % {M.PRIME}) * 16807 % {M.PRIME} + r.range * 48271 + {seed}) % {M.PRIME} AS x0 FROM h, range({rounds}) r),
 d1 AS (SELECT *, {step('x0')} AS x1 FROM d0), d2 AS (SELECT *, {step('x1')} AS x2 FROM d1), d3 AS (SELECT *, {step('x2')} AS x3 FROM d2), d AS (SELECT *, {cases} AS m FROM d3)"""


_BOOT = "round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, (count_if(mean <= 0) + 1)::DOUBLE / (count(mean) + 1) AS p_le, (count_if(mean >= 0) + 1)::DOUBLE / (count(mean) + 1) AS p_ge"


@query(f"""WITH {_HALVES}, {_draw_sql(200, 7)}, b AS (SELECT round, sum(m * (x - y)) / sum(m) AS mean FROM d GROUP BY round HAVING sum(m) > 0), o AS (SELECT round(avg(x - y), 6) AS paired_diff, count(*) AS n FROM h), q AS (SELECT {_BOOT} FROM b)
 SELECT n, paired_diff, low, high, round(p_le, 6) AS p_one_sided, round(least(1.0, 2 * least(p_le, p_ge)), 6) AS p_two_sided FROM o, q""")
def paired_bootstrap(read):
    h = halves(read).withColumn("d", F.col("x") - F.col("y"))
    found = M.bootstrap_summary(M.bootstrap_sums(h, "k", ["d"], rounds=200))
    one = h.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("paired_diff"))
    return one.join(found).select("n", "paired_diff", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_le", 6).alias("p_one_sided"), F.round("p_two_sided", 6).alias("p_two_sided"))


_SEED = f"(('0x' || substr(sha256('11:even:odd:' || grp), 1, 16))::UBIGINT % {M.PRIME})::BIGINT"


@query(f"""WITH {_HALVES}, {_draw_sql(200, _SEED)}, g AS (SELECT round, grp, sum(m * (x - y)) / sum(m) AS mean FROM d GROUP BY round, grp HAVING sum(m) > 0), b AS (SELECT round, avg(mean) AS mean FROM g GROUP BY round),
 o AS (SELECT round(avg(delta), 6) AS macro_diff FROM (SELECT grp, avg(x - y) AS delta FROM h GROUP BY grp)), q AS (SELECT {_BOOT} FROM b) SELECT macro_diff, low, high, round(p_le, 6) AS p_one_sided, round(least(1.0, 2 * least(p_le, p_ge)), 6) AS p_two_sided FROM o, q""")
def macro_bootstrap(read):
    h = halves(read).withColumn("d", F.col("x") - F.col("y"))
    found = M.bootstrap_summary(M.bootstrap_sums(h, "k", ["d"], "grp", rounds=200, seed=11, pair="even:odd"))
    one = h.groupBy("grp").agg(F.avg("d").alias("d")).agg(F.round(F.avg("d"), 6).alias("macro_diff"))
    return one.join(found).select("macro_diff", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_le", 6).alias("p_one_sided"), F.round("p_two_sided", 6).alias("p_two_sided"))


@query(f"""WITH {_HALVES}, g AS (SELECT grp, avg(x) / 1e6 - avg(y) / 1e6 AS delta, avg((nx > 0)::INT) - avg((ny > 0)::INT) AS rate_delta FROM h GROUP BY grp), a AS (SELECT avg(delta) AS macro, count_if(delta > 0) AS n_positive, min(rate_delta) AS worst FROM g)
 SELECT round(macro, 6) AS macro_delta, n_positive, round(worst, 6) AS worst_rate, macro >= -0.01 AND n_positive >= 2 AND worst >= -0.02 AS passed FROM a""")
def acceptance_gate(read):
    rate = lambda c: F.avg((F.col(c) > 0).cast("double"))
    g = halves(read).groupBy("grp").agg((F.avg("x") / 1e6 - F.avg("y") / 1e6).alias("delta"), (rate("nx") - rate("ny")).alias("rate_delta"))
    return M.accepted(g, -0.01).select(F.round("macro_delta", 6).alias("macro_delta"), "n_positive", F.round("worst_rate", 6).alias("worst_rate"), "passed")
