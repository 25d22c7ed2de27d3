"""Queries over question-answering state machines, with fixed rules in place of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.operators import metrics as M
from rillstone.plans.registry import query
from rillstone.streaming import machines as A

# The rule: item i asks i % 5 times, by turns for the even and the odd documents, then answers with the evidence read last; each seventh from 3 on says neither.
# A document is shown by its text's digest; a search finds the first three of their kind, and the first is read.
_K = """d AS (SELECT doc_id % 2 AS kind, md5(min_by(coalesce(text, ''), doc_id)) AS shown FROM documents GROUP BY 1),
 k AS (SELECT item_id, item_id % 5 AS k, item_id % 7 = 3 AS mute, length(coalesce(text, '')) AS size FROM benchmark)"""
_LAST = lambda n: f"coalesce((SELECT shown FROM d WHERE kind = ({n} - 1) % 2), 'nothing')"


def _rule(history, question):
    n = F.size(history)
    last = F.coalesce(F.try_element_at(history, F.lit(-1))["evidence"], F.lit("nothing"))
    asked = F.concat(F.lit("<query>Word "), (n % 2).cast("string"))
    return F.when(F.col("item_id") % 7 == 3, F.lit("thinking")).when(n >= F.col("item_id") % 5, F.concat(F.lit("so <answer>"), last, F.lit("</answer>"))).otherwise(asked)


def _corpus(read):
    kind = F.concat(F.lit("Word "), (F.col("doc_id") % 2).cast("string"))
    return read("documents").select(kind.alias("query"), F.col("doc_id").alias("rank"), F.struct(F.col("source").alias("title"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")).alias("doc"))


def _run(read, **options):
    questions = read("benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))
    return A.cohort(questions, "item_id", _rule, A.lookup(_corpus(read), 3), A.first_line, **options)


@query(f"""WITH {_K} SELECT item_id, CASE WHEN mute OR k > 3 THEN NULL ELSE {_LAST("k")} END AS answer, CASE WHEN mute THEN 'no_query_or_answer' WHEN k > 3 THEN 'max_turns_exceeded' END AS error, CASE WHEN mute THEN 0 ELSE least(k, 4) END::INT AS n_queries, CASE WHEN mute THEN 0 ELSE least(k, 4) END::INT AS n_searched FROM k""")
def cohort_answers(read):
    found = _run(read, max_turns=4)
    return found.select("item_id", "answer", "error", F.size("history").alias("n_queries"), F.size(F.filter("history", lambda h: h["searched"])).alias("n_searched"))


# Noted repeats are not read: their evidence is None.
@query(f"""WITH {_K} SELECT item_id, CASE WHEN mute OR k > 3 THEN NULL WHEN k > 2 THEN 'None' ELSE {_LAST("k")} END AS answer, CASE WHEN mute THEN 0 ELSE least(k, 4) END::INT AS n_queries, CASE WHEN mute THEN 0 ELSE least(k, 2) END::INT AS n_searched, CASE WHEN mute THEN 0 ELSE greatest(least(k, 4) - 2, 0) END::INT AS n_duplicates FROM k""")
def intercepted_duplicates(read):
    found = _run(read, max_turns=4, **A.scheduler("intercepting"))
    return found.select("item_id", "answer", F.size("history").alias("n_queries"), F.size(F.filter("history", lambda h: h["searched"])).alias("n_searched"), F.size(F.filter("history", lambda h: h["duplicate"])).alias("n_duplicates"))


# The forced text answers with the question's length, but each third item's asks again.
@query(f"""WITH {_K}, f AS (SELECT *, mute OR k > 2 AS forced, item_id % 3 <> 0 AS valid, CASE WHEN mute THEN 0 ELSE least(k, 3) END AS n FROM k)
 SELECT item_id, CASE WHEN forced THEN CASE WHEN valid THEN 'about ' || size END ELSE {_LAST("k")} END AS answer, forced, CASE WHEN forced AND NOT valid THEN 'forced_answer_format_failure' END AS error, n AS num_queries, least(n, 2)::BIGINT AS actual, greatest(n - 2, 0)::BIGINT AS repeats,
 (CASE WHEN mute THEN 2 ELSE least(k, 3) + 1 END)::BIGINT AS num_turns, CASE WHEN mute THEN 'invalid_reasoner_format' WHEN forced THEN 'search_budget' END AS reason,
 CASE WHEN NOT forced THEN 'model_answer' WHEN NOT valid THEN 'forced_answer_format_failure' WHEN mute THEN 'forced_answer_after_format_failure' ELSE 'forced_answer_after_search_budget' END AS finish FROM f""")
def budgeted_answers(read):
    force = lambda history, question: F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("So the answer is <answer>about "), F.length(question).cast("string"))).otherwise("<query>more?</query>")
    found = _run(read, **A.scheduler("budgeted", force, 3))
    b = lambda name: F.col("behavior")[name]
    return found.select("item_id", "answer", "forced", "error", b("num_queries").alias("num_queries"), b("actual_retrieval_rpc_count").alias("actual"), b("exact_duplicate_count").alias("repeats"), b("num_turns").alias("num_turns"), b("force_reason").alias("reason"), b("finish_reason").alias("finish"))


@query(f"""WITH {_K}, f AS (SELECT mute OR k > 2 AS forced, item_id % 3 <> 0 AS valid, CASE WHEN mute THEN 0 ELSE least(k, 3) END AS n, CASE WHEN mute THEN 2 ELSE least(k, 3) + 1 END AS turns, mute FROM k)
 SELECT count(*) AS n_total, count(*) FILTER (NOT forced OR valid) AS n_answered, count_if(forced) AS n_forced_answer, count_if(forced AND valid) AS n_forced_answer_valid, count_if(forced AND NOT mute) AS n_search_budget_hit, count_if(forced AND NOT valid) AS n_format_failures,
 round_even(avg(turns), 3) AS avg_turns, round_even(avg(n), 3) AS avg_logical_searches, round_even(avg(least(n, 2)), 3) AS avg_actual_retrieval_rpcs, round_even(sum(greatest(n - 2, 0)) / sum(n), 4) AS repeat_query_rate FROM f""")
def budget_summary(read):
    """What the budget costs: the summary of the metrics over the behavior that the cohort has written."""
    force = lambda history, question: F.when(F.col("item_id") % 3 != 0, F.lit("So the answer is <answer>x")).otherwise("<query>more?</query>")
    found = _run(read, **A.scheduler("budgeted", force, 3)).withColumns({"em": F.lit(0.0), "f1": F.lit(0.0), "cover": F.lit(0.0), "latency_s": F.lit(0.0)})
    names = ["n_total", "n_answered", "n_forced_answer", "n_forced_answer_valid", "n_search_budget_hit", "n_format_failures", "avg_turns", "avg_logical_searches", "avg_actual_retrieval_rpcs", "repeat_query_rate"]
    return M.summary(found).select(*names)


@query("""SELECT conv_id, turn, md5(content[1:CASE WHEN strpos(content, '</answer>') > 0 THEN strpos(content, '</answer>') - 1 ELSE length(content) END]) AS digest, true AS closed FROM (SELECT conv_id, turn, coalesce(text, '') || '</answer>' AS content FROM conversations)""")
def streamed_answers(read):
    """Every text in pieces of seven characters: what the pieces show adds up to the text."""
    c = read("conversations").withColumn("raw", F.concat(F.lit("so <answer>"), F.coalesce("text", F.lit("")), F.lit("</answer>")))
    pieces = F.regexp_extract_all("raw", F.lit("(?s).{1,7}"), F.lit(0))
    e = c.select("conv_id", "turn", A.answer_events(pieces).alias("e"))
    return e.select("conv_id", "turn", F.md5(F.array_join("e.deltas", "").cast("binary")).alias("digest"), F.col("e.done").alias("closed"))


@query("""SELECT count(*) AS n_asked, count(DISTINCT md5(role)) AS n_computed, 0::BIGINT AS n_second FROM conversations""")
def cached_responses(read):
    """Prompts are answered once each: a second run finds every one in the cache."""
    from rillstone.sources.store import fresh_path

    c = read("conversations").select("conv_id", "turn", F.col("role").alias("prompt"))
    path = fresh_path(c.sparkSession, "responses")
    answer = lambda rows: rows.withColumn("response", F.upper("prompt"))
    first, n = A.cached(c, "prompt", answer, path)
    _, again = A.cached(c, "prompt", answer, path)
    return first.agg(F.count("response").alias("n_asked")).select("n_asked", F.lit(n).cast("long").alias("n_computed"), F.lit(again).cast("long").alias("n_second"))
