"""Queries over projections of nested records: runs from conversations, jobs from their trees, training rows and corpus counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import projections as P
from rillstone.operators import trees as G
from rillstone.plans.registry import query
from rillstone.plans.trees import _M, map_nodes

_FORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"


def _traces(read):
    """(conv_id, trace as JSON text): every turn a step; even conversations have no steps in their first record."""
    i, t = F.col("conv_id"), F.col("turn")
    doc = F.array(F.struct(F.col("role").alias("title"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")))
    step = F.struct(
        "turn", F.coalesce("text", F.lit("")).alias("query"), F.when(t % 3 == 1, t % 2 == 1).alias("exact_duplicate"), F.when(t % 4 == 1, False).alias("search_executed"), F.when(t % 5 == 4, "timeout").alias("retrieval_error"), F.when(t % 2 == 0, doc).alias("docs"),
    )
    c = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    info = F.struct(F.col("s").alias("retrieved_steps"), F.when(i % 3 == 0, F.size("s") + 1).alias("num_turns"), F.when(i % 5 == 0, "model_answer").alias("finish_reason"), F.when(i % 7 == 0, F.lit(2)).alias("actual_retrieval_rpc_count"), (i % 4 == 0).alias("forced_answer"))
    blank = F.struct(F.lit(None).cast("array<string>").alias("retrieved_steps"))
    record = lambda x: F.struct(x.alias("rollout_infos"))
    text = F.when(i % 2 == 0, F.concat(F.lit("["), F.to_json(record(blank)), F.lit(","), F.to_json(record(info)), F.lit("]"))).otherwise(F.concat(F.lit("["), F.to_json(record(info)), F.lit("]")))
    return c.select("conv_id", F.from_json(text, P.TRACE).alias("trace"))


@query(rf"""WITH s AS (SELECT conv_id, count(*) AS n, count_if(turn % 4 <> 1) AS ran, count_if(turn % 3 = 1 AND turn % 2 = 1) AS dup, count_if(turn % 3 = 1 AND turn % 2 = 1 AND turn % 4 = 1) AS caught, count_if(turn % 5 = 4) AS errors, count(*) FILTER ({_FORM} <> '') - count(DISTINCT {_FORM}) FILTER ({_FORM} <> '') AS again FROM conversations GROUP BY 1),
 t AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN n + 1 ELSE n END AS turns, CASE WHEN conv_id % 3 = 0 THEN n + 1 >= 6 ELSE n >= 5 END AS exhausted FROM s)
 SELECT conv_id, turns AS num_turns, n AS num_queries, CASE WHEN conv_id % 7 = 0 THEN 2 ELSE ran END AS searched, dup AS duplicates, caught AS intercepted, again AS repeats, dup > 0 OR again > 0 AS repeated, errors, conv_id % 4 = 0 AS forced, CASE WHEN conv_id % 5 = 0 THEN 'model_answer' WHEN exhausted THEN 'max_turns_exceeded' ELSE 'stopped' END AS finish FROM t""")
def run_behaviors(read):
    t = _traces(read).select("conv_id", P.behavior_of(F.element_at("trace", -1)["rollout_infos"]).alias("b"))
    names = {"num_turns": "num_turns", "num_queries": "num_queries", "searched": "actual_search_count", "duplicates": "exact_duplicate_count", "intercepted": "intercepted_repeat_count", "repeats": "repeat_count_from_text", "repeated": "has_exact_duplicate", "errors": "retrieval_error_count", "forced": "forced_answer", "finish": "finish_reason"}
    return t.select("conv_id", *[F.col("b")[v].alias(k) for k, v in names.items()])


@query("""SELECT conv_id, count(*) AS n_steps, count_if(turn % 2 = 0) AS n_docs, md5(coalesce(string_agg(role || ':' || md5(coalesce(text, '')), '|' ORDER BY turn) FILTER (turn % 2 = 0), '')) AS docs FROM conversations GROUP BY 1""")
def run_documents(read):
    """Documents nested four lists deep, and the first list of steps in a trace."""
    d = _traces(read).select("conv_id", P.first_steps(F.col("trace")).alias("s"), P.retrieved_docs(F.col("trace")).alias("d"))
    text = F.array_join(F.transform("d", lambda x: F.concat(x["title"], F.lit(":"), x["text"])), "|")
    return d.select("conv_id", F.size("s").cast("long").alias("n_steps"), F.size("d").cast("long").alias("n_docs"), F.md5(text.cast("binary")).alias("docs"))


def _valued(read):
    return map_nodes(read).withColumn("parent", F.when(F.col("parent") < 0, F.col("node")).otherwise(F.col("parent"))).withColumn("q", (F.length("response") % 3).cast("double"))


@query(f"""WITH RECURSIVE {_M}, v AS (SELECT tree, node, CASE WHEN parent < 0 THEN node ELSE parent END AS parent, response, action, (length(response) % 3)::DOUBLE AS q FROM m), p(tree, node, path) AS (SELECT tree, node, [action] FROM v WHERE node = parent UNION ALL SELECT v.tree, v.node, list_append(p.path, v.action) FROM v JOIN p ON v.tree = p.tree AND v.parent = p.node AND v.node <> v.parent),
 b AS (SELECT tree, parent, count(*) AS n, count(DISTINCT q) = 1 AS same FROM v WHERE node <> parent GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT v.tree, v.node, v.parent, u.q AS parent_q, v.q AS child_q, b.n AS n_siblings, b.same AS q_all_same, length(v.response)::INT AS response_len, array_to_string(p.path, '>') AS thoughts FROM v JOIN b ON v.tree = b.tree AND v.parent = b.parent JOIN v u ON u.tree = v.tree AND u.node = v.parent JOIN p ON p.tree = v.tree AND p.node = v.node WHERE v.node <> v.parent""")
def child_jobs(read):
    """Children of branching nodes, each with its path's thoughts."""
    return P.child_jobs(_valued(read), F.col("action")).withColumn("thoughts", F.array_join("thoughts", ">"))


# Contents are runs of two letters (see sibling_similarity); two that match in nineteen of twenty letters are near duplicates.
@query(f"""WITH {_M}, c AS (SELECT tree, parent, node, length(response) % 3 AS q, length(response) % 60 // 20 AS x, length(response) // 7 % 40 + 30 AS y FROM m WHERE parent >= 0),
 r AS (SELECT a.tree, a.parent, min(2.0 * (least(a.x, b.x) + least(a.y, b.y)) / (a.x + a.y + b.x + b.y)) AS ratio FROM c a JOIN c b ON a.tree = b.tree AND a.parent = b.parent AND a.node < b.node GROUP BY 1, 2), k AS (SELECT tree, parent, count(DISTINCT q) = 1 AS qs, count(DISTINCT (x, y)) = 1 AS cs FROM c GROUP BY 1, 2 HAVING count(*) > 1)
 SELECT qs AS q_same, cs AS content_same, count(*) AS n, count_if(ratio >= 0.95) AS near_duplicates, round_even(count_if(ratio >= 0.95) / count(*), 4) AS near_rate FROM k JOIN r USING (tree, parent) GROUP BY 1, 2""")
def branch_audit(read):
    """Branches by whether values and contents are the same, with near duplicates of each kind."""
    n = F.length("response")
    runs = F.concat(F.repeat(F.lit("a"), F.floor(n % 60 / 20).cast("int")), F.repeat(F.lit("b"), (F.floor(n / 7) % 40 + 30).cast("int")))
    kids = map_nodes(read).where("parent >= 0").withColumns({"runs": runs, "q": n % 3})
    b = G.branch_points(kids.unionByName(kids.select("tree", F.col("parent").alias("node"), F.lit(-1).cast("long").alias("parent"), "response", "action", "runs", "q").dropDuplicates(["tree", "node"]).join(kids.select("tree", "node"), ["tree", "node"], "left_anti")), "q", F.col("runs"))
    s = b.join(G.least_similarity(kids, "runs"), ["tree", "node"])
    near = F.count_if(F.col("similarity") >= 0.95)
    return s.groupBy(F.col("same_value").alias("q_same"), F.col("same_content").alias("content_same")).agg(F.count("*").alias("n"), near.alias("near_duplicates"), F.bround(near / F.count("*"), 4).alias("near_rate"))


@query("""WITH c AS (SELECT conv_id, turn, role, text AS chosen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected FROM conversations), s AS (SELECT *, CASE WHEN trim(regexp_replace(coalesce(chosen, ''), '\\s+', ' ', 'g')) = '' OR trim(regexp_replace(coalesce(rejected, ''), '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN chosen = rejected THEN 'equal' ELSE 'ok' END AS status FROM c)
 SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN md5('you rate|' || role || '|' || chosen || '|' || rejected) END AS digest,
 CASE WHEN turn % 3 = 0 AND chosen <> '' THEN CASE WHEN turn % 2 = 0 THEN 'missing_gold' WHEN lower(trim(regexp_replace(chosen, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(rejected, '\\s+', ' ', 'g'))) THEN 'answer_already_same' WHEN coalesce(rejected, '') = '' THEN 'missing_gold' ELSE 'answer_replaced' END END AS how,
 CASE WHEN turn % 3 = 0 AND chosen <> '' THEN md5(CASE WHEN turn % 2 = 0 OR coalesce(rejected, '') = '' THEN chosen ELSE rejected END) END AS answer FROM s""".replace("\\\\", "\\"))
def preference_rows(read):
    """Rows for preference training, and answers set to their golds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read("conversations").select("conv_id", "turn", "role", F.col("text").alias("chosen"), F.lead("text").over(w).alias("rejected"))
    c = c.withColumn("p", P.preference_row(F.lit("you rate"), F.col("role"), F.col("chosen"), F.col("rejected")))
    answer = F.when(F.col("turn") % 3 == 0, F.col("chosen"))
    c = c.withColumn("a", P.canonical_answer(answer, F.when(F.col("turn") % 2 == 1, F.col("rejected"))))
    row = F.concat_ws("|", "p.row.system", "p.row.instruction", "p.row.chosen", "p.row.rejected")
    return c.select("conv_id", "turn", "p.status", F.when(F.col("p.status") == "ok", F.md5(row.cast("binary"))).alias("digest"), "a.how", F.md5(F.col("a.answer").cast("binary")).alias("answer"))


@query(r"""WITH d AS (SELECT 'base' AS part, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'extend', coalesce(text, '') FROM benchmark), k AS (SELECT *, regexp_replace(t, '\s+', '', 'g') <> '' AS good FROM d)
 SELECT count_if(good AND part = 'base') AS n_base, count_if(good AND part = 'extend') AS n_extend, count_if(good) AS n_total, count_if(NOT good) AS n_skipped_empty, count_if(good AND part = 'base') >= 100 AS base_whole FROM k""")
def corpus_meta(read):
    """What the union of two corpora takes and leaves out, counted while it is made."""
    part = lambda table, name: read(table).select(F.lit(name).alias("part"), (T.collapsed(F.col("text")) != "").alias("some"))
    k = part("documents", "base").unionByName(part("benchmark", "extend"))
    base, extend = F.count_if(F.col("some") & (F.col("part") == "base")), F.count_if(F.col("some") & (F.col("part") == "extend"))
    return k.agg(base.alias("n_base"), extend.alias("n_extend"), F.count_if("some").alias("n_total"), F.count_if(~F.col("some")).alias("n_skipped_empty"), (base >= 100).alias("base_whole"))
