"""Queries over trees: order keys as heap trees (a node's parent is half its key), conversations as maps of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions import scoring as S
from rillstone.functions import text as T
from rillstone.operators import lockstep
from rillstone.operators import trees as G
from rillstone.plans.registry import query

# Whole orders, in one tree; key 0 and 1 are their own parent and a root.
_N = "n AS (SELECT 0 AS tree, o_orderkey AS node, o_orderkey // 2 AS parent, o_totalprice::DOUBLE AS q, o_orderpriority AS content, o_custkey AS visits FROM orders)"


def nodes(read):
    half = F.floor(F.col("o_orderkey") / 2)
    return read("orders").select(F.lit(0).alias("tree"), F.col("o_orderkey").alias("node"), half.alias("parent"), F.col("o_totalprice").cast("double").alias("q"), F.col("o_orderpriority").alias("content"), F.col("o_custkey").alias("visits"))


_PATHS = """p(node, root, depth, path) AS (SELECT node, node, 0, [node] FROM n WHERE node = parent OR parent NOT IN (SELECT node FROM n) UNION ALL SELECT c.node, p.root, p.depth + 1, list_append(p.path, c.node) FROM n c JOIN p ON c.parent = p.node WHERE c.node <> c.parent)"""


@query(f"WITH RECURSIVE {_N}, {_PATHS} SELECT node, root, depth::BIGINT AS depth, array_to_string(path, '/') AS path FROM p")
def tree_paths(read):
    return G.paths(nodes(read)).select("node", "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(f"WITH {_N} SELECT p.node, count(*) AS children, count(DISTINCT c.q) = 1 AS same_value, count(DISTINCT c.content) = 1 AS same_content FROM n p JOIN n c ON c.parent = p.node AND c.node <> c.parent GROUP BY 1 HAVING count(*) >= 2")
def branch_points(read):
    return G.branch_points(nodes(read), "q", F.col("content")).drop("tree")


@query(f"""WITH {_N}, b AS (SELECT p.node, count(DISTINCT round(c.q / 1e5)) = 1 AS qs, count(DISTINCT c.content) = 1 AS cs FROM n p JOIN n c ON c.parent = p.node AND c.node <> c.parent GROUP BY 1 HAVING count(*) >= 2)
 SELECT count(*) AS n, count_if(qs AND cs) AS same_same, count_if(qs AND NOT cs) AS same_differ, count_if(NOT qs AND cs) AS differ_same, count_if(NOT qs AND NOT cs) AS differ_differ, round_even(avg(qs::INT), 4) AS q_same_rate, round_even(avg(cs::INT), 4) AS content_same_rate FROM b""")
def branch_contingency(read):
    b = G.branch_points(nodes(read).withColumn("q", F.round(F.col("q") / 1e5)), "q", F.col("content"))
    q, c = F.col("same_value"), F.col("same_content")
    return b.agg(F.count("*").alias("n"), F.count_if(q & c).alias("same_same"), F.count_if(q & ~c).alias("same_differ"), F.count_if(~q & c).alias("differ_same"), F.count_if(~q & ~c).alias("differ_differ"), F.bround(F.avg(q.cast("double")), 4).alias("q_same_rate"), F.bround(F.avg(c.cast("double")), 4).alias("content_same_rate"))


# Two raters of the same children: the price, and the price where an order is open.
@query(f"""WITH {_N}, r AS (SELECT parent, round(q / 1e5) AS a, CASE WHEN node % 5 <> 0 THEN round(q / 2e5, 1) END AS b FROM n WHERE node <> parent), g AS (SELECT parent, count(DISTINCT a) = 1 AS sa, count(DISTINCT round(b, 4)) = 1 AS sb FROM r WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
 SELECT count(*) AS n_branches, round_even(avg(sa::INT), 4) AS same_a_rate, round_even(avg(sb::INT), 4) AS same_b_rate, count_if(sa AND sb) AS same_both, count_if(sa AND NOT sb) AS same_a_only, count_if(NOT sa AND sb) AS same_b_only, (SELECT count(*) FROM r) AS n_records, (SELECT count(b) FROM r) AS n_rated FROM g""")
def rater_agreement(read):
    r = nodes(read).where("node <> parent").select("parent", F.round(F.col("q") / 1e5).alias("a"), F.when(F.col("node") % 5 != 0, F.round(F.col("q") / 2e5, 1)).alias("b"))
    g = r.where("b is not null").groupBy("parent").agg(F.count("*").alias("n"), (F.count_distinct("a") == 1).alias("sa"), (F.count_distinct(F.round("b", 4)) == 1).alias("sb")).where("n >= 2")
    a, b = F.col("sa"), F.col("sb")
    found = g.agg(F.count("*").alias("n_branches"), F.bround(F.avg(a.cast("double")), 4).alias("same_a_rate"), F.bround(F.avg(b.cast("double")), 4).alias("same_b_rate"), F.count_if(a & b).alias("same_both"), F.count_if(a & ~b).alias("same_a_only"), F.count_if(~a & b).alias("same_b_only"))
    return found.join(r.agg(F.count("*").alias("n_records"), F.count("b").alias("n_rated")))


@query(f"""WITH {_N}, t AS (SELECT node % 10 AS tree, node, parent, q, visits FROM n WHERE node // 2 % 10 = node % 10 OR true), l AS (SELECT t.tree, t.node, t.visits FROM t WHERE q > 100000 AND NOT EXISTS (SELECT 1 FROM t c WHERE c.parent = t.node AND c.node <> c.parent AND c.tree = t.tree))
 SELECT tree, arg_max(node, {{'v': visits, 'o': -node}}) AS node, max(visits) AS visits FROM l GROUP BY 1""")
def best_terminal(read):
    n = nodes(read).withColumn("tree", F.col("node") % 10)
    return G.best_leaf(n, "visits", F.col("q") > 100000, "node")


@query(f"""WITH {_N}, p AS (SELECT * FROM n) SELECT c.node, round(CASE WHEN c.visits = 0 THEN NULL ELSE c.q / 1e5 + 1.4 * sqrt(ln(greatest(p.visits, 1)) / greatest(c.visits, 1)) END, 6) AS uct FROM n c JOIN p ON c.parent = p.node WHERE c.node <> c.parent AND c.visits > 0""")
def uct_scores(read):
    n = nodes(read)
    c = n.where("node <> parent and visits > 0").join(n.select(F.col("node").alias("parent"), F.col("visits").alias("pv")), "parent")
    return c.select("node", F.round(S.uct(F.col("q") / 1e5, F.col("visits"), F.col("pv")), 6).alias("uct"))


# Search in lockstep under fixed rules: what a node says, how its step failed and what it is worth are arithmetic of item and node.
_WIDTH, _DEPTH, _ROLLOUTS = 2, 3, 10
_BONUS = "CASE WHEN x.visits = 0 THEN 1e300 ELSE x.q + 1.4 * sqrt(ln(greatest({p}.visits, 1)) / x.visits) END"


def _down(at: str) -> str:
    node = f"nodes[{at} + 1]"
    best = f"list_sort(list_transform(list_filter(nodes, lambda x: x.parent = {at}), lambda x: {{'b': -({_BONUS.format(p=node)}), 'k': x.id}}))[1].k"
    return f"CASE WHEN {node}.next IS NOT NULL AND {node}.level < {_DEPTH} AND len(list_filter(nodes, lambda x: x.parent = {at})) >= {_WIDTH} THEN {best} ELSE {at} END"


_LOCKSTEP = f"""WITH RECURSIVE r AS (SELECT item_id, 0 AS i, [{{'id': 0, 'parent': -1, 'level': 0, 'action': NULL::VARCHAR, 'method': 'normal', 'next': 'begin_reasoning', 'failure': 'success', 'response': NULL::VARCHAR, 'visits': 0::BIGINT, 'q': 0.0::DOUBLE}}] AS nodes FROM benchmark
 UNION ALL SELECT item_id, i, list_transform(held, lambda x: CASE WHEN x.id = node OR x.id = p1 OR x.id = p2 OR x.id = p3 THEN {{'id': x.id, 'parent': x.parent, 'level': x.level, 'action': x.action, 'method': x.method, 'next': x.next, 'failure': x.failure, 'response': x.response, 'visits': x.visits + 1, 'q': x.q + (score - x.q) / (x.visits + 1)}} ELSE x END) FROM (
 SELECT *, CASE WHEN p2 > 0 THEN held[p2 + 1].parent ELSE -1 END AS p3 FROM (SELECT *, CASE WHEN p1 > 0 THEN held[p1 + 1].parent ELSE -1 END AS p2 FROM (SELECT *, CASE WHEN node > 0 THEN held[node + 1].parent ELSE -1 END AS p1, ((item_id + node * 3) % 10)::DOUBLE / 10.0 AS score FROM (
  SELECT item_id, i, CASE WHEN grows THEN len(nodes) ELSE stop END::INT AS node, CASE WHEN grows THEN list_append(nodes, {{'id': len(nodes)::INT, 'parent': stop::INT, 'level': f.level + 1, 'action': f.next, 'method': method,
    'next': CASE method WHEN 'query_rewrite' THEN 'document_analysis' WHEN 'evidence_reexamine' THEN 'reasoning' WHEN 'force_continue' THEN 'document_analysis' ELSE CASE WHEN f.level + 1 >= {_DEPTH} OR contains(response, '<answer>') THEN NULL WHEN f.next = 'document_analysis' THEN 'reasoning' ELSE 'document_analysis' END END,
    'failure': CASE (item_id * 5 + len(nodes) * 11) % 7 WHEN 1 THEN 'query_fail' WHEN 2 THEN 'claim_fail' WHEN 3 THEN CASE WHEN contains(response, '<answer>') THEN 'success' ELSE 'stop_fail' END ELSE 'success' END, 'response': response, 'visits': 0::BIGINT, 'q': 0.0::DOUBLE}}) ELSE nodes END AS held FROM (
   SELECT *, CASE method WHEN 'query_rewrite' THEN '<query>better ' || h WHEN 'evidence_reexamine' THEN '<evidence>again ' || h WHEN 'force_continue' THEN '<query>more ' || h
     ELSE CASE WHEN f.next = 'document_analysis' THEN '<evidence>e' || h WHEN h = 4 THEN 'so <answer>a' ELSE '<query>w' || h END END AS response FROM (
    SELECT *, CASE f.failure WHEN 'query_fail' THEN CASE WHEN h = 3 THEN 'normal' ELSE 'query_rewrite' END WHEN 'claim_fail' THEN 'evidence_reexamine' WHEN 'stop_fail' THEN 'force_continue' ELSE 'normal' END AS method FROM (
     SELECT *, nodes[stop + 1] AS f, nodes[stop + 1].next IS NOT NULL AND nodes[stop + 1].level < {_DEPTH} AS grows, (item_id * 7 + len(nodes) * 3 + nodes[stop + 1].level) % 5 AS h FROM (
      SELECT item_id, i, nodes, {_down("a2")} AS stop FROM (SELECT *, {_down("a1")} AS a2 FROM (SELECT item_id, i + 1 AS i, nodes, {_down("0")} AS a1 FROM r WHERE i < {_ROLLOUTS})))))))))))
 SELECT item_id, n.id AS node, n.parent AS parent, n.level AS depth, n.action AS action, n.method AS method, n.failure AS failure, n.response AS response, n.visits AS visits, round(n.q, 9) AS q FROM (SELECT item_id, unnest(nodes) AS n FROM r WHERE i = {_ROLLOUTS})"""


def lockstep_rules():
    """A model and a judge as fixed rules over `item_id` and the tree's size."""
    h = (F.col("item_id") * 7 + F.size("nodes") * 3 + F.size("thoughts")) % 5
    with_h = lambda x: F.concat(F.lit(x), h.cast("string"))
    plain = F.when(F.col("action") == "document_analysis", with_h("<evidence>e")).when(h == 4, "so <answer>a").otherwise(with_h("<query>w"))
    said = F.when(F.col("method") == "query_rewrite", F.when(h != 3, with_h("<query>better "))).when(F.col("method") == "evidence_reexamine", with_h("<evidence>again ")).when(F.col("method") == "force_continue", with_h("<query>more ")).otherwise(plain)
    g = (F.col("item_id") * 5 + F.col("node") * 11) % 7
    failure = F.when(g == 1, "query_fail").when(g == 2, "claim_fail").when((g == 3) & ~F.contains("response", F.lit("<answer>")), "stop_fail").otherwise("success")
    return lambda rows: rows.withColumn("response", said), lambda rows: rows.withColumns({"failure": failure, "score": ((F.col("item_id") + F.col("node") * 3) % 10).cast("double") / 10.0})


@query(_LOCKSTEP)
def lockstep_search(read):
    """Failure-attributed search, all items' trees one rollout at a time."""
    model, judge = lockstep_rules()
    found = lockstep.lockstep_search(read("benchmark").select("item_id"), "item_id", model, judge, rollouts=_ROLLOUTS, width=_WIDTH, depth=_DEPTH)
    return found.withColumn("q", F.round("q", 9))


# Conversations as maps of nodes: turn k hangs on turn (k - 1) // 2.
def _maps(read):
    c = read("conversations")
    one = F.struct(F.concat(F.lit("intermediate_node_"), F.col("turn").cast("string")).alias("key"), F.struct(F.floor((F.col("turn") - 1) / 2).alias("parent_id"), F.col("text").alias("response"), F.col("role").alias("action")).alias("value"))
    odd = F.struct(F.lit("summary").alias("key"), F.struct(F.lit(-1).cast("long").alias("parent_id"), F.lit("x").alias("response"), F.lit("x").alias("action")).alias("value"))
    return c.groupBy(F.col("conv_id").alias("tree")).agg(F.map_from_entries(F.concat(F.collect_list(one), F.array(F.first(odd)))).alias("output"))


def map_nodes(read):
    return G.nodes_of(_maps(read), "tree", "output").select("tree", "node", F.col("value.parent_id").alias("parent"), T.ascii_form(F.col("value.response")).alias("response"), F.col("value.action").alias("action"))


_M = r"m AS (SELECT conv_id AS tree, turn AS node, CAST(floor((turn - 1) / 2.0) AS BIGINT) AS parent, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS response, role AS action FROM conversations)"
_UP = "u(tree, node, anc, up) AS (SELECT tree, node, node, 0 FROM m UNION ALL SELECT u.tree, u.node, m.parent, u.up + 1 FROM u JOIN m ON m.tree = u.tree AND m.node = u.anc JOIN m k ON k.tree = m.tree AND k.node = m.parent)"


@query(f"""WITH RECURSIVE {_M}, {_UP}, h AS (SELECT u.tree, u.node, string_agg(m.action, '>' ORDER BY u.up DESC) AS history, bool_or(m.action = 'assistant') AS assisted FROM u JOIN m ON m.tree = u.tree AND m.node = u.anc WHERE u.up > 0 GROUP BY 1, 2)
 SELECT m.tree, m.node, coalesce(history, '') AS history, CASE WHEN m.node % 3 = 2 AND coalesce(assisted, false) THEN 0 ELSE 1 END AS n_gaps FROM m LEFT JOIN h USING (tree, node)""")
def path_history(read):
    n = map_nodes(read)
    seen = G.seen_on_path(n, F.col("action"), "history")
    response = F.when(F.col("node") % 3 == 2, F.lit("so <answer>x</answer>")).otherwise(F.lit("y"))
    gaps = G.open_gaps(F.lit("q"), response, F.array_contains("history", "assistant"))
    return seen.select("tree", "node", F.array_join("history", ">").alias("history"), F.size(gaps).alias("n_gaps"))


@query(f"""WITH RECURSIVE {_M}, d(tree, node, parent, depth) AS (SELECT tree, node, parent, 0 FROM m WHERE parent < 0 UNION ALL SELECT m.tree, m.node, m.parent, d.depth + 1 FROM m JOIN d ON m.tree = d.tree AND m.parent = d.node)
 SELECT tree, string_agg(depth || ':' || node || '<' || parent, ' ' ORDER BY depth, node) AS listed FROM d GROUP BY 1""")
def tree_listing(read):
    n = map_nodes(read)
    return G.serialized(n.join(G.climbed(n).select("tree", "node", "depth"), ["tree", "node"]))


# Texts of a run of one letter and a run of another, by a response's length: two match in the lesser of each run, as one block.
@query(f"""WITH {_M}, c AS (SELECT tree, parent, node, length(response) % 60 AS x, (length(response) // 7 + node) % 40 AS y FROM m WHERE parent >= 0),
 p AS (SELECT a.tree, a.parent, CASE WHEN a.x + a.y + b.x + b.y = 0 THEN 1.0 ELSE 2.0 * (least(a.x, b.x) + least(a.y, b.y)) / (a.x + a.y + b.x + b.y) END AS ratio FROM c a JOIN c b ON a.tree = b.tree AND a.parent = b.parent AND a.node < b.node)
 SELECT tree, parent AS node, round(min(ratio), 9) AS similarity FROM p GROUP BY 1, 2""")
def sibling_similarity(read):
    n = F.length("response")
    runs = F.concat(F.repeat(F.lit("a"), n % 60), F.repeat(F.lit("b"), ((F.floor(n / 7) + F.col("node")) % 40).cast("int")))
    s = G.least_similarity(map_nodes(read).where("parent >= 0").withColumn("runs", runs), "runs")
    return s.select("tree", "node", F.round("similarity", 9).alias("similarity"))


@query()
def tree_search(read):
    """Search trees over the benchmark's items with a fixed rule in place of a model: tested by its invariants."""
    step = lambda state, number: {"text": state["text"][1:] + state["text"][:1], "salt": number}
    worth = lambda state: (sum(map(ord, state["text"][:5])) % 97) / 97.0
    q = read("benchmark").where("text is not null").select("item_id", "text")
    return G.tree_search(q, "item_id", step, worth)
