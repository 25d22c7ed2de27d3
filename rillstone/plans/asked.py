"""Queries over answers of outside models (fixed rules in their place), selectors by item, pairs, chunks and ordered joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.operators import curation as C
from rillstone.operators import metrics as M
from rillstone.operators.scans import dealt
from rillstone.plans.registry import query
from rillstone.sources import formats as X
from rillstone.sources.store import fresh_path
from rillstone.streaming import models as A


def _judge(prompts):
    """Stands for a model: judges by the prompt's length."""
    said = ["It is Correct.", "incorrect", "no idea", '{"error_category": "late", "rationale": "70 of 100"}']
    return [(said[len(p) % 4], len(p), len(said[len(p) % 4])) for p in prompts]


_SAID = "['It is Correct.', 'incorrect', 'no idea', '{\"error_category\": \"late\", \"rationale\": \"70 of 100\"}'][(length(text) % 4 + 1)::INT]"


@query(f"""WITH c AS (SELECT conv_id, turn, text, {_SAID} AS said FROM conversations) SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'ERROR:None' ELSE ['correct', 'incorrect', 'unjudgeable', 'unjudgeable'][(length(text) % 4 + 1)::INT] END AS verdict,
 CASE WHEN length(text) % 4 = 3 THEN 'late' ELSE 'classification_failed' END AS category, CASE WHEN length(text) % 4 = 3 THEN '70 of 100' ELSE 'API error: no JSON object' END AS rationale, CASE WHEN length(text) % 4 = 3 THEN 1.0 END AS value,
 coalesce(length(text), 0) AS tokens_in, coalesce(length(said), 0) AS tokens_out FROM c""")
def judged_answers(read):
    a = A.asked(read("conversations").select("conv_id", "turn", "text"), "text", _judge)
    e = A.error_class(F.col("response"), F.col("failure"))
    a = a.withColumn("e", e)
    return a.select("conv_id", "turn", A.verdict(F.col("response"), F.col("failure")).alias("verdict"), F.col("e.error_category").alias("category"), F.col("e.rationale").alias("rationale"), A.value_of(F.col("response")).alias("value"), "tokens_in", "tokens_out")


@query(f"""WITH c AS (SELECT role, length(text) AS i, length({_SAID}) AS o FROM conversations) SELECT role, count(*) AS n, count_if(i IS NULL) AS n_failed, sum(coalesce(i, 0))::BIGINT AS tokens_in, sum(coalesce(o, 0))::BIGINT AS tokens_out,
 round((sum(coalesce(i, 0)) * 2.5 + sum(coalesce(o, 0)) * 10.0) / 1e6, 6) AS cost, round(count(*) / 60.0, 6) AS calls_per_second, round(sum(coalesce(o, 0)) / 60.0, 6) AS tokens_per_second FROM c GROUP BY 1""")
def model_costs(read):
    a = A.asked(read("conversations").select("role", "text"), "text", _judge)
    return A.costs(a, ["role"], 2.5, 10.0, 60.0)


@query("""WITH p AS (SELECT DISTINCT trim(coalesce(role, '')) AS q, trim(coalesce(text, '')) AS r FROM conversations WHERE trim(coalesce(text, '')) <> '') SELECT substr(sha256(q || chr(10) || '--R3REF--' || chr(10) || r), 1, 32) AS key, md5(upper(q)) AS evidence, length(q || r)::BIGINT AS tokens_in FROM p""")
def distilled_pairs(read):
    """Each distinct pair is asked about once, and none that was answered before."""
    model = lambda prompts: [(f"so <evidence> {p.split(':', 1)[0].upper()} </evidence>", len(p) - 1, 1) for p in prompts]
    c = read("conversations")
    prompt = lambda q, r: F.concat(q, F.lit(":"), r)
    first = A.distilled(c.where("turn % 2 = 0"), "role", "text", prompt, model)
    path = fresh_path(c.sparkSession, "distilled")
    first.write.parquet(path)
    done = c.sparkSession.read.schema(first.schema).parquet(path)
    both = done.unionByName(A.distilled(c, "role", "text", prompt, model, done))
    return both.select("key", F.md5(F.col("evidence").cast("binary")).alias("evidence"), "tokens_in")


# Lines of an order in steps of two: suppliers' kinds are selected, those of lines with a high discount are golds.
_STEPS = """s AS (SELECT l_orderkey AS item, l_linenumber // 2 AS step, l_returnflag AS selector, list_distinct(list('m' || l_suppkey % 7)) AS picked, coalesce(list('m' || l_suppkey % 7) FILTER (l_discount::DOUBLE > 0.08), []) AS gold FROM lineitem GROUP BY 1, 2, 3),
 g AS (SELECT item, list_distinct(flatten(list(gold))) AS gold FROM s GROUP BY 1), m AS (SELECT selector, item, CASE WHEN len(g.gold) > 0 THEN len(list_intersect(picked, g.gold))::DOUBLE END AS hits, len(g.gold) AS n_gold, len(picked) AS n_picked FROM s JOIN g USING (item)),
 i AS (SELECT selector, item, max(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM m GROUP BY 1, 2), p AS (SELECT selector, round_even(avg(hit) * 100, 1) AS item_hit_pct, count(*) AS n_items FROM i GROUP BY 1)"""


@query(f"""WITH {_STEPS} SELECT selector, count(*) AS n_steps, round_even(avg((hits > 0)::INT), 4) AS hit, round_even(avg(hits / nullif(n_gold, 0)), 4) AS recall, round_even(avg(1 - hits / n_picked), 4) AS noise, any_value(item_hit_pct) AS item_hit_pct, any_value(n_items) AS n_items FROM m JOIN p USING (selector) GROUP BY 1""")
def item_selectors(read):
    """Selectors by step, and the share of items with any hit; an item's golds are those of all its steps."""
    kind = F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string"))
    gold = F.when(F.col("l_discount").cast("double") > 0.08, kind)
    lines = dealt(read("lineitem").select(F.col("l_orderkey").alias("item"), "l_linenumber", "l_returnflag", "l_suppkey", "l_discount"), "item")
    s = lines.groupBy("item", F.floor(F.col("l_linenumber") / 2).alias("step"), F.col("l_returnflag").alias("selector")).agg(F.collect_set(kind).alias("picked"), F.collect_list(gold).alias("gold"))
    return M.selector_report(s)


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE trim(coalesce(text, '')) <> '') SELECT place // 64 AS chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(doc_id * (place % 64))::BIGINT AS places, sum(length(t))::BIGINT AS chars FROM d GROUP BY 1""")
def corpus_chunks(read):
    """The corpus in chunks of 64 texts that aren't blank."""
    c = C.chunked(read("documents").select("doc_id", "text"), ["doc_id"], "text", 64)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(F.col("doc_id") * F.col("place")).alias("places"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""SELECT o_orderkey, c_name, o_totalprice::DOUBLE AS price FROM orders JOIN customer ON o_custkey = c_custkey""")
def left_ordered_join(read):
    c = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return C.in_left_order(read("orders"), c, "o_custkey", ["o_orderkey"]).select("o_orderkey", "c_name", F.col("o_totalprice").cast("double").alias("price"))


@query("""SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0""")
def failed_samples(read):
    return C.failures_of(read("documents").select("doc_id", "source"), read("labels"), "doc_id", "quality").select("doc_id", "source", "toxic")


@query(r"""SELECT doc_id, source, md5(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g')) AS text FROM documents""")
def brief_rows(read):
    """A brief CSV table, written and read back: columns that aren't there are left out, line ends in texts are spaces."""
    d = read("documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    path = fresh_path(d.sparkSession, "brief")
    X.brief_table(d, path, ["doc_id", "source", "text", "missing"])
    back = d.sparkSession.read.schema("doc_id long, source string, text string").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return back.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))
