"""Queries that audit and report: per-source gates, violations, agreement, grids, nested records, decoded fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import metrics as M
from rillstone.operators import relational as R
from rillstone.operators.scans import scanned
from rillstone.plans.answers import answer_tokens, turns
from rillstone.plans.registry import query
from rillstone.plans.steps import _FORMAT, _OLD_FORMAT, _RESPONSES, _SHAPE, responses
from rillstone.sources.store import kept

_BLANK = r"regexp_replace(coalesce(text, ''), '\s+', '', 'g') = ''"


@query(rf"""WITH d AS (SELECT *, {_BLANK} AS blank, count(*) OVER (PARTITION BY md5(lower(coalesce(text, '')))) AS copies, row_number() OVER (PARTITION BY source, {_BLANK} ORDER BY doc_id) AS r FROM documents), s AS (SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, count_if(blank) AS blank, count_if(copies > 1) AS copied, count_if(n_chars < 200) AS short, count(DISTINCT md5(lower(coalesce(text, '')))) AS kinds, array_to_string(list(doc_id ORDER BY doc_id) FILTER (NOT blank AND r <= 5), ',') AS examples FROM d GROUP BY 1)
 SELECT source, n, ids, blank, copied, n - kinds AS surplus, round_even(copied / n, 4) AS copied_rate, round_even(short / n, 4) AS short_rate, examples, n = ids AND blank * 20 <= n AS passed FROM s""")
def source_gates(read):
    d = read("documents").select("source", "doc_id", "n_chars", (F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") == "").alias("blank"), F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("kind"))
    kinds = d.groupBy("kind").agg(F.count("*").alias("copies"))
    s = d.join(kinds, "kind").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if("blank").alias("blank"), F.count_if(F.col("copies") > 1).alias("copied"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_distinct("kind").alias("kinds"))
    first = R.top_n(d.where("not blank"), ["source"], [F.col("doc_id")], 5).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    rate = lambda c: F.bround(F.col(c) / F.col("n"), 4).alias(f"{c}_rate")
    return s.join(first, "source", "left").select("source", "n", "ids", "blank", "copied", (F.col("n") - F.col("kinds")).alias("surplus"), rate("copied"), rate("short"), "examples", ((F.col("n") == F.col("ids")) & (F.col("blank") * 20 <= F.col("n"))).alias("passed"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS dup, CASE WHEN value > 400 THEN NULL ELSE value::INT % 3 END AS hits FROM events),
 b AS (SELECT *, unnest(['all', CASE WHEN hits > 0 THEN 'effective' END, CASE WHEN dup THEN 'duplicate' END, CASE WHEN NOT dup THEN 'fresh' END, CASE WHEN NOT dup AND NOT coalesce(hits, 0) > 0 THEN 'fresh_ineffective' END]) AS block FROM e)
 SELECT block, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 6) AS rate, round(avg(hits), 6) AS mean_hits FROM b WHERE block IS NOT NULL GROUP BY 1""")
def query_blocks(read):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hits = F.when(F.col("value") <= 400, F.bround("value").cast("int") % 3)
    e = read("events").select((F.row_number().over(w) > 1).alias("dup"), hits.alias("hits"))
    hit, dup = F.coalesce(F.col("hits") > 0, F.lit(False)), F.col("dup")
    # Five overlapping subsets in one pass: sums side by side, turned into rows at the end.
    blocks = {"all": F.lit(True), "effective": hit, "duplicate": dup, "fresh": ~dup, "fresh_ineffective": ~dup & ~hit}
    one = e.agg(*[x for k, c in blocks.items() for x in (F.count_if(c).alias(f"{k}_n"), F.avg(F.when(c, F.col("hits"))).alias(f"{k}_m"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.col(f"{k}_n").alias("n"), F.round(F.col(f"{k}_n") / F.col("all_n"), 6).alias("rate"), F.round(f"{k}_m", 6).alias("mean_hits")) for k in blocks])).alias("r")
    return one.select(rows).select("r.*").where("n > 0")


@query("""WITH r AS (SELECT l_orderkey AS id, l_returnflag AS mode, l_discount > 0.05 AS gold, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM lineitem), g AS (SELECT id, mode, count_if(gold) AS n_gold FROM r GROUP BY 1, 2), k AS (SELECT unnest([1, 2, 3, 5]) AS k),
 h AS (SELECT g.id, g.mode, k.k, n_gold, (SELECT count(*) FROM r WHERE r.id = g.id AND r.mode = g.mode AND r.gold AND r.rank <= k.k) AS found FROM g, k WHERE n_gold > 0)
 SELECT mode, k, count(*) AS n, round_even(sum(found)::DOUBLE / sum(n_gold), 4) AS coverage, round_even(avg((found = n_gold)::INT), 4) AS full_recall FROM h GROUP BY 1, 2""")
def coverage_grid(read):
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    r = read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("mode"), (F.col("l_discount") > 0.05).alias("gold"), F.row_number().over(w).alias("rank"))
    ks = [1, 2, 3, 5]
    g = r.groupBy("id", "mode").agg(F.count_if("gold").alias("n_gold"), *[F.count_if(F.col("gold") & (F.col("rank") <= k)).alias(f"f{k}") for k in ks]).where("n_gold > 0")
    h = g.select("mode", "n_gold", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("found")) for k in ks])).alias("x")).select("mode", "n_gold", "x.*")
    return h.groupBy("mode", "k").agg(F.count("*").alias("n"), F.bround(F.sum("found") / F.sum("n_gold"), 4).alias("coverage"), F.bround(F.avg((F.col("found") == F.col("n_gold")).cast("double")), 4).alias("full_recall"))


_RULES = {"late_ship": "l_shipdate < o_orderdate", "high_discount": "l_discount > 0.09", "no_quantity": "l_quantity < 2", "taxed_return": "l_returnflag = 'R' AND l_tax > 0.07"}


@query("WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count_if({v}) AS n, min(CASE WHEN {v} THEN l_orderkey END) AS first_key, count_if({v}) <= 0.05 * count(*) AS within FROM j" for k, v in _RULES.items()))
def violations(read):
    j = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = j.agg(F.count("*").alias("all"), *[x for k, v in _RULES.items() for x in (F.count_if(F.expr(v)).alias(f"{k}_n"), F.min(F.expr(f"case when {v} then l_orderkey end")).alias(f"{k}_k"))])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_k").alias("first_key"), (F.col(f"{k}_n") <= 0.05 * F.col("all")).alias("within")) for k in _RULES])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("""SELECT d.source, count(*) AS n, count(l.quality) AS n_judged, round_even(coalesce(avg(l.quality), 0), 4) AS accuracy_judged, round_even(sum(coalesce(l.quality, 0))::DOUBLE / count(*), 4) AS accuracy_all, count(*) FILTER (l.quality = 0 AND l.toxic = 1) AS toxic_errors, sum(n_chars)::BIGINT AS tokens, round_even(sum(n_chars) * 0.002 / 1000, 4) AS cost
 FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def judge_accuracy(read):
    j = read("documents").select("doc_id", "source", "n_chars").join(read("labels"), "doc_id", "left")
    return j.groupBy("source").agg(
        F.count("*").alias("n"), F.count("quality").alias("n_judged"), F.coalesce(F.bround(F.avg("quality"), 4), F.lit(0.0)).alias("accuracy_judged"), M.rate(F.sum(F.coalesce("quality", F.lit(0))), F.count("*")).alias("accuracy_all"),
        F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("toxic_errors"), F.sum("n_chars").cast("long").alias("tokens"), F.bround(F.sum("n_chars") * 0.002 / 1000, 4).alias("cost"),
    )


@query(f"""WITH {_RESPONSES}, x AS (SELECT turn % 6 AS step, {_SHAPE} AS shape, {_OLD_FORMAT} AS old, {_FORMAT} AS new FROM r) SELECT step, shape, count(*) AS n, count_if(old) AS old_ones, count_if(new) AS new_ones FROM x GROUP BY 1, 2""")
def rule_comparison(read):
    r = responses(read).select((F.col("turn") % 6).alias("step"), T.completion_shape(F.col("s")).alias("shape"), T.answer_without_query(F.col("s")).alias("old"), T.ends_with_answer(F.col("s")).alias("new"))
    return r.groupBy("step", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("old") > 0).alias("old_ones"), F.count_if(F.col("new") > 0).alias("new_ones"))


@query("""WITH t AS (SELECT event_type, user_id % 4 AS gpu, value, ts, event_id FROM events), r AS (SELECT *, max(value) OVER (PARTITION BY gpu ORDER BY ts, event_id) AS peak FROM t)
 SELECT event_type, gpu, round(avg(value), 6) AS mean_util, max(value) AS peak, round(avg(peak), 6) AS mean_running_peak, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median FROM r GROUP BY 1, 2""")
def telemetry(read):
    t = read("events").select("event_type", (F.col("user_id") % 4).alias("gpu"), "value", "ts", "event_id")
    r = kept(scanned(t, ["gpu"], ["ts", "event_id"], {"running": ("max", F.col("value"))}))
    found = r.groupBy("event_type", "gpu").agg(F.round(F.avg("value"), 6).alias("mean_util"), F.max("value").alias("peak"), F.round(F.avg("running"), 6).alias("mean_running_peak"), F.min("value").alias("least"))
    median = M.quantiles(r, "value", {"median": 0.5}, ["event_type", "gpu"])
    return found.join(median, ["event_type", "gpu"]).withColumn("median", F.round("median", 6))


# Messages of a conversation, scored again by the last assistant turn alone.
@query(f"""WITH m AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS pred, min_by(text, turn) AS gold FROM conversations GROUP BY 1), k AS (SELECT conv_id, coalesce(pred, '') AS pred, {answer_tokens('pred')} AS pt, {answer_tokens('gold')} AS gt FROM m),
 o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0) AS o FROM k)
 SELECT count(*) AS n, count_if(trim(pred) <> '') AS n_answered, round_even(sum(CASE WHEN trim(pred) <> '' AND pt = gt THEN 1.0 ELSE 0.0 END) / count(*), 4) AS em, round_even(sum(CASE WHEN trim(pred) = '' OR o = 0 THEN 0.0 ELSE 2.0 * o / (len(pt) + len(gt)) END) / count(*), 4) AS f1 FROM o""")
def rescored_messages(read):
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    m = read("conversations").groupBy("conv_id").agg(messages.alias("ms"))
    last = F.try_element_at(F.filter("ms", lambda x: x["role"] == "assistant"), F.lit(-1))["text"]
    s = M.scored(m.select("conv_id", F.when(F.trim(last) != "", last).alias("answer"), F.array(F.col("ms")[0]["text"]).alias("gold")))
    return s.agg(F.count("*").alias("n"), F.count("answer").alias("n_answered"), M.rate(F.sum("em"), F.count("*")).alias("em"), M.rate(F.sum("f1"), F.count("*")).alias("f1"))


# Nested records: a conversation's turns as steps with documents, unnested and projected.
@query(r"""WITH c AS (SELECT conv_id, turn, role, text, turn % 4 = 1 AS dup FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn::INT AS pos, CASE WHEN turn = 0 THEN 'summary' ELSE 'step' END AS kind, left(text, 200) AS text, md5(split_part(text, chr(10), 1)) AS first_doc, CASE WHEN dup AND role = 'user' THEN 'both' WHEN dup THEN 'regression' WHEN role = 'user' THEN 'improvement' ELSE 'same' END AS what,
 count(*) OVER (PARTITION BY conv_id)::INT AS n_steps, count_if(dup) OVER (PARTITION BY conv_id)::INT AS n_dup, count(*) OVER (PARTITION BY conv_id) >= 6 AS exhausted, CASE WHEN count(*) OVER (PARTITION BY conv_id) >= 6 THEN 'max_turns_exceeded' ELSE 'stopped' END AS finish FROM c""")
def nested_steps(read):
    step = F.struct("turn", "role", "text", (F.col("turn") % 4 == 1).alias("exact_duplicate"), F.split("text", "\n").alias("docs"))
    r = read("conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    n = F.size("steps")
    b = r.withColumns({"n_steps": n, "n_dup": F.size(F.filter("steps", lambda s: s["exact_duplicate"])), "exhausted": n >= 6, "finish": F.when(n >= 6, "max_turns_exceeded").otherwise("stopped")})
    s = b.select("conv_id", "n_steps", "n_dup", "exhausted", "finish", F.posexplode("steps").alias("pos", "s"))
    user, dup = F.col("s.role") == "user", F.col("s.exact_duplicate")
    what = F.when(dup & user, "both").when(dup, "regression").when(user, "improvement").otherwise("same")
    return s.select("conv_id", "pos", F.when(F.col("s.turn") == 0, "summary").otherwise("step").alias("kind"), F.left("s.text", F.lit(200)).alias("text"), F.md5(F.get("s.docs", F.lit(0)).cast("binary")).alias("first_doc"), what.alias("what"), "n_steps", "n_dup", "exhausted", "finish")


@query("""WITH c AS (SELECT conv_id, turn, text AS chosen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected, role FROM conversations) SELECT conv_id, turn, role, CASE WHEN trim(coalesce(chosen, '')) = '' OR trim(coalesce(rejected, '')) = '' THEN 'empty' WHEN chosen = rejected THEN 'equal' ELSE 'ok' END AS status FROM c""")
def preference_pairs(read):
    c = turns(read)
    t = lambda x: F.trim(F.coalesce(x, F.lit("")))
    return c.select("conv_id", "turn", "role", F.when((t("text") == "") | (t("nxt") == ""), "empty").when(F.col("text") == F.col("nxt"), "equal").otherwise("ok").alias("status"))


# Fields in JSON: labels in many spellings, step lists, facts in three shapes, names and times.
@query("""WITH d AS (SELECT doc_id, ['"Yes"', '"no"', '1', '0', 'true', '"maybe"', 'null'][(doc_id % 7 + 1)::INT] AS v, doc_id % 5 AS k, source, lang, n_chars FROM documents)
 SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 7 < 5 AS ok, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 IN (0, 2, 4) THEN 1 WHEN doc_id % 7 IN (1, 3) THEN 0 END AS label, CASE WHEN doc_id % 11 = 0 THEN 'root_not_object' WHEN doc_id % 7 = 5 THEN 'bad_label=maybe' WHEN doc_id % 7 = 6 THEN 'bad_label=None' END AS reason,
 CASE k WHEN 0 THEN 'missing_reasoning_steps_list' WHEN 1 THEN 'too_many_steps=5' WHEN 2 THEN 'step1_missing_thought' ELSE 'ok' END AS steps, CASE WHEN doc_id % 4 = 3 THEN '' WHEN source = lang THEN source ELSE source || '|' || lang END AS titles, (doc_id % 10)::INT AS searches, (doc_id % 6)::INT AS top_k, (doc_id % 1000)::DOUBLE AS seconds, 3 AS n_lines FROM d""")
def decoded_fields(read):
    i = F.col("doc_id")
    v = F.get(F.array(*[F.lit(x) for x in ('"Yes"', '"no"', "1", "0", "true", '"maybe"', "null")]), (i % 7).cast("int"))
    judged = F.when(i % 11 == 0, F.concat(F.lit("["), v, F.lit("]"))).otherwise(F.concat(F.lit('{"label": '), v, F.lit(', "evidence": "x"}')))
    full = '{"subquery": "a", "subject_entity": "b", "thought": "c", "step_gold": "d"}'
    gap = '{"subquery": "a", "subject_entity": "b", "thought": " ", "step_gold": "d"}'
    lists = ["", ", ".join([full] * 5), f"{full}, {gap}", full, f"{full}, {full}"]
    steps = F.concat(F.lit('{"reasoning_steps": ['), F.get(F.array(*[F.lit(x) for x in lists]), (i % 5).cast("int")), F.lit("]}"))
    s, g = F.col("source"), F.col("lang")
    facts = (
        F.when(i % 4 == 0, F.concat(F.lit('[["'), s, F.lit('", 0], ["'), g, F.lit('", 1], ["'), s, F.lit('", 2]]'))).when(i % 4 == 1, F.concat(F.lit('[{"title": "'), s, F.lit('", "sent_id": 0}, {"title": " '), g, F.lit('"}]')))
        .when(i % 4 == 2, F.concat(F.lit('{"title": ["'), s, F.lit('", "'), g, F.lit('"], "sent_id": [0, 1]}'))).otherwise("[]")
    )
    name = F.concat(F.lit("s"), (i % 10).cast("string"), F.lit("_k"), (i % 6).cast("string"))
    start = F.lit("2024-01-01T00:00:00")
    end = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + i % 1000), "yyyy-MM-dd'T'HH:mm:ss")
    nested = F.array(F.array(F.lit("one\ntwo ")), F.array(F.lit(""), F.lit(" three")))
    label, sizes = T.label_of(judged), T.config_sizes(name)
    return read("documents").select("doc_id", label["ok"].alias("ok"), label["label"].alias("label"), label["reason"].alias("reason"), T.steps_status(steps).alias("steps"), F.array_join(T.supporting_titles(facts), "|").alias("titles"), sizes["searches"].alias("searches"), sizes["top_k"].alias("top_k"), T.seconds_between(start, end).alias("seconds"), F.size(T.sentence_lines(nested)).alias("n_lines"))


@query("""WITH g AS (SELECT c_mktsegment AS config, c_nationkey % 3 AS dataset, count(*) AS n, round(avg(c_acctbal), 4) AS score FROM customer GROUP BY 1, 2), grid AS (SELECT config, dataset FROM (SELECT DISTINCT c_mktsegment AS config FROM customer), (SELECT unnest([0, 1, 2, 3]) AS dataset))
 SELECT grid.config, grid.dataset::BIGINT AS dataset, coalesce(g.n, 0) AS n, g.score, round(g.score - lag(g.score) OVER (PARTITION BY grid.dataset ORDER BY grid.config), 4) AS step, CASE WHEN g.n IS NULL THEN 'missing' ELSE 'there' END AS state FROM grid LEFT JOIN g USING (config, dataset)""")
def result_grid(read):
    g = read("customer").groupBy(F.col("c_mktsegment").alias("config"), (F.col("c_nationkey") % 3).alias("dataset")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("score"))
    # Two short lists of names: their product is the grid of reports, whatever the tables' size.
    grid = read("customer").select(F.col("c_mktsegment").alias("config")).distinct().select("config", F.explode(F.array(*[F.lit(i).cast("long") for i in range(4)])).alias("dataset"))
    j = grid.join(g.withColumn("dataset", F.col("dataset").cast("long")), ["config", "dataset"], "left")
    step = F.round(F.col("score") - F.lag("score").over(Window.partitionBy("dataset").orderBy("config")), 4)
    return j.select("config", "dataset", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "score", step.alias("step"), F.when(F.col("n").isNull(), "missing").otherwise("there").alias("state"))


@query("""SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2 ORDER BY n DESC, chars DESC, source, lang LIMIT 30""")
def top_counts(read):
    return read("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars")).orderBy(F.desc("n"), F.desc("chars"), "source", "lang").limit(30)


# Runs from conversations: config by id, dataset by length; steps are turns, of which some repeat, fail or find too little.
_RUNS = """c AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 's3k2' ELSE 's5k2' END AS config, 'd' || (conv_id // 3 % 2) AS dataset, CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 5 END AS max_searches, turn, turn % 3 <> 2 AS ran, turn % 5 = 2 AS dup, CASE WHEN turn % 7 = 3 THEN 'timeout' END AS failed, CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN 1 ELSE 2 END AS n_docs FROM conversations),
 r AS (SELECT id, config, dataset, max_searches, count(*) AS steps, count_if(ran) AS executed, count_if(failed IS NOT NULL) AS errors, bool_or(ran AND dup) AS dup_ran, bool_or(ran AND failed IS NULL AND n_docs <> 2) AS few FROM c GROUP BY ALL),
 b AS (SELECT *, id % 4 = 0 AS forced, id % 8 = 0 AS valid, CASE WHEN id % 8 = 4 THEN NULL ELSE 'x' END AS answer, id % 8 = 4 AS bad FROM r)"""
_RULE_SQL = {
    "wrong_top_k": "id % 13 = 5", "logical_searches": "steps > max_searches", "retrieval_calls": "executed + (id % 17 = 3)::INT <> executed OR executed + (id % 17 = 3)::INT > steps",
    "duplicate_executed": "dup_ran", "documents_found": "few", "invalid_forced_answer": "forced AND NOT valid", "gold_in_trace": "id % 19 = 2",
}
_RUN_SQL = """e AS (SELECT * FROM (VALUES ('s3k2', 'd0'), ('s3k2', 'd1'), ('s5k2', 'd0'), ('s5k2', 'd1'), ('s9k2', 'd0')) t(config, dataset)), s AS (SELECT config, dataset, count(*) AS n, count_if(bad) AS format, count_if(errors > 0) AS service FROM b GROUP BY 1, 2),
 x AS (SELECT e.*, n, format, service FROM e LEFT JOIN s USING (config, dataset))"""


def _protocol(read):
    from rillstone.operators import protocol

    i = F.col("conv_id")
    c = read("conversations").select(
        i.alias("id"), F.when(i % 3 == 0, "s3k2").otherwise("s5k2").alias("config"), F.concat(F.lit("d"), (F.floor(i / 3) % 2).cast("string")).alias("dataset"), F.when(i % 3 == 0, 3).otherwise(5).alias("max_searches"),
        F.struct("turn", (F.col("turn") % 3 != 2).alias("search_executed"), (F.col("turn") % 5 == 2).alias("exact_duplicate"), F.when(F.col("turn") % 7 == 3, "timeout").alias("retrieval_error"), F.when(F.length(F.coalesce("text", F.lit(""))) % 11 == 0, 1).otherwise(2).cast("long").alias("n_docs")).alias("step"),
    )
    r = c.groupBy("id", "config", "dataset", "max_searches").agg(F.array_sort(F.collect_list("step")).alias("steps")).withColumn("top_k", F.lit(2))
    n, ran, failed = F.size("steps"), F.size(F.filter("steps", lambda s: s["search_executed"])), F.size(F.filter("steps", lambda s: s["retrieval_error"].isNotNull()))
    k = F.col("id")
    behavior = F.struct(
        F.col("max_searches").alias("max_searches"), F.when(k % 13 == 5, 9).otherwise(2).alias("top_k"), F.lit("p1").alias("forced_answer_protocol"), n.alias("logical_search_count"), (ran + (k % 17 == 3).cast("int")).alias("actual_retrieval_rpc_count"),
        (k % 4 == 0).alias("forced_answer"), (k % 8 == 0).alias("forced_answer_valid"), failed.alias("retrieval_error_count"),
    )
    r = r.withColumns({"behavior": behavior, "answer": F.when(k % 8 != 4, "x"), "error": F.when(k % 8 == 4, "forced_answer_format_failure"), "message_keys": F.when(k % 19 == 2, F.array(F.lit("role"), F.lit("gold"))).otherwise(F.array(F.lit("role")))})
    runs = [("s3k2", "d0"), ("s3k2", "d1"), ("s5k2", "d0"), ("s5k2", "d1"), ("s9k2", "d0")]
    expected = read("conversations").sparkSession.createDataFrame([(a, b, 0) for a, b in runs], "config string, dataset string, rows long")
    counts = r.groupBy("config", "dataset").count()
    expected = expected.join(counts, ["config", "dataset"], "left").select("config", "dataset", F.coalesce("count", F.lit(1)).alias("rows"))
    return protocol.validated(r, expected, "p1", 0.3)


# Ids of a dataset never are in both configs, so the later config's set differs wherever both have rows.
@query(f"WITH {_RUNS}, {_RUN_SQL} " + " UNION ALL ".join(f"SELECT config, dataset, '{k}' AS rule, id::VARCHAR AS id, 1::BIGINT AS n FROM b WHERE {v}" for k, v in _RULE_SQL.items()) + """ UNION ALL SELECT config, dataset, 'missing_results', NULL, 1 FROM x WHERE n IS NULL
 UNION ALL SELECT config, dataset, 'id_set_differs', NULL, 1 FROM x WHERE config = 's5k2' AND n IS NOT NULL AND EXISTS (SELECT 1 FROM x y WHERE y.config = 's3k2' AND y.dataset = x.dataset AND y.n IS NOT NULL)
 UNION ALL SELECT config, dataset, 'format_failure_rate', NULL, format FROM x WHERE format > 0.3 * n UNION ALL SELECT config, dataset, 'service_failure_rate', NULL, service FROM x WHERE service > 0.3 * n""")
def protocol_violations(read):
    """Every broken rule of every result and run."""
    return _protocol(read)[0]


@query(f"""WITH {_RUNS}, {_RUN_SQL}, m AS (SELECT config, dataset, count_if(forced) AS forced_answers, count_if(forced AND valid) AS forced_valid, round(avg(steps), 6) AS avg_logical, round(avg(executed + (id % 17 = 3)::INT), 6) AS avg_rpcs, count_if({" OR ".join(f"({v})" for v in _RULE_SQL.values())}) AS broken FROM b GROUP BY 1, 2)
 SELECT x.config, x.dataset, coalesce(x.n, 0) AS n, forced_answers, forced_valid, format AS format_failures, service AS service_failures, avg_logical, avg_rpcs, coalesce(x.n IS NOT NULL AND broken = 0 AND format <= 0.3 * x.n AND service <= 0.3 * x.n AND x.config = 's3k2', false) AS passed FROM x LEFT JOIN m USING (config, dataset)""")
def protocol_summary(read):
    s = _protocol(read)[1]
    return s.withColumns({"avg_logical": F.round("avg_logical_searches", 6), "avg_rpcs": F.round("avg_actual_retrieval_rpcs", 6)}).drop("avg_logical_searches", "avg_actual_retrieval_rpcs")


@query(r"""SELECT doc_id, 3 AS n, 'x {' || source || '} y' AS first, md5(translate(coalesce(text, ''), '{}', '()')) AS second, NULL::VARCHAR AS third FROM documents""")
def tex_arguments(read):
    """What commands enclose, over whole texts: nested braces, options before them, and an argument that isn't closed."""
    from rillstone.sources import formats as X

    text = F.translate(F.coalesce("text", F.lit("")), "{}", "()")
    tex = F.concat(F.lit(r"a \caption{x {"), F.col("source"), F.lit(r"} y} } b \caption[z] {"), text, F.lit(r"} c \caption{open {} "))
    d = read("documents").select("doc_id", X.arguments(tex, r"\caption").alias("found"))
    return d.select("doc_id", F.size("found").alias("n"), F.get("found", F.lit(0)).alias("first"), F.md5(F.get("found", F.lit(1)).cast("binary")).alias("second"), F.get("found", F.lit(2)).alias("third"))
