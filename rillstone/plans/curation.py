"""Queries over corpora and training rows: joins with counted outcomes, evidence, unions, samples, assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import curation as U
from rillstone.operators import relational as R
from rillstone.plans.registry import query

LOOSE = lambda x: rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"
_FULL = r"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')) <> ''"


@query(f"""WITH u AS (SELECT 0 AS part, doc_id AS pos, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, text FROM documents UNION ALL SELECT 1, item_id, '', text, text FROM benchmark),
 k AS (SELECT *, sha1(lower(trim(title) || chr(10) || trim(body))) AS h FROM u WHERE {_FULL.format(x='text')}), d AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY part, pos) AS r, count(*) OVER (PARTITION BY h) AS n FROM k)
 SELECT row_number() OVER (ORDER BY part, pos) - 1 AS id, CASE WHEN part = 1 THEN 'extend_' || pos ELSE pos::VARCHAR END AS name, h AS digest, n - 1 AS n_dropped FROM d WHERE r = 1""")
def corpus_union(read):
    d = read("documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("pos"), "text", F.substring_index("text", "\n", 1).alias("title"), F.when(F.contains("text", F.lit("\n")), F.substring("text", F.instr("text", "\n") + 1, F.length("text"))).otherwise("").alias("body"))
    b = read("benchmark").select(F.lit(1).alias("part"), F.col("item_id").alias("pos"), "text", F.lit("").alias("title"), F.col("text").alias("body"))
    full = d.unionByName(b).where(T.collapsed(F.col("text")) != "")
    k = full.select("part", "pos", F.sha1(F.lower(T.document_text(F.col("title"), F.col("body"))).cast("binary")).alias("digest"))
    named = U.numbered(R.first_wins(k, "digest", ["part", "pos"]), ["part", "pos"])
    return named.select("id", F.when(F.col("part") == 1, F.concat(F.lit("extend_"), F.col("pos").cast("string"))).otherwise(F.col("pos").cast("string")).alias("name"), "digest", "n_dropped")


@query("SELECT p_brand, arg_min(p_partkey, {'a': p_size, 'b': p_partkey}) AS p_partkey, count(*) - 1 AS n_dropped, count(DISTINCT p_size) - 1 AS n_conflicts FROM part GROUP BY p_brand")
def first_wins_lookup(read):
    return U.first_source_wins(read("part").select("p_brand", "p_size", "p_partkey"), "p_brand", ["p_size", "p_partkey"], "p_size").select("p_brand", "p_partkey", "n_dropped", "n_conflicts")


@query("""SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n_matched, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS n_missing, (SELECT sum(toxic)::BIGINT FROM documents JOIN labels USING (doc_id)) AS toxic""")
def gold_join(read):
    both, gone = U.with_missing(read("documents").select("doc_id"), read("labels"), ["doc_id"])
    aligned = U.aligned(both.select("doc_id"), read("labels"), "doc_id")
    return aligned.agg(F.count("*").alias("n_matched"), F.sum("toxic").cast("long").alias("toxic")).join(gone.agg(F.count("*").alias("n_missing"))).select("n_matched", "n_missing", "toxic")


_TITLES = f"t AS (SELECT conv_id, list_distinct(list({LOOSE('array_to_string(string_split(text, chr(32))[1:1], chr(32))')})) AS names FROM conversations GROUP BY 1), k AS (SELECT DISTINCT {LOOSE('array_to_string(string_split(text, chr(32))[1:1], chr(32))')} AS name FROM documents)"


@query(f"WITH {_TITLES}, u AS (SELECT conv_id, unnest(names) AS name FROM t) SELECT conv_id, count(*) AS n_names, count(k.name) AS n_known FROM u LEFT JOIN k USING (name) GROUP BY 1")
def reachable_titles(read):
    first = lambda c: T.loose_title(F.get(F.split(c, " "), F.lit(0)))
    names = read("conversations").groupBy("conv_id").agg(F.collect_set(first("text")).alias("names"))
    return U.reachable(names, "conv_id", "names", read("documents").select(first("text").alias("name")), "name")


@query(f"""WITH a AS (SELECT conv_id, turn, text, {LOOSE('text')} AS f FROM conversations WHERE conv_id % 5 > 0), b AS (SELECT conv_id, {LOOSE('text')} AS f FROM conversations WHERE conv_id % 5 = 0 OR conv_id % 7 = 1)
 SELECT (SELECT count(*) FROM a WHERE f IN (SELECT f FROM b)) AS n_same_text, (SELECT count(*) FROM a WHERE conv_id IN (SELECT conv_id FROM b)) AS n_same_key, (SELECT list_sort(list(conv_id)) FROM (SELECT conv_id FROM a WHERE f IN (SELECT f FROM b) ORDER BY conv_id LIMIT 5)) AS examples""")
def leakage_audit(read):
    c = read("conversations").select("conv_id", "text")
    return U.overlap_report(c.where("conv_id % 5 > 0"), c.where("conv_id % 5 = 0 or conv_id % 7 = 1"), T.loose_title(F.col("text")), "conv_id")


@query("""SELECT l.conv_id, l.turn, substr(sha256(l.role || chr(10) || '--R3REF--' || chr(10) || l.text), 1, 32) AS key, r.n FROM conversations l JOIN (SELECT role, text, count(*) AS n FROM conversations GROUP BY ALL) r USING (role, text)""")
def digest_lookup(read):
    key = U.digest_key(F.col("role"), F.col("text")).alias("key")
    c = read("conversations").select("conv_id", "turn", key)
    return c.join(c.groupBy("key").agg(F.count("*").alias("n")), "key").select("conv_id", "turn", "key", "n")


# Supporting facts: a conversation's odd turns name their own beginnings, with the turn's number as the sentence.
@query(rf"""WITH c AS (SELECT conv_id, turn, text, split_part(text, ' ', 1) AS title FROM conversations), f AS (SELECT conv_id, turn, trim(title) AS title, {LOOSE('title')} AS key, turn AS sid FROM c WHERE turn % 2 = 1 AND trim(title) <> ''),
 x AS (SELECT conv_id, {LOOSE('title')} AS key, arg_max(string_split(text, chr(10)), turn) AS sents FROM c GROUP BY 1, 2), j AS (SELECT f.*, trim(x.sents[sid + 1]) AS s FROM f LEFT JOIN x USING (conv_id, key)),
 g AS (SELECT conv_id, key, arg_min(title, turn) AS title, min(turn) AS pos, count(DISTINCT s) FILTER (s <> '') AS n_sents FROM j GROUP BY 1, 2)
 SELECT conv_id, array_to_string(list(title ORDER BY pos), '|') AS titles, array_to_string(list(n_sents ORDER BY pos), '|') AS counts FROM g GROUP BY 1""")
def gold_evidence(read):
    c = read("conversations").withColumn("title", F.substring_index("text", " ", 1))
    order = lambda x: F.transform(F.array_sort(x), lambda s: s["v"])
    facts = order(F.collect_list(F.when(F.col("turn") % 2 == 1, F.struct("turn", F.struct("title", F.col("turn").cast("int").alias("sent_id")).alias("v")))))
    context = order(F.collect_list(F.struct("turn", F.struct("title", F.split("text", "\n").alias("sentences")).alias("v"))))
    r = c.groupBy("conv_id").agg(facts.alias("facts"), context.alias("context"))
    e = r.select("conv_id", U.gold_evidence(F.col("facts"), F.col("context"), T.loose_title).alias("e")).where(F.size("e") > 0)
    return e.select("conv_id", F.array_join(F.transform("e", lambda x: x["title"]), "|").alias("titles"), F.array_join(F.transform("e", lambda x: F.size(x["sentences"]).cast("string")), "|").alias("counts"))


@query(f"""WITH p AS (SELECT conv_id, turn AS idx, split_part(text, ' ', 1) AS title, {LOOSE("split_part(text, ' ', 1)")} AS key, text, turn % 3 = 0 AS sup FROM conversations), h AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN idx > 90 ELSE idx % 2 = 0 END AS hop FROM p WHERE title <> ''),
 u AS (SELECT * FROM h WHERE hop OR (sup AND NOT EXISTS (SELECT 1 FROM h y WHERE y.conv_id = h.conv_id AND y.hop))), g AS (SELECT conv_id, key, arg_min(title, idx) AS title, min(idx) AS pos, count(DISTINCT lower(text)) AS n FROM u GROUP BY 1, 2)
 SELECT conv_id, array_to_string(list(title ORDER BY pos), '|') AS titles, array_to_string(list(n ORDER BY pos), '|') AS counts FROM g GROUP BY 1""")
def hop_evidence(read):
    c = read("conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("idx"), F.substring_index("text", " ", 1).alias("title"), "text", (F.col("turn") % 3 == 0).alias("supporting")).alias("p"))
    r = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    hops = F.filter(F.transform("ps", lambda p: p["idx"]), lambda i: F.when(F.col("conv_id") % 4 == 0, i > 90).otherwise(i % 2 == 0))
    e = r.select("conv_id", U.hop_evidence(hops, F.col("ps"), T.loose_title).alias("e")).where(F.size("e") > 0)
    return e.select("conv_id", F.array_join(F.transform("e", lambda x: x["title"]), "|").alias("titles"), F.array_join(F.transform("e", lambda x: F.size(x["sentences"]).cast("string")), "|").alias("counts"))


# Samples: hashes decide, so any engine draws the same rows.
_SHA = lambda seed, key: rf"sha256('{seed}'::BLOB || '\x00'::BLOB || encode({key}::VARCHAR))"


@query(f"SELECT doc_id FROM documents ORDER BY {_SHA('42', 'doc_id')}, doc_id LIMIT 50")
def hash_subset(read):
    return U.hash_subset(read("documents").select("doc_id"), "42", "doc_id", 50)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SHA('7', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 25 WHEN 'fr' THEN 15 ELSE 0 END")
def ratio_sample(read):
    return U.ratio_sample(read("documents").select("doc_id", "lang"), "7", "doc_id", "lang", {"en": 0.6, "de": 0.25, "fr": 0.15}, 100)


@query("""WITH b AS (SELECT p_partkey AS pos, p_brand AS grp, p_retailprice::DOUBLE AS v, p_size > 45 AS flag FROM part), x AS (SELECT *, 0 AS pass, pos::DOUBLE AS rk FROM b WHERE flag UNION ALL SELECT *, 1, v FROM b UNION ALL SELECT *, 2, -v FROM b), y AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pass, rk, pos) AS r FROM x)
 SELECT pos, grp FROM y WHERE r = 1 ORDER BY pass, rk, pos LIMIT 12""")
def diversified_pick(read):
    b = read("part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("grp"), F.col("p_retailprice").cast("double").alias("v"), (F.col("p_size") > 45).alias("flag"))
    return U.diversified(b, "grp", F.col("flag"), "v", "pos", 12).select("pos", "grp")


@query("WITH u AS (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY min(turn * 1000 + conv_id), conv_id LIMIT 7) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM u)")
def first_units(read):
    c = read("conversations").withColumn("at", F.col("turn") * 1000 + F.col("conv_id"))
    return U.first_units(c, ["conv_id"], "at", 7).select("conv_id", "turn")


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)""")
def longest_documents(read):
    d = read("documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select(F.col("doc_id").cast("string").alias("doc_id"))
    return U.numbered(U.by_number(d, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")), ["doc_id"], "place")


@query("SELECT c_mktsegment, n, f1, em FROM (SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS f1, round(max(c_acctbal), 6) AS em FROM customer GROUP BY 1) ORDER BY f1 DESC, em DESC, n DESC LIMIT 1")
def best_config(read):
    g = read("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("f1"), F.round(F.max("c_acctbal"), 6).alias("em"))
    return g.orderBy(F.desc("f1"), F.desc("em"), F.desc("n")).limit(1)


# Sets ------------------------------------------------------------------------------------
@query("""WITH c AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
 SELECT user_id, array_to_string(list(event_type ORDER BY pos), '|') AS plan, (SELECT count(*) FROM events e WHERE e.user_id = c.user_id) - count(*) AS n_repeats FROM c WHERE r = 1 GROUP BY 1""")
def distinct_plans(read):
    # The first of each form, then one short list a user: long users are never gathered.
    first = read("events").groupBy("user_id", F.lower("event_type").alias("form")).agg(F.min(F.struct("ts", "event_id", "event_type")).alias("at"), F.count("*").alias("n"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["event_type"]), "|").alias("plan"), (F.sum("n") - F.count("*")).alias("n_repeats"))


@query("""SELECT conv_id, arg_min(turn, turn) AS turn, split_part(text, ' ', 1) AS title, left(text, 80) AS head FROM conversations GROUP BY conv_id, title, head""")
def distinct_docs(read):
    c = read("conversations").withColumn("title", F.substring_index("text", " ", 1))
    return U.distinct_docs(c, "conv_id", "title", "text", ["turn"]).select("conv_id", "turn", "title", F.left("text", F.lit(80)).alias("head"))


@query(r"""SELECT conv_id, turn, array_to_string(list_distinct_ordered, '|') AS kept FROM (SELECT conv_id, turn, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(list_transform(w, lambda x: lower(x)), lower(w[i])) = i THEN w[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))""")
def ordered_distinct(read):
    # Distinct in order by one pass over positions: a fold would be quadratic in long texts.
    w = read("conversations").select("conv_id", "turn", F.split("text", " ").alias("w")).withColumn("f", F.transform("w", F.lower))
    kept = F.filter(F.transform("w", lambda x, i: F.when(F.array_position("f", F.get("f", i)) == i + 1, x)), lambda x: x.isNotNull())
    return w.select("conv_id", "turn", F.array_join(kept, "|").alias("kept"))


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_left, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_all""")
def set_operations(read):
    d = read("documents").select("doc_id", "source", "lang")
    a, b = d.where("doc_id % 2 = 0").select("source", "lang").distinct(), d.where("doc_id % 2 = 1").select("source", "lang").distinct()
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(a.intersect(b), "n_both").join(n(a.subtract(b), "n_left")).join(n(a.union(b).distinct(), "n_all"))


# Assembly --------------------------------------------------------------------------------
# Units are lots of forty ids, so that a unit's list is of one size however many documents there are.
@query("""WITH j AS (SELECT d.source, d.doc_id // 40 AS lot, d.doc_id, d.n_chars::DOUBLE AS score, l.quality AS label, CASE WHEN l.doc_id IS NULL THEN 'missing_label' WHEN coalesce(l.quality IN (0, 1), false) AND l.doc_id % 11 <> 3 THEN 'kept' ELSE 'failed_label' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)),
 k AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM j WHERE reason = 'kept' WINDOW w AS (PARTITION BY source, lot)), z AS (SELECT *, 0.5 * label + 0.5 * CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS z FROM k),
 t AS (SELECT *, exp(z - max(z) OVER (PARTITION BY source, lot)) AS e FROM z), s AS (SELECT *, round(e / sum(e) OVER (PARTITION BY source, lot), 6) AS target FROM t),
 g AS (SELECT source, lot, count(*) AS n_kept, sum(label) AS n_pos, round(max(target), 5) AS top, arg_max(doc_id, {'t': target, 'd': -doc_id}) AS best FROM s GROUP BY 1, 2), u AS (SELECT source, lot, count(*) FILTER (reason = 'missing_label') AS n_missing, count(*) FILTER (reason = 'failed_label') AS n_failed FROM j GROUP BY 1, 2)
 SELECT source, lot, CASE WHEN coalesce(n_kept, 0) < 2 THEN 'too_few' WHEN n_pos = 0 THEN 'all_negative' ELSE 'ok' END AS status, n_missing, n_failed, coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(n_pos, 0)::BIGINT AS n_pos, coalesce(n_kept, 0) = coalesce(n_pos, 0) AS all_positive, top FROM u LEFT JOIN g USING (source, lot)""")
def training_groups(read):
    labels = read("labels")
    j = R.reason_join(read("documents").select("doc_id", "source", F.floor(F.col("doc_id") / 40).alias("lot"), F.col("n_chars").cast("double").alias("score")), labels.withColumnRenamed("quality", "label"), ["doc_id"], F.col("label").isin(0, 1) & (F.col("doc_id") % 11 != 3))
    a = U.assembled(j, ["source", "lot"])
    top = F.round(F.array_max(F.transform("candidates", lambda c: c["target"])), 5)
    return a.select("source", "lot", "status", "n_missing", "n_failed", F.col("n_kept").cast("long").alias("n_kept"), F.col("n_pos").cast("long").alias("n_pos"), "all_positive", top.alias("top"))


@query("""WITH c AS (SELECT conv_id, turn, text, octet_length(encode(text)) AS b FROM conversations), r AS (SELECT *, 20 + sum(b) OVER (PARTITION BY conv_id ORDER BY turn) + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS upto FROM c)
 SELECT conv_id, count(*) FILTER (upto <= 1500)::INT AS used, count(*) FILTER (upto <= 1500) < count(*) AS truncated, md5('<context>' || chr(10) || coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (upto <= 1500), '') || chr(10) || 'answer now') AS digest FROM (SELECT * REPLACE (upto + 1 AS upto) FROM r) GROUP BY 1""")
def packed_prompts(read):
    r = read("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("blocks"))
    p = U.packed_prompt(F.lit("<context>\n"), F.col("blocks"), F.lit("\nanswer now"), 1500)
    return r.select("conv_id", p.alias("p")).select("conv_id", "p.used", "p.truncated", F.md5(F.col("p.prompt").cast("binary")).alias("digest"))


# Step records from conversations: the first turn asks, the others are steps; the last one is the output.
@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), q AS (SELECT conv_id, n, max(t) FILTER (turn = 0) AS q, string_agg(trim(t), ' ' ORDER BY turn) FILTER (turn > 0 AND turn < n - 1) AS thoughts, max(trim(t)) FILTER (turn = n - 1) AS last FROM c GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'no_question' WHEN conv_id % 7 = 1 THEN 'no_current_step' WHEN conv_id % 7 = 2 THEN 'output_not_single_step' WHEN conv_id % 7 = 3 THEN 'current_step_no_query_or_answer' ELSE 'ok' END AS status FROM q)
 SELECT conv_id, status, CASE WHEN status = 'ok' THEN 'Question: ' || trim(q) || CASE WHEN coalesce(thoughts, '') <> '' THEN chr(10) || 'Previous Thoughts: ' || thoughts ELSE '' END END AS instruction,
 CASE WHEN status = 'ok' THEN trim(last) || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'So the answer is <answer>' || trim(last) || '</answer>' ELSE 'So the next query is <query>' || trim(last) || '</query>' END END AS output FROM s""")
def training_rows(read):
    t = F.regexp_replace("text", r"\s+", " ")
    c = read("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))), lambda x: x["t"]).alias("ts"))
    k, n = F.col("conv_id") % 7, F.size("ts")
    last = F.element_at("ts", -1)
    step = lambda x, i: F.concat(F.lit("Step "), i.cast("string"), F.lit(":\nThe problem analysis: "), x, F.lit("\n"))
    between = F.when(n > 2, F.slice("ts", F.lit(2), n - 2)).otherwise(F.array().cast("array<string>"))
    instruction = F.concat(F.when(k == 0, F.lit("Nothing asked\n")).otherwise(F.concat(F.lit("The question: "), F.get("ts", F.lit(0)), F.lit("\n"))), F.array_join(F.transform(between, lambda x, i: step(x, i + 1)), ""))
    action = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("The final answer: "), last)).otherwise(F.concat(F.lit("The retrieval query: "), last))
    one = F.concat(step(last, F.lit(9)), F.when(k == 3, F.lit("")).otherwise(action), F.lit("\n"))
    output = F.when(k == 1, last).when(k == 2, F.concat(one, one)).otherwise(one)
    return c.select("conv_id", U.training_row(instruction, output).alias("r")).select("conv_id", "r.*")


@query(r"""WITH h AS (SELECT conv_id, string_agg(rn || '. query: ' || role || ' | evidence: ' || text, chr(10) ORDER BY turn) AS hist FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1) SELECT conv_id, 2 AS n_messages, md5(hist) AS digest, length(hist)::INT AS n_chars FROM h""")
def chat_prompts(read):
    r = read("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("query"), F.col("text").alias("evidence")))), lambda x: F.struct(x["query"].alias("query"), x["evidence"].alias("evidence"))).alias("h"))
    m = r.select("conv_id", U.chat(F.lit("Answer."), U.rendered_history(F.col("h"))).alias("m"))
    return m.select("conv_id", F.size("m").alias("n_messages"), F.md5(F.col("m")[1]["content"].cast("binary")).alias("digest"), F.length(F.col("m")[1]["content"]).alias("n_chars"))


@query("""WITH u AS (SELECT 0 AS part, doc_id AS pos, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark), k AS (SELECT * FROM u WHERE trim(text) <> ''),
 d AS (SELECT *, sha1(lower(text)) AS h, row_number() OVER (PARTITION BY sha1(lower(text)) ORDER BY part, pos) AS r, count(*) OVER (PARTITION BY sha1(lower(text))) AS n FROM k)
 SELECT CASE WHEN part = 1 THEN 'extend_' || pos ELSE pos::VARCHAR END AS id, h AS digest, n - 1 AS n_dropped FROM d WHERE r = 1""")
def content_dedup(read):
    u = read("documents").select(F.lit(0).alias("part"), F.col("doc_id").cast("long").alias("pos"), "text").unionByName(read("benchmark").select(F.lit(1).alias("part"), F.col("item_id").cast("long").alias("pos"), "text"))
    k = u.where(F.trim("text") != "").select("part", "pos", F.sha1(F.lower("text").cast("binary")).alias("digest"))
    first = R.first_wins(k, "digest", ["part", "pos"])
    return first.select(F.when(F.col("part") == 1, F.concat(F.lit("extend_"), F.col("pos").cast("string"))).otherwise(F.col("pos").cast("string")).alias("id"), "digest", "n_dropped")
