"""Queries over records: cleaned columns, unrolled lists, contexts, counters, keyed digests, the older routed loop, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions import scoring as S
from rillstone.functions import text as T
from rillstone.operators import curation as U
from rillstone.plans.registry import query
from rillstone.sources import files
from rillstone.sources import formats as X
from rillstone.sources.store import fresh_path, kept
from rillstone.streaming import machines as A


@query("""SELECT lang, count(*) AS n, 4 AS n_columns, count(*) FILTER (trim(coalesce(text, '')) <> '' AND doc_id % 6 > 0) AS n_valid, count(*) FILTER (doc_id % 5 > 1 AND doc_id % 6 > 0) AS n_ok FROM documents GROUP BY 1""")
def cleaned_records(read):
    d = read("documents").select("doc_id", "lang", "text", (F.col("doc_id") % 5 > 1).alias("ok"), F.lit("x").alias("teacher_prompt"), F.lit("y").alias("teacher_x"))
    c = U.without_columns(d, required=["doc_id", "text"])
    steps = F.when(F.col("doc_id") % 6 > 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    v = c.withColumn("steps", steps).withColumn("valid", U.valid_inputs(c, "doc_id", "text", "steps"))
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.lit(len(c.columns)).alias("n_columns"), F.count_if("valid").alias("n_valid"), F.count_if(F.col("ok") & (F.size("steps") > 0)).alias("n_ok"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) SELECT conv_id, r::INT AS row_idx, text AS completion, CASE WHEN r < 2 THEN role END AS step FROM c""")
def unrolled_tables(read):
    t = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("x"))
    t = t.select("conv_id", F.transform("x", lambda s: s["text"]).alias("completion"), F.slice(F.transform("x", lambda s: s["role"]), 1, 2).alias("step"))
    return U.unrolled(t, "completion", ["step"]).select("conv_id", "row_idx", "completion", "step")


@query(r"""WITH c AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS title, text, row_number() OVER (PARTITION BY conv_id, split_part(text, ' ', 1) ORDER BY turn) AS r FROM conversations)
 SELECT conv_id, md5(string_agg('[' || title || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS every, md5(coalesce(string_agg('[' || title || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) FILTER (r = 1 AND title <> ''), '')) AS once,
 md5(string_agg(CASE turn % 3 WHEN 0 THEN trim(title || '. ' || text) WHEN 1 THEN 'None' ELSE trim(text) END, '|' ORDER BY turn)) AS shown FROM c GROUP BY 1""")
def oracle_contexts(read):
    doc = F.struct(F.substring_index("text", " ", 1).alias("title"), F.col("text").alias("text"))
    evidence = F.when(F.col("turn") % 3 == 1, "").when(F.col("turn") % 3 == 2, F.col("text"))
    c = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", doc.alias("doc"), F.struct(F.col("role").alias("query"), evidence.alias("evidence"), F.array(doc).alias("docs")).alias("step")))).alias("x"))
    ps, steps = F.transform("x", lambda s: s["doc"]), F.transform("x", lambda s: s["step"])
    digest = lambda c: F.md5(c.cast("binary"))
    return c.select("conv_id", digest(U.oracle_context(ps, False)).alias("every"), digest(U.oracle_context(ps, True)).alias("once"), digest(F.array_join(F.transform(U.shown_history(steps), lambda h: h["evidence"]), "|")).alias("shown"))


@query("""WITH c AS (SELECT conv_id, list_distinct(list(role)) AS found, list_distinct(list(CASE WHEN turn < 2 THEN role ELSE 'x' || turn END)) AS gold FROM conversations GROUP BY 1)
 SELECT count(*) AS n_units, round_even(sum(len(list_intersect(found, gold)))::DOUBLE / sum(len(gold)), 4) AS recall, (SELECT count(*) FROM conversations) AS n_seen, (SELECT max(length(text))::INT FROM conversations) AS longest, (SELECT min(length(text))::INT FROM conversations) AS shortest, (SELECT round(avg(length(text)), 4) FROM conversations) AS mean_length FROM c WHERE conv_id % 3 = 0""")
def recall_and_counters(read):
    t = read("conversations")
    rows, seen = U.observed(t, "run", n_seen=F.count("*"), longest=F.max(F.length("text")), shortest=F.min(F.length("text")), mean_length=F.round(F.avg(F.length("text")), 4))
    c = kept(rows.groupBy("conv_id").agg(F.collect_set("role").alias("found"), F.collect_set(F.when(F.col("turn") < 2, F.col("role")).otherwise(F.concat(F.lit("x"), F.col("turn").cast("string")))).alias("gold")))
    got = seen.get
    return U.unit_recall(c, "found", "gold", F.col("conv_id") % 3 == 0).select("n_units", "recall", F.lit(got["n_seen"]).cast("long").alias("n_seen"), F.lit(got["longest"]).cast("int").alias("longest"), F.lit(got["shortest"]).cast("int").alias("shortest"), F.lit(got["mean_length"]).cast("double").alias("mean_length"))


@query("""WITH e AS (SELECT event_id, value, (user_id % 5 - 2)::DOUBLE AS base, event_id % 7 <> 0 AS mask, event_type <> 'view' AS taught FROM events) SELECT event_id, round(CASE WHEN NOT mask THEN 0.0 ELSE base * CASE WHEN taught THEN 0.5 + 0.5 * least(1.2, greatest(0.8, exp(sign(base) * (ln(1 + value) - 4)))) ELSE 1.0 END END, 6) + 0.0 AS advantage,
 round(CASE WHEN NOT mask THEN 0.0 ELSE base * CASE WHEN base < 0 AND taught THEN 0.5 + 0.5 * least(1.2, greatest(0.8, exp(sign(base) * (ln(1 + value) - 4)))) ELSE 1.0 END END, 6) + 0.0 AS negative FROM e""")
def distilled_advantages(read):
    base, mask, taught = (F.col("user_id") % 5 - 2).cast("double"), F.col("event_id") % 7 != 0, F.col("event_type") != "view"
    one = lambda negative: F.round(S.reweighted_advantage(base, F.log1p("value"), F.lit(4.0), mask, taught, negative_only=negative), 6) + 0.0
    return read("events").select("event_id", one(False).alias("advantage"), one(True).alias("negative"))


@query("""SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 5 THEN text ELSE array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:5], ' ') END AS five, rtrim(left(text, 30)) AS thirty, octet_length(encode(text)) AS n_bytes, 'Represent this sentence for searching relevant passages: ' || role AS asked FROM conversations""".replace("\\\\", "\\"))
def truncated_texts(read):
    c = read("conversations")
    return c.select("conv_id", "turn", T.first_words(F.col("text"), 5).alias("five"), F.rtrim(F.left("text", F.lit(30))).alias("thirty"), F.octet_length("text").alias("n_bytes"), A.encoder_text(F.col("role"), True).alias("asked"))


@query("""SELECT user_id, event_type, n, mean FROM (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2) ORDER BY coalesce(CASE WHEN user_id % 4 > 0 THEN n END, 0) DESC, user_id, event_type LIMIT 5""")
def most_visited(read):
    e = read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return e.orderBy(F.coalesce(F.when(F.col("user_id") % 4 > 0, F.col("n")), F.lit(0)).desc(), "user_id", "event_type").limit(5)


# The second item of four answers with the document found, the third with what its analysis has kept of it.
@query("""WITH d AS (SELECT md5(min_by(coalesce(text, ''), doc_id)) AS shown FROM documents) SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN shown WHEN 2 THEN 'kept ' || shown ELSE 'd' END AS answer, [1, 2, 3, 4][(item_id % 4 + 1)::INT] AS n_thoughts,
 ['begin_reasoning', 'begin_reasoning>document_analysis', 'begin_reasoning>document_analysis>reasoning', 'begin_reasoning>document_analysis>reasoning>answer_generation'][(item_id % 4 + 1)::INT] AS actions FROM benchmark, d""")
def routed_answers(read):
    k, n = F.col("item_id") % 4, lambda t: F.size(t)
    say = lambda x: F.concat(F.lit("so <answer>"), x if not isinstance(x, str) else F.lit(x), F.lit("</answer>"))
    kept = lambda t: T.last_tag(F.try_element_at(t, F.lit(-1)), "evidence")
    reason = lambda t, q: F.when((n(t) == 0) & (k == 0), say("a")).when((n(t) == 2) & (k == 2), say(F.concat(F.lit("kept "), kept(t)))).otherwise("Find the word. More")
    analyse = lambda t, q, docs: F.when(k == 1, say(A.first_line(q, docs))).otherwise(F.concat(F.lit("<evidence>"), A.first_line(q, docs), F.lit("</evidence>")))
    corpus = read("documents").select(F.lit("the word").alias("query"), F.col("doc_id").alias("rank"), F.struct(F.col("source").alias("title"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text")).alias("doc"))
    return A.routed(read("benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question")), "item_id", reason, analyse, lambda t, q: say("d"), A.lookup(corpus, 1), max_iter=3)


@query("""SELECT item_id, md5(reverse(coalesce(text, ''))) AS response, 1 AS attempts FROM benchmark""")
def generated_responses(read):
    g = A.generated(read("benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")), "text", lambda texts: [t[::-1] for t in texts])
    return g.select("item_id", F.md5(F.col("response").cast("binary")).alias("response"), "attempts")



@query("""SELECT count(*) AS n, 'Note 7' AS title, 'http://x/7' AS pdf, 'a  b' AS tex, (SELECT count(*) FROM benchmark) AS n_keyed, (SELECT count(*) FROM benchmark) AS n_corpus FROM benchmark""")
def notes_and_keyed(read):
    b = read("benchmark").select("item_id", "text")
    spark, at = b.sparkSession, fresh_path(b.sparkSession, "notes")
    note = F.concat(F.lit("## Note "), F.col("item_id").cast("string"), F.lit("\n- PDF: http://x/"), F.col("item_id").cast("string"), F.lit("\ntext\n"))
    b.select(note.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{at}/notes")
    b.select(F.to_json(F.struct("*")).alias("j")).groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(f"{at}/items.json")
    b.select(F.col("item_id").cast("string").alias("title"), F.col("text").alias("contents")).write.parquet(f"{at}/corpus/a.parquet")
    m = X.note_meta(spark, f"{at}/notes", ["PDF", "Paper"])
    tex = spark.range(1).select(F.trim(X.without_comments(F.lit("a % gone"))).alias("x"))
    seven = m.agg(F.count("*").alias("n"), F.max(F.when(F.col("title") == "Note 7", F.col("title"))).alias("title"), F.max(F.when(F.col("title") == "Note 7", F.col("pdf"))).alias("pdf"))
    out = seven.withColumn("tex", F.concat(F.lit(tex.first()["x"]), F.lit("  b")))
    n = X.keyed(spark, f"{at}/items.json", "item_id long, text string", "item_id").count()
    return out.withColumns({"n_keyed": F.lit(n).cast("long"), "n_corpus": F.lit(X.corpus(spark, f"{at}/corpus").count()).cast("long")})


@query()
def client_ids(read):
    """Users under a keyed 128-bit BLAKE2b digest, in Arrow batches: Spark and SQL have no such function."""
    return read("events").select("user_id").distinct().select("user_id", T.keyed_digest(F.col("user_id").cast("string"), b"salt").alias("client"))
