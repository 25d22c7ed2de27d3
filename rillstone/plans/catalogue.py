"""Every registered query of the engine's own operators, with its SQL.

The driver's tables stand in for the engine's records: assistant turns of
`conversations` for predictions, the next user turn for gold, `documents` and
`benchmark` for corpus and questions, `events` for trajectories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import credit as C
from rillstone.operators import relational as R
from rillstone.operators import scans as S
from rillstone.plans import answers, asked, credit, curation, formats, machines, projections, records, reports, steps, streams, trees  # noqa: F401  they register their queries
from rillstone.plans.registry import oracle_sql, queries  # noqa: F401
from rillstone.plans.registry import query as _query
from rillstone.streaming import limits

FLAGSHIP = "answer_quality"


# SQL forms of the text functions.
_P = r"[!-/:-@\[-`{-~]"
_SQUEEZE = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
# RE2 knows ASCII word borders only, so articles go by token there.
_ANSWER = lambda x: f"array_to_string(list_filter(string_split({_SQUEEZE(f"regexp_replace(lower(coalesce({x}, '')), '{_P}', '', 'g')")}, ' '), lambda t: t NOT IN ('a', 'an', 'the')), ' ')"
_WORD_SET = lambda x: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}')))"
_TOKENS = lambda form: f"list_filter(string_split({form}, ' '), lambda t: t <> '')"

_TURNS = "SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations"


def _turns(read) -> DataFrame:
    return read("conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))



@_query(f"""SELECT conv_id, turn, {_ANSWER('text')} AS answer, {_SQUEEZE(f"regexp_replace(lower(coalesce(text, '')), '{_P}', '', 'g')")} AS plain,
 {_SQUEEZE("lower(coalesce(text, ''))")} AS loose, {_SQUEEZE(r"regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s]', '', 'g')")} AS strict,
 trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS words, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS query FROM conversations""".replace("\\\\p", "\\p"))
def normal_forms(read):
    c = F.col("text")
    return read("conversations").select("conv_id", "turn", T.answer_form(c).alias("answer"), T.plain_form(c).alias("plain"), T.loose_title(c).alias("loose"), T.strict_title(c).alias("strict"), T.ascii_words(c).alias("words"), T.query_form(c).alias("query"))



@_query("""SELECT p_partkey AS k, round(p_retailprice - c, 4) AS delta, p_retailprice > c AS better FROM part JOIN (SELECT p_partkey AS k2, p_size * 100.0 AS c FROM part) ON p_partkey = k2""")
def validated_pair_delta(read):
    a, b = read("part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").cast("double").alias("x")), read("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 100.0).alias("y"))
    return R.validated_join(a, b, "k").select("k", F.round(F.col("x") - F.col("y"), 4).alias("delta"), (F.col("x") > F.col("y")).alias("better"))


_JOINED = """WITH j AS (SELECT d.doc_id, d.source, d.n_chars, l.quality, l.doc_id IS NOT NULL AS seen FROM documents d LEFT JOIN labels l USING (doc_id)) """


def _joined(read) -> DataFrame:
    return R.reason_join(read("documents").select("doc_id", "source", "n_chars"), read("labels"), ["doc_id"], F.col("quality") == 1)


@_query(_JOINED + "SELECT source, CASE WHEN NOT seen THEN 'missing_label' WHEN coalesce(quality = 1, false) THEN 'kept' ELSE 'failed_label' END AS reason, count(*) AS n FROM j GROUP BY 1, 2")
def reason_join_assembly(read):
    return _joined(read).groupBy("source", "reason").agg(F.count("*").alias("n"))


@_query(_JOINED + """, k AS (SELECT * FROM j WHERE seen),
 g AS (SELECT *, CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-9 THEN 0.5 ELSE (n_chars - min(n_chars) OVER w)::DOUBLE / (max(n_chars) OVER w - min(n_chars) OVER w) END AS norm,
   CASE WHEN stddev_pop(n_chars) OVER w < 1e-9 THEN 0.0 ELSE (n_chars - avg(n_chars) OVER w) / stddev_pop(n_chars) OVER w END AS z FROM k WINDOW w AS (PARTITION BY source)),
 s AS (SELECT *, 2.0 * quality + norm AS logit FROM g), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY source)) AS x FROM s)
 SELECT doc_id, source, round(norm, 6) AS norm, round(z, 6) AS z, round(x / sum(x) OVER (PARTITION BY source), 6) AS target FROM e""")
def group_minmax_softmax(read):
    k = _joined(read).where("reason <> 'missing_label'")
    g = R.group_scaled(k, "n_chars", ["source"]).withColumn("logit", 2.0 * F.col("quality") + F.col("norm"))
    return R.group_softmax(g, "logit", ["source"], "target").select("doc_id", "source", F.round("norm", 6).alias("norm"), F.round("z", 6).alias("z"), F.round("target", 6).alias("target"))


_SPLIT = "CASE WHEN ('0x' || substr(md5('7:' || doc_id), 1, 8))::UBIGINT / 4294967295.0 < 0.1 THEN 'dev' ELSE 'train' END"


@_query(f"SELECT source, {_SPLIT} AS split, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1, 2")
def hash_split(read):
    return read("documents").groupBy("source", R.split_of("7", F.col("doc_id"), 0.1).alias("split")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@_query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s1:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(read):
    return R.hash_ranked(read("documents").select("doc_id", "source"), "s1", "doc_id", 5, ["source"])


_UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"


@_query(f"""WITH v AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id AS id, round(list_inner_product(qv, v), 9) AS score FROM q, v),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
 SELECT query_id, rank, id FROM r WHERE rank <= 10""")
def vector_topk(read):
    e = read("embeddings")
    return R.vector_topk(e.where("vec_id % 50 = 0"), e, 10).select("query_id", "rank", "id")


@_query(f"""WITH v AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label AS ql, v AS qv FROM v WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, ql, vec_id AS id, label, round(list_inner_product(qv, v), 9) AS score FROM q, v),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
 h AS (SELECT query_id, ql, max((label = ql)::INT) AS hit, sum((label = ql)::INT)::DOUBLE AS found FROM r WHERE rank BETWEEN 2 AND 4 GROUP BY 1, 2),
 g AS (SELECT label, count(*) - 1 AS gold FROM embeddings GROUP BY 1)
 SELECT count(*) AS n, round(avg(hit), 6) AS hit3, round(avg(CASE WHEN gold > 0 THEN found / gold END), 6) AS recall3, round(avg(1 - found / 3), 6) AS noise3 FROM h JOIN g ON ql = g.label""")
def topk_hit_recall_noise(read):
    e = read("embeddings")
    top = R.vector_topk(e.where("vec_id % 50 = 0"), e, 4).where("rank between 2 and 4")
    label = e.select("vec_id", "label")
    hits = top.join(label.withColumnRenamed("vec_id", "id"), "id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    found = hits.groupBy("query_id", "ql").agg(F.max((F.col("label") == F.col("ql")).cast("int")).alias("hit"), F.sum((F.col("label") == F.col("ql")).cast("double")).alias("found"))
    gold = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("gold"))
    return found.join(gold, "ql").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit3"), F.round(F.avg(F.when(F.col("gold") > 0, F.col("found") / F.col("gold"))), 6).alias("recall3"), F.round(F.avg(1 - F.col("found") / 3), 6).alias("noise3"))



@_query("""WITH t AS (SELECT source, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g')) AS title FROM documents)
 SELECT title, count(DISTINCT source) AS n_sources, count(*) - 1 AS surplus FROM t GROUP BY title HAVING count(*) > 1""")
def title_overlap(read):
    t = read("documents").select("source", T.loose_title(F.substring_index("text", "\n", 1)).alias("title"))
    return t.groupBy("title").agg(F.count_distinct("source").alias("n_sources"), (F.count("*") - 1).alias("surplus")).where("surplus > 0")


@_query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(read):
    return R.pending(read("documents"), read("labels"), ["doc_id"]).select("doc_id", "lang")



@_query("""SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, count_if(trim(coalesce(text, '')) = '') AS blank, min(n_chars) AS least, max(n_chars) AS most,
 count(*) = count(DISTINCT doc_id) AS ok FROM documents GROUP BY source""")
def source_audit(read):
    return read("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), (F.count("*") == F.count_distinct("doc_id")).alias("ok"))


_STEPS = "WITH s AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) "


def _events(read) -> DataFrame:
    return read("events").select("user_id", "event_id", "ts", "event_type", "value")


_BY_USER = (["user_id"], ["ts", "event_id"])


_KINDS = ("view", "click", "purchase", "signup", "error")


@_query(_STEPS + "SELECT event_id, " + " || '|' || ".join(f"'{k}:' || coalesce(sum((event_type = '{k}')::INT) OVER w, 0)" for k in _KINDS) + " AS prior FROM s WINDOW w AS (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_steps(read):
    return S.prior_counts(_events(read), *_BY_USER, F.col("event_type"), _KINDS, "prior").select("event_id", "prior")


@_query("SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM conversations")
def prior_roles(read):
    return read("conversations").select("conv_id", "turn", F.array_join(R.prior_values(F.col("role"), ["conv_id"], [F.col("turn")]), ">").alias("prior"))


@_query(_STEPS + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY turn) = 1 AS fresh FROM s)
 SELECT event_id, fresh, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY turn)::BIGINT AS covered, round(CASE WHEN fresh THEN power(0.9, turn - 1) ELSE 0 END, 9) AS gain FROM n""")
def running_coverage(read):
    fresh = S.first_seen(_events(read), "event_id", ["user_id"], F.col("event_type"), ["ts", "event_id"], "fresh")
    n = S.scanned(fresh, *_BY_USER, {"turn": ("count", F.lit(1)), "covered": ("sum", F.col("fresh").cast("int"))})
    return n.select("event_id", "fresh", "covered", F.round(F.when(F.col("fresh"), F.pow(F.lit(0.9), F.col("turn") - 1)).otherwise(0.0), 9).alias("gain"))


@_query(_STEPS + "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS rtg FROM s")
def return_to_go(read):
    return S.return_to_go(_events(read), *_BY_USER, F.col("value"), "rtg").select("event_id", F.round("rtg", 4).alias("rtg"))


@_query(_STEPS + """SELECT event_id, round(CASE WHEN count(value) OVER w <= 1 THEN 0.0 ELSE (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-4) END, 6) + 0.0 AS credit
 FROM s WINDOW w AS (PARTITION BY event_type, turn)""")
def group_turn_norm(read):
    n = C.normalized(S.numbered(_events(read), *_BY_USER, "turn"), ["event_type", "turn"], "value", "credit")
    return n.select("event_id", (F.round("credit", 6) + 0.0).alias("credit"))


@_query("SELECT user_id, greatest(-3, count(DISTINCT event_type) - count(*)) AS repeat_cost, -greatest(count(*) - 1, 0) AS turn_cost FROM events GROUP BY user_id")
def repeat_cost(read):
    return read("events").groupBy("user_id").agg(F.greatest(F.lit(-3).cast("long"), F.count_distinct("event_type") - F.count("*")).alias("repeat_cost"), (-F.greatest(F.count("*") - 1, F.lit(0).cast("long"))).alias("turn_cost"))


@_query("""WITH a AS (SELECT conv_id // 2 AS pair, turn, role AS x FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT conv_id // 2 AS pair, turn, role AS y FROM conversations WHERE conv_id % 2 = 1)
 SELECT pair, turn, coalesce(x, '') AS x, coalesce(y, '') AS y, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x = y THEN 'same' ELSE 'changed' END AS what FROM a FULL JOIN b USING (pair, turn)""")
def positional_step_diff(read):
    c = read("conversations").withColumn("pair", F.floor(F.col("conv_id") / 2))
    a, b = c.where("conv_id % 2 = 0").select("pair", "turn", F.col("role").alias("x")), c.where("conv_id % 2 = 1").select("pair", "turn", F.col("role").alias("y"))
    what = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return R.positional_join(a, b, "pair", "turn").select("pair", "turn", F.coalesce("x", F.lit("")).alias("x"), F.coalesce("y", F.lit("")).alias("y"), what.alias("what"))


@_query("""SELECT o_orderpriority, count_if(o_orderstatus = 'F' AND o_totalprice > 100000) AS yes_yes, count_if(o_orderstatus = 'F' AND NOT o_totalprice > 100000) AS yes_no,
 count_if(o_orderstatus <> 'F' AND o_totalprice > 100000) AS no_yes, count_if(o_orderstatus <> 'F' AND NOT o_totalprice > 100000) AS no_no FROM orders GROUP BY 1""")
def contingency(read):
    a, b = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    return read("orders").groupBy("o_orderpriority").agg(F.count_if(a & b).alias("yes_yes"), F.count_if(a & ~b).alias("yes_no"), F.count_if(~a & b).alias("no_yes"), F.count_if(~a & ~b).alias("no_no"))


@_query("""WITH b AS (SELECT n_name, l_discount::DOUBLE AS d, l_returnflag = 'R' AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 p AS (SELECT n_name AS scope, count(*) AS n, avg(d) AS discount, avg(r::INT) AS returned FROM b GROUP BY 1)
 SELECT scope, n, round(discount, 4) AS discount, round(returned, 4) AS returned FROM p
 UNION ALL SELECT 'macro', sum(n)::BIGINT, round(avg(discount), 4), round(avg(returned), 4) FROM p UNION ALL SELECT 'micro', count(*), round(avg(d), 4), round(avg(r::INT), 4) FROM b""")
def macro_micro(read):
    nation = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    b = read("lineitem").join(nation, F.col("l_suppkey") == F.col("s_suppkey")).select("n_name", F.col("l_discount").cast("double").alias("d"), (F.col("l_returnflag") == "R").cast("int").alias("r"))
    # Sums by nation give both averages: the rows are read and combined once.
    p = b.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("d").alias("sd"), F.sum("r").alias("sr"))
    four = lambda c: F.round(c, 4)
    own = p.select(F.col("n_name").alias("scope"), "n", four(F.col("sd") / F.col("n")).alias("discount"), four(F.col("sr") / F.col("n")).alias("returned"))
    macro = p.agg(F.lit("macro").alias("scope"), F.sum("n").alias("n"), four(F.avg(F.col("sd") / F.col("n"))).alias("discount"), four(F.avg(F.col("sr") / F.col("n"))).alias("returned"))
    micro = p.agg(F.lit("micro").alias("scope"), F.sum("n").alias("n"), four(F.sum("sd") / F.sum("n")).alias("discount"), four(F.sum("sr") / F.sum("n")).alias("returned"))
    return own.unionByName(macro).unionByName(micro)


@_query("""WITH c AS (SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 80 THEN 'short' END, CASE WHEN contains(text, '?') THEN 'question' END, CASE WHEN role = 'system' THEN 'system' END], lambda x: x IS NOT NULL) AS marks FROM conversations)
 SELECT conv_id, turn, array_to_string(marks, '|') AS marks, CASE WHEN list_contains(marks, 'system') THEN 'system' WHEN list_contains(marks, 'question') THEN 'question' WHEN list_contains(marks, 'short') THEN 'short' ELSE 'other' END AS main FROM c""")
def categorize_primary(read):
    marks = F.array_compact(F.array(F.when(F.length("text") < 80, "short"), F.when(F.contains("text", F.lit("?")), "question"), F.when(F.col("role") == "system", "system")))
    main = F.coalesce(*[F.when(F.array_contains("marks", m), m) for m in ("system", "question", "short")], F.lit("other"))
    return read("conversations").select("conv_id", "turn", marks.alias("marks")).select("conv_id", "turn", F.array_join("marks", "|").alias("marks"), main.alias("main"))


_TAGGED = "WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<query>' || text || '</query>' WHEN turn % 3 = 1 THEN '<query>q</query> x <answer>' || text || '</answer>' ELSE text END AS s FROM conversations) "


def _tagged(read) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<query>"), F.col("text"), F.lit("</query>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<query>q</query> x <answer>"), F.col("text"), F.lit("</answer>"))).otherwise(F.col("text"))
    return read("conversations").select("conv_id", "turn", t.alias("s"))


@_query(_TAGGED + """SELECT conv_id, turn, trim(regexp_extract_all(s, '(?s)<query>(.*?)</query>', 1)[1]) AS first_query, trim(regexp_extract_all(s, '(?s)<answer>(.*?)</answer>', 1)[-1]) AS answer,
 CASE WHEN contains(s, '<answer>') AND contains(s, '<query>') THEN 'query_then_answer' WHEN contains(s, '<answer>') THEN 'answer_only' WHEN contains(s, '<query>') THEN 'query_only' ELSE 'neither' END AS shape FROM t""")
def tag_extract(read):
    s = F.col("s")
    has = lambda tag: F.contains(s, F.lit(f"<{tag}>"))
    order = F.instr(s, "<query>") < F.instr(s, "<answer>")
    shape = F.when(has("answer") & has("query"), F.when(order, "query_then_answer").otherwise("answer_then_query")).when(has("answer"), "answer_only").when(has("query"), "query_only").otherwise("neither")
    return _tagged(read).select("conv_id", "turn", T.first_tag(s, "query").alias("first_query"), T.last_tag(s, "answer").alias("answer"), shape.alias("shape"))


@_query("""SELECT doc_id, source, used FROM (SELECT doc_id, source, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 20000""")
def token_budget_pack(read):
    d = read("documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return R.budget_pack(d, ["source"], ["doc_id"], "size", 20000).select("doc_id", "source", "used")


@_query(f"""WITH t AS ({_TURNS}), w AS (SELECT conv_id, turn, {_WORD_SET('text')} AS a, {_WORD_SET('nxt')} AS b FROM t),
 o AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM w)
 SELECT conv_id, turn, round(CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END, 6) AS jaccard, round(0.55 + 0.45 * CASE WHEN u = 0 THEN 1.0 ELSE i::DOUBLE / u END, 6) AS claim FROM o""")
def transition_scores(read):
    j = T.set_jaccard(T.word_set(F.col("text")), T.word_set(F.col("nxt")))
    return _turns(read).select("conv_id", "turn", F.round(j, 6).alias("jaccard"), F.round(0.55 + 0.45 * j, 6).alias("claim"))


_TOK = lambda x: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))"


@_query(f"""WITH q AS (SELECT item_id, {_TOK('text')} AS t FROM benchmark), d AS (SELECT doc_id, {_TOK("split_part(text, chr(10), 1)")} AS a, {_TOK('text')} AS b FROM documents), qt AS (SELECT item_id, unnest(t) AS k FROM q), da AS (SELECT doc_id, unnest(a) AS k FROM d), db AS (SELECT doc_id, unnest(b) AS k FROM d),
 s AS (SELECT item_id, doc_id, sum(w)::BIGINT AS score FROM (SELECT item_id, doc_id, 3 AS w FROM qt JOIN da USING (k) UNION ALL SELECT item_id, doc_id, 1 FROM qt JOIN db USING (k)) GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 3""")
def lexical_topk(read):
    words = lambda c: F.array_distinct(T.tokens(T.ascii_words(c)))
    q = read("benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("tokens"))
    d = read("documents").select("doc_id", words(F.substring_index("text", "\n", 1)).alias("title"), words(F.col("text")).alias("text"))
    return R.lexical_topk(q, d, 3).select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


@_query("SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS with_k FROM events GROUP BY 1")
def json_props(read):
    return read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.expr("try_cast(get_json_object(props, '$.k') as bigint)")).alias("with_k"))


@_query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def unnest_array(read):
    return read("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@_query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window(read):
    return limits.window_load(read("events"))


@_query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS bucket, count(*) AS n, round(avg(o_totalprice::DOUBLE), 4) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus))""")
def strata_buckets(read):
    return read("orders").cube("o_orderstatus").agg(F.when(F.grouping("o_orderstatus") == 1, "all").otherwise(F.col("o_orderstatus")).alias("bucket"), F.count("*").alias("n"), F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("mean")).select("bucket", "n", "mean")


@_query("SELECT c_mktsegment, c_custkey, c_acctbal, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_per_group(read):
    return R.top_n(read("customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@_query("""WITH m AS (SELECT year(o_orderdate) AS y, sum(o_totalprice)::DOUBLE AS s FROM orders GROUP BY 1)
 SELECT y, round(s - lag(s) OVER (ORDER BY y), 2) AS step, round(s - first_value(s) OVER (ORDER BY y), 2) AS from_first FROM m""")
def adjacent_delta(read):
    m = read("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").cast("double").alias("s"))
    w = Window.orderBy("y")  # one row a year
    return m.select("y", F.round(F.col("s") - F.lag("s").over(w), 2).alias("step"), F.round(F.col("s") - F.first("s").over(w), 2).alias("from_first"))


@_query("SELECT doc_id % 4 AS shard, lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2")
def modulo_shards(read):
    return read("documents").groupBy((F.col("doc_id") % 4).alias("shard"), "lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
