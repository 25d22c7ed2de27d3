"""Queries over retrieval steps: text functions, transitions, selectors, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.functions import scoring as S
from rillstone.functions import text as T
from rillstone.operators import relational as R
from rillstone.plans.answers import P, TURNS, answer_tokens, squeeze, turns
from rillstone.plans.registry import query

ASCII = lambda x: rf"regexp_replace(coalesce({x}, ''), '[^\x00-\x7F]', 'x', 'g')"
PLAIN = lambda x: squeeze(f"regexp_replace(lower(coalesce({x}, '')), '{P}', '', 'g')")
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
CONTENT = lambda x: f"list_distinct(list_filter(string_split({PLAIN(x)}, ' '), lambda t: length(t) > 1 AND t NOT IN {STOP}))"
ALL = lambda x, p: f"regexp_extract_all({x}, '{p}', 1)"
ENTITIES = lambda x: (
    f"list_distinct(list_concat(list_concat({ALL(x, r'\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b')}, list_filter({ALL(x, r'\b([A-Z][a-z]+)\b')}, lambda w: lower(w) NOT IN {STOP})), "
    f"list_concat({ALL(x, r'\b(\d{3,4})\b')}, list_filter(list_transform({ALL(x, '"([^"]+)"')}, lambda q: trim(q)), lambda q: q <> ''))))"
)
WORDS = lambda x: rf"list_distinct({ALL(f"lower(coalesce({x}, ''))", r'\b([a-z]{3,})\b')})"
JOINED = lambda a: f"coalesce(array_to_string(list_sort({a}), '|'), '')"
JACCARD = lambda a, b: f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
OVERLAP = lambda a, b: f"(CASE WHEN len({a}) = 0 THEN CASE WHEN len({b}) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END)"
LAST = lambda x, tag: rf"coalesce(trim(regexp_extract_all({x}, '(?s)<{tag}>(.*?)</{tag}>', 1)[-1]), '')"


@query(rf"""WITH t AS (SELECT conv_id, turn, text, {ASCII('text')} AS a FROM conversations)
 SELECT conv_id, turn, {squeeze(r"regexp_replace(regexp_replace(lower(a), '\b(a|an|the)\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')")} AS case_form, {squeeze("text")} AS collapsed, replace(lower({squeeze("nfc_normalize(text)")}), 'ß', 'ss') AS folded,
 {JOINED(CONTENT('a'))} AS content, {JOINED(ENTITIES('a'))} AS entities, {JOINED("list_distinct(list_transform(" + ALL('a', r'\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b') + ", lambda w: lower(w)))")} AS runs,
 role_sig AS signature, coalesce(regexp_extract_all(a, '([+-]?\d+)', 1)[-1]::DOUBLE, -1) AS last_number, coalesce(least(100.0, greatest(0.0, regexp_extract_all(a, '([0-9]+\.?[0-9]*)', 1)[-1]::DOUBLE)), 50.0) AS score
 FROM t JOIN (SELECT conv_id, turn, {squeeze("lower(role)")} || '|' || {squeeze("lower(text)")} AS role_sig FROM conversations) USING (conv_id, turn)""")
def text_forms(read):
    c = read("conversations").withColumn("a", T.ascii_form(F.col("text")))
    a, joined = F.col("a"), lambda x: F.array_join(F.array_sort(x), "|")
    return c.select(
        "conv_id", "turn", T.case_form(a).alias("case_form"), T.collapsed(F.col("text")).alias("collapsed"), T.folded(F.col("text")).alias("folded"), joined(T.content_tokens(a)).alias("content"), joined(T.entities(a)).alias("entities"), joined(T.capital_runs(a)).alias("runs"),
        T.signature(F.col("role"), F.col("text")).alias("signature"), F.coalesce(T.last_number(a), F.lit(-1.0)).alias("last_number"), T.stated_score(a).alias("score"),
    )


# Responses with tags around whole turns.
_RESPONSES = f"""r AS (SELECT conv_id, turn, role, {ASCII('text')} AS t, {ASCII('nxt')} AS n, CASE turn % 6 WHEN 0 THEN 'So the next query is <query>' || {ASCII('text')} || '</query>' WHEN 1 THEN 'Based on the query, the relevant evidence is <evidence>' || {ASCII('text')} || '</evidence>'
 WHEN 2 THEN 'To answer this question, we look. Conclusion: ' || {ASCII('text')} WHEN 3 THEN {ASCII('text')} || ' So the answer is <answer>' || {ASCII("split_part(text, chr(10), 1)")} || '</answer>' WHEN 4 THEN '<answer>' || {ASCII('text')} || '</answer> <query>' || role ELSE '<evidence> None </evidence>' || {ASCII('text')} END AS s
 FROM ({TURNS}))"""


def responses(read):
    a, k = T.ascii_form(F.col("text")), F.col("turn") % 6
    first = T.ascii_form(F.substring_index("text", "\n", 1))
    s = (
        F.when(k == 0, F.concat(F.lit("So the next query is <query>"), a, F.lit("</query>"))).when(k == 1, F.concat(F.lit("Based on the query, the relevant evidence is <evidence>"), a, F.lit("</evidence>")))
        .when(k == 2, F.concat(F.lit("To answer this question, we look. Conclusion: "), a)).when(k == 3, F.concat(a, F.lit(" So the answer is <answer>"), first, F.lit("</answer>")))
        .when(k == 4, F.concat(F.lit("<answer>"), a, F.lit("</answer> <query>"), F.col("role"))).otherwise(F.concat(F.lit("<evidence> None </evidence>"), a))
    )
    return turns(read).select("conv_id", "turn", "role", a.alias("t"), T.ascii_form(F.col("nxt")).alias("n"), s.alias("s"))


_NOTAGS = lambda x: "regexp_replace(" * 6 + x + "".join(rf", '(?is)<{t}[^>]*>.*?</{t}>', '', 'g')" for t in ("answer", "query", "evidence", "reference", "information")) + rf", '(?i)</?({T._TAGS})[^>]*>?', '', 'g')"
_TIDY = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{2,}}', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_EVID = r"regexp_replace(regexp_extract_all(s, '(?is)<evidence[^>]*>(.*?)</evidence>', 1)[-1], '^\s+|\s+$', '', 'g')"
_SAID = lambda: _NOTAGS("s")


def _cleaned() -> str:
    t = _NOTAGS("s")
    for p in (*[f"(?i){x}" for x in T._PHRASES],):
        t = f"regexp_replace({t}, '{p}', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)(^|[\s\.])({T._HEADINGS})\s*[:：]\s*', '\1', 'g')"
    return f"regexp_replace({t}, '(?i){T._OPENING.replace("'", "''")}', '')"


# Shapes by where the last whole tags begin, from 1; 0 without one.
_AT = lambda t: f"(CASE WHEN regexp_matches(s, '(?s)<{t}>.*?</{t}>') THEN length(regexp_extract(s, '(?s)^(.*)<{t}>.*?</{t}>', 1)) + 1 ELSE 0 END)"
_COUNT = lambda x: f"(len(string_split(s, '{x}')) - 1)"
_SHAPE = f"""CASE WHEN {_AT('query')} = 0 AND {_AT('answer')} = 0 THEN 'neither' WHEN {_AT('query')} = 0 THEN 'answer_only' WHEN {_AT('answer')} = 0 THEN 'query_only' WHEN {_AT('answer')} > {_AT('query')} THEN 'query_then_answer' ELSE 'answer_then_query' END"""
_FORMAT = f"({_AT('answer')} > {_AT('query')} AND {LAST('s', 'answer')} <> '')"
_OLD_FORMAT = f"({_AT('answer')} > 0 AND {_AT('query')} = 0)"
_SINGLE = " AND ".join(f"{_COUNT(f'<{t}>')} = {_COUNT(f'</{t}>')}" for t in ("query", "answer", "evidence")) + f" AND {_COUNT('</query>')} + {_COUNT('</answer>')} = 1"


_WORDS25 = lambda x: rf"(CASE WHEN len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')) <= 25 THEN {x} ELSE array_to_string(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')[1:25], ' ') END)"


@query(rf"""WITH {_RESPONSES}, e AS (SELECT *, CASE WHEN {_EVID} <> '' AND lower({_EVID}) <> 'none' THEN {_EVID} END AS ev, {_cleaned()} AS cl FROM r), f AS (SELECT *, {_TIDY('coalesce(ev, cl)')} AS th FROM e)
 SELECT conv_id, turn, ev AS evidence, {_WORDS25('th')} AS thought, {LAST('s', 'answer')} AS last_answer, {LAST('s', 'query')} AS last_query,
 CASE WHEN contains(s, '<query>') THEN 'query' WHEN contains(s, '<answer>') THEN 'answer' WHEN contains(s, '<evidence>') THEN 'evidence' ELSE 'other' END AS action,
 {_SHAPE} AS shape, {_FORMAT}::DOUBLE AS format, {_OLD_FORMAT}::DOUBLE AS old_format,
 CASE WHEN contains(s, '</query>') OR NOT contains(s, '<query>') THEN s ELSE regexp_replace(regexp_replace(s, '\s+$', ''), '</query[^>]*$', '') || '</query>' END AS closed, {_SINGLE} AS single
 FROM f""")
def response_parts(read):
    s = F.col("s")
    r = responses(read)
    return r.select(
        "conv_id", "turn", T.stated_evidence(s).alias("evidence"), T.clean_thought(s).alias("thought"), F.coalesce(T.last_tag(s, "answer"), F.lit("")).alias("last_answer"), F.coalesce(T.last_tag(s, "query"), F.lit("")).alias("last_query"), T.action_of(s).alias("action"),
        T.completion_shape(s).alias("shape"), T.ends_with_answer(s).alias("format"), T.answer_without_query(s).alias("old_format"), T.close_tag(s, "query").alias("closed"), T.single_action(s).alias("single"),
    )


@query(rf"""WITH {_RESPONSES} SELECT conv_id, turn, coalesce(nullif(trim(regexp_extract(s, '(?i)So the next query is\s*(.*?)(\.|$)', 1)), ''), nullif(trim(regexp_extract_all(s, '<query>(.*?)</query>', 1)[-1]), ''), trim(regexp_extract_all(s, '(?i)(?:Determine|Find|Search for|Look up|Identify|Discover)\s+(.*?)(?:\.|$)', 1)[-1]), trim(regexp_extract_all(s, '\d+\.\s+(.*?[?\.»])', 1)[-1]), role) AS implied,
 CASE WHEN turn % 6 = 0 THEN {_TIDY('t')} ELSE {_TIDY(_NOTAGS('s'))} END AS subquery,
 trim(split_part(CASE WHEN turn % 6 IN (3, 4) AND NOT contains(regexp_extract(s, '(?s)<answer>(.*?)</answer>', 1), chr(10)) THEN trim(regexp_extract_all(s, '<answer>(.*?)</answer>', 1)[-1]) WHEN turn % 6 = 3 THEN trim(regexp_replace(string_split(s, 'So the answer is')[-1], '(?s)<answer.*?>.*?</answer>|<query.*?>.*?</query>|answer>|<answer', '', 'g')) ELSE '' END, '.', 1)) AS answer,
 split_part(t, chr(10), 1) AS title, CASE WHEN contains(t, chr(10)) THEN left(regexp_replace(substr(t, strpos(t, chr(10)) + 1), '^\s+|\s+$', '', 'g'), 500) ELSE '' END AS body FROM r""")
def implied_queries(read):
    s, t = F.col("s"), F.col("t")
    r = responses(read)
    return r.select("conv_id", "turn", T.inferred_subquery(s, F.col("role")).alias("implied"), T.clean_subquery(s).alias("subquery"), T.last_protocol_answer(s).alias("answer"), T.title_of(t).alias("title"), T.body_of(t).alias("body"))


# Transitions: a turn's response to the conversation's first turn, after the queries so far.
_STEP = f"""{_RESPONSES}, q AS (SELECT conv_id, first(t ORDER BY turn) AS question FROM r GROUP BY 1),
 x AS (SELECT r.*, q.question, ['reasoning', 'document_analysis', 'begin_reasoning', 'query_rewrite', 'other'][(turn % 5 + 1)::INT] AS action, coalesce(n, '') AS query, coalesce(list(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS history, CASE WHEN turn % 2 = 0 THEN [q.question] ELSE [] END AS gaps FROM r JOIN q USING (conv_id)),
 a AS (SELECT *, {LAST('s', 'answer')} AS ans, CASE WHEN query <> '' THEN query ELSE {LAST('s', 'query')} END AS y, CASE WHEN {LAST('s', 'evidence')} <> '' THEN {LAST('s', 'evidence')} WHEN contains(lower(s), 'relevant evidence is') THEN trim(s) ELSE '' END AS ev FROM x),
 b AS (SELECT *, {ENTITIES('question')} AS qe, {CONTENT('question')} AS qt, {ENTITIES('y')} AS ye, {CONTENT('y')} AS yt, {CONTENT('ev')} AS et, regexp_matches({PLAIN("CASE WHEN ev <> '' THEN ev ELSE s END")}, '\\bnone\\b|\\bno documents found\\b|\\bno relevant evidence\\b') AS nn FROM a),
 c AS (SELECT *, coalesce(list_max(list_transform(list_transform(history, lambda h: {CONTENT('h')}), lambda o: {JACCARD('yt', 'o')})), 0.0) AS mx, greatest({OVERLAP('ye', 'qe')}, {JACCARD('yt', 'qt')}) AS aim, CASE WHEN len(qe) > 0 THEN least(1.0, len(list_intersect(ye, qe))::DOUBLE / least(len(qe), 2)) ELSE {JACCARD('yt', 'qt')} END AS keep, ev = '' OR nn AS empty FROM b),
 d AS (SELECT *, CASE WHEN y = '' THEN 0.0 ELSE round_even(greatest(0.0, least(1.0, CASE WHEN mx >= 0.85 THEN least(0.45 * aim + 0.35 * keep + 0.20 * (1.0 - mx), 0.20) ELSE 0.45 * aim + 0.35 * keep + 0.20 * (1.0 - mx) END)), 4) END AS fq,
  CASE WHEN empty THEN 0.0 ELSE round_even(0.55 + 0.45 * {JACCARD('et', 'list_distinct(list_concat(qt, yt))')}, 4) END AS fc,
  CASE WHEN action = 'document_analysis' THEN false WHEN action = 'query_rewrite' THEN true WHEN y <> '' OR contains(s, '<query>') THEN true ELSE action IN ('begin_reasoning', 'reasoning') AND ans = '' END AS qa, action = 'document_analysis' OR contains(s, '<evidence>') AS ca, ans <> '' AS sa FROM c),
 e AS (SELECT *, CASE WHEN qa THEN fq ELSE 1.0 END AS phi_q, CASE WHEN ca THEN fc ELSE 1.0 END AS phi_c, CASE WHEN NOT sa THEN 0.0 WHEN len(gaps) > 0 THEN -1.0 ELSE 1.0 END AS phi_s, ca AND empty AND action = 'document_analysis' AS blank FROM d),
 f AS (SELECT *, (((qa AND phi_q < 0.45) OR blank)::INT) AS b1, ((ca AND phi_c < 0.45 AND NOT blank)::INT) AS b2, ((sa AND phi_s < 0)::INT) AS b3 FROM e),
 g AS (SELECT conv_id, turn, phi_q, phi_c, phi_s, qa AS query_applicable, ca AS claim_applicable, sa AS stop_applicable, CASE b1 + b2 + b3 WHEN 0 THEN 'success' WHEN 1 THEN CASE WHEN b1 = 1 THEN 'query_fail' WHEN b2 = 1 THEN 'claim_fail' ELSE 'stop_fail' END ELSE 'mixed' END AS failure_type,
  round_even((phi_q + phi_c + CASE WHEN phi_s > 0 THEN 1.0 WHEN phi_s = 0 THEN 0.5 ELSE 0.0 END) / 3.0, 4) AS typed_score FROM f)"""


def steps(read):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    r = responses(read).withColumn("question", F.first("t").over(w))
    actions = F.array(*[F.lit(x) for x in ("reasoning", "document_analysis", "begin_reasoning", "query_rewrite", "other")])
    return r.select("conv_id", "turn", "question", F.get(actions, (F.col("turn") % 5).cast("int")).alias("action"), F.col("s").alias("response"), F.coalesce("n", F.lit("")).alias("query"), F.collect_list("t").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("history"), F.when(F.col("turn") % 2 == 0, F.array("question")).otherwise(F.array().cast("array<string>")).alias("open_gaps"))


@query(f"WITH {_STEP} SELECT * FROM g")
def transition_eval(read):
    return S.transitions(steps(read)).select("conv_id", "turn", "phi_q", "phi_c", "phi_s", "query_applicable", "claim_applicable", "stop_applicable", "failure_type", "typed_score")


# Groups of turns of one action stand for siblings below one branch point.
@query(f"""WITH {_STEP}, k AS (SELECT conv_id, turn % 2 AS branch, count(*) AS n, count(DISTINCT typed_score) > 1 AS score_diff, count(DISTINCT failure_type) > 1 AS failure_diff, arg_min(turn, {{'s': -typed_score, 'p': turn}}) = arg_min(turn, {{'s': -phi_q, 'p': turn}}) AS agree FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT count(*) AS n_branches, count_if(score_diff) AS n_score_diff, count_if(failure_diff) AS n_failure_diff, count_if(agree) AS n_agree, round_even(avg(agree::INT), 4) AS agree_rate FROM k""")
def branch_flags(read):
    t = S.transitions(steps(read))
    best = lambda c: F.min_by("turn", F.struct(-F.col(c), F.col("turn")))
    k = t.groupBy("conv_id", (F.col("turn") % 2).alias("branch")).agg(F.count("*").alias("n"), (F.count_distinct("typed_score") > 1).alias("score_diff"), (F.count_distinct("failure_type") > 1).alias("failure_diff"), (best("typed_score") == best("phi_q")).alias("agree")).where("n >= 2")
    return k.agg(F.count("*").alias("n_branches"), F.count_if("score_diff").alias("n_score_diff"), F.count_if("failure_diff").alias("n_failure_diff"), F.count_if("agree").alias("n_agree"), F.bround(F.avg(F.col("agree").cast("double")), 4).alias("agree_rate"))


# Selectors: a conversation's other turns are the documents of its first turn's question.
_TITLE = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_DOCS = rf"""b AS (SELECT conv_id, turn, {ASCII('text')} AS t FROM conversations), z AS (SELECT conv_id, first(t ORDER BY turn) AS question, coalesce(list(t ORDER BY turn)[2], '') AS subquery, coalesce(list(t ORDER BY turn)[3], '') AS history FROM b GROUP BY 1),
 d AS (SELECT conv_id, turn, array_to_string(string_split(b.t, ' ')[1:2], ' ') AS title, b.t AS text, length(b.t) AS retrieved, question, subquery, history FROM b JOIN z USING (conv_id) WHERE turn > 0),
 w AS (SELECT *, lower(title || ' ' || text) AS doc, {WORDS("lower(title || ' ' || text)")} AS dw, {WORDS('subquery')} AS sw, {WORDS('question')} AS qw, {WORDS('history')} AS hw, {_TITLE('title')} AS ti,
   list_distinct(list_transform(list_concat({ALL('question', r'\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b')}, {ALL('subquery', r'\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b')}), lambda e: lower(e))) AS en FROM d),
 p AS (SELECT *, CASE WHEN len(sw) > 0 THEN 2.0 * len(list_intersect(sw, dw)) / len(sw) ELSE 0.0 END AS p1, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw))::DOUBLE / len(qw) ELSE 0.0 END AS p2, CASE WHEN len(en) > 0 THEN 1.5 * len(list_filter(en, lambda e: contains(doc, e))) / len(en) ELSE 0.0 END AS p3,
   CASE WHEN len(dw) > 0 AND len(hw) > 0 THEN 0.5 * len(list_filter(dw, lambda v: NOT list_contains(hw, v))) / len(dw) ELSE 0.0 END AS p4, CASE WHEN len(list_filter(en, lambda e: len(list_filter(regexp_split_to_array(e, '\s+'), lambda v: NOT contains(ti, v))) = 0)) > 0 THEN 1.0 ELSE 0.0 END AS p5 FROM w),
 o AS (SELECT conv_id, turn, ti, unnest([{{'s': 'retrieved', 'v': retrieved::DOUBLE}}, {{'s': 'static', 'v': p2}}, {{'s': 'evidence', 'v': p1 + p2 + p3 + p4 + p5}}, {{'s': 'no_subquery', 'v': p2 + p3 + p4 + p5}}, {{'s': 'no_entity', 'v': p1 + p2 + p4 + p5}}, {{'s': 'no_history', 'v': p1 + p2 + p3 + p5}}]) AS u FROM p),
 k AS (SELECT conv_id, u.s AS selector, ti, row_number() OVER (PARTITION BY conv_id, u.s ORDER BY round(u.v, 9) DESC, turn) AS rank FROM o),
 gold AS (SELECT conv_id, list_distinct(list(ti)) AS gold FROM p WHERE turn % 2 = 1 GROUP BY 1), s AS (SELECT conv_id, selector, list(ti) AS picked FROM k WHERE rank <= 3 GROUP BY 1, 2),
 m AS (SELECT conv_id, selector, len(list_distinct(list_intersect(picked, gold)))::DOUBLE AS hits, len(gold) AS n_gold, len(picked) AS n_picked FROM s JOIN gold USING (conv_id)),
 v AS (SELECT selector, count(*) AS n, round_even(avg((hits > 0)::INT), 4) AS hit3, round_even(avg(hits / n_gold), 4) AS recall3, round_even(avg(1 - hits / n_picked), 4) AS noise FROM m GROUP BY 1)"""


@query(f"WITH {_DOCS} SELECT a.selector, a.n, a.hit3, a.recall3, a.noise, round(a.hit3 - b.hit3, 4) AS vs_retrieved FROM v a, v b WHERE b.selector = 'retrieved'")
def selector_table(read):
    b = read("conversations").select("conv_id", "turn", T.ascii_form(F.col("text")).alias("t"))
    every = b.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("all"))
    nth = lambda i: F.coalesce(F.get("all", F.lit(i))["t"], F.lit(""))
    z = every.select("conv_id", nth(0).alias("question"), nth(1).alias("subquery"), nth(2).alias("history"))
    d = b.where("turn > 0").join(z, "conv_id").select("conv_id", "turn", F.array_join(F.slice(F.split("t", " "), 1, 2), " ").alias("title"), F.col("t").alias("text"), F.length("t").cast("double").alias("retrieved"), "question", "subquery", "history")
    parts = S.selector_parts(d).withColumn("ti", T.strict_title(F.col("title")))
    scores = {"retrieved": F.col("retrieved"), "static": F.col("static")} | {name: S.selector_score(**flags) for name, flags in S.SELECTORS.items()}
    o = parts.select("conv_id", "turn", "ti", F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), F.round(c, 9).alias("score")) for n, c in scores.items()])).alias("u")).select("conv_id", "turn", "ti", "u.*")
    picked = R.top_n(o, ["conv_id", "selector"], [F.desc("score"), F.col("turn")], 3).groupBy("conv_id", "selector").agg(F.collect_list("ti").alias("picked"))
    gold = parts.where("turn % 2 = 1").groupBy("conv_id").agg(F.collect_set("ti").alias("gold"))
    m = picked.join(gold, "conv_id").select("selector", S.selection_metrics(F.col("picked"), F.col("gold")).alias("m"))
    v = m.groupBy("selector").agg(F.count("*").alias("n"), *[F.bround(F.avg(f"m.{a}"), 4).alias(b) for a, b in (("hit", "hit3"), ("recall", "recall3"), ("noise", "noise"))])
    base = v.where("selector = 'retrieved'").select(F.col("hit3").alias("base"))
    return v.join(F.broadcast(base)).select("selector", "n", "hit3", "recall3", "noise", F.round(F.col("hit3") - F.col("base"), 4).alias("vs_retrieved"))
