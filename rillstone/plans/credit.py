"""Queries over rewards and credit: rollouts from conversations, trajectories from orders and their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstone.functions import scoring as S
from rillstone.functions import text as T
from rillstone.operators import credit as C
from rillstone.operators import masks as K
from rillstone.operators.scans import dealt, scanned
from rillstone.plans.answers import P, answer_tokens, squeeze
from rillstone.plans.registry import query
from rillstone.sources.store import kept

# A conversation is a rollout: each turn a query whose documents are the turn and the next; golds are the odd turns' beginnings and later lines.
_LOOSE = lambda x: rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"
_WORDS = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
_FORM = lambda x: r"trim(regexp_replace(lower(coalesce(" + x + r", '')), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_ROLL = rf"""c AS (SELECT conv_id, turn, text, array_to_string(string_split(text, ' ')[1:2], ' ') AS title, lead(text) OVER w AS nxt, lead(array_to_string(string_split(text, ' ')[1:2], ' ')) OVER w AS ntitle FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 g AS (SELECT conv_id, title, split_part(text, chr(10), 2) AS sentences, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n_gold FROM c WHERE turn % 2 = 1),
 k AS (SELECT c.conv_id, c.turn, g.pos, g.n_gold FROM c JOIN g USING (conv_id) WHERE {_LOOSE('g.title')} = {_LOOSE('c.title')} OR (nxt IS NOT NULL AND {_LOOSE('g.title')} = {_LOOSE('c.ntitle')})
   OR ({_WORDS('g.sentences')} <> '' AND (contains({_WORDS('c.text')}, {_WORDS('g.sentences')}) OR (nxt IS NOT NULL AND contains({_WORDS('c.nxt')}, {_WORDS('g.sentences')}))))),
 f AS (SELECT conv_id, pos, n_gold, min(turn) AS turn FROM k GROUP BY ALL), n AS (SELECT conv_id, turn, count(*) AS fresh, any_value(n_gold) AS n_gold FROM f GROUP BY 1, 2),
 s AS (SELECT conv_id, count(*) AS n_steps, count(DISTINCT {_FORM('text')}) FILTER ({_FORM('text')} <> '') AS n_forms, count(*) FILTER ({_FORM('text')} <> '') AS n_queries, arg_max(text, turn) AS final, min_by(text, turn) AS opening FROM c GROUP BY 1),
 a AS (SELECT s.*, coalesce((SELECT max(n_gold) FROM g WHERE g.conv_id = s.conv_id), 0) AS n_gold, coalesce((SELECT sum(fresh) FROM n WHERE n.conv_id = s.conv_id), 0) AS covered, coalesce((SELECT sum(power(0.9, turn) * fresh / n_gold) FROM n WHERE n.conv_id = s.conv_id), 0) AS gain,
   coalesce((SELECT max(turn) FROM f WHERE f.conv_id = s.conv_id), -1) AS last_new FROM s),
 b AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN '' ELSE final END AS answer FROM a), p AS (SELECT *, {answer_tokens('answer')} AS pt, {answer_tokens('opening')} AS gt FROM b)"""


def rollouts(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    title = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 2), " ")
    doc = lambda c: F.struct(title(c).alias("title"), c.alias("text"))
    c = read("conversations").withColumn("nxt", F.lead("text").over(w))
    docs = F.when(F.col("nxt").isNull(), F.array(doc(F.col("text")))).otherwise(F.array(doc(F.col("text")), doc(F.col("nxt"))))
    line = F.get(F.split("text", "\n"), F.lit(1))
    r = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("query"), docs.alias("docs")))).alias("steps"),
        F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 1, F.struct("turn", title(F.col("text")).alias("title"), line.alias("sentences"))))).alias("golds"),
        F.max_by("text", "turn").alias("final"), F.array(F.min_by("text", "turn")).alias("golden_answers"),
    )
    answer = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.col("final"))
    return r.select("conv_id", "steps", F.transform("golds", lambda g: F.struct(g["title"], g["sentences"])).alias("golds"), "golden_answers", F.concat(F.lit("<query>q</query> "), F.lit("<answer>"), answer, F.lit("</answer>")).alias("completion"), F.when(F.col("conv_id") % 2 == 0, F.size("steps")).alias("num_turns"))


@query(f"""WITH {_ROLL}, o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0) AS o FROM p)
 SELECT conv_id, round(CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 WHEN o = 0 THEN 0.0 ELSE 2.0 * o / (len(pt) + len(gt)) END, 9) AS f1, CASE WHEN len(pt) > 0 AND pt = gt THEN 1.0 ELSE 0.0 END AS em, round(CASE WHEN n_gold = 0 THEN 0.0 ELSE covered::DOUBLE / n_gold END, 9) AS relevance,
 round(CASE WHEN n_gold = 0 THEN 0.0 ELSE gain - 0.1 * CASE WHEN covered = n_gold THEN n_steps - 1 - last_new ELSE 0 END END, 9) AS marginal, -greatest(n_steps - 1, 0)::DOUBLE AS turn_cost, -least(n_queries - n_forms, 3)::DOUBLE AS repeat_query,
 CASE WHEN trim(answer) = '' AND (CASE WHEN conv_id % 2 = 0 THEN n_steps >= 6 ELSE n_steps >= 5 END) THEN -1.0 ELSE 0.0 END AS max_turn, CASE WHEN trim(answer) <> '' THEN 1.0 ELSE 0.0 END AS format FROM o""")
def reward_table(read):
    r = S.rewarded(rollouts(read))
    nine = lambda a, b: F.round(a, 9).alias(b)
    return r.select("conv_id", nine("f1", "f1"), "em", nine("relevance", "relevance"), nine("marginal_relevance", "marginal"), "turn_cost", "repeat_query", "max_turn", "format")


@query(f"""WITH {_ROLL} SELECT c.conv_id, c.turn::INT AS turn, round(CASE WHEN coalesce(x.n_gold, 0) = 0 THEN NULL ELSE coalesce(n.fresh, 0)::DOUBLE / x.n_gold END, 9) AS gain FROM c JOIN a x USING (conv_id) LEFT JOIN n USING (conv_id, turn) WHERE x.n_gold > 0""")
def query_gains(read):
    r = S.rewarded(rollouts(read), ["query_evidence_gain"])
    return r.select("conv_id", F.posexplode("query_evidence_gain").alias("turn", "gain")).select("conv_id", "turn", F.round("gain", 9).alias("gain"))


# A customer is a prompt, an order a trajectory, its lines are turns; discounts are gains.
_TRAJ = """l AS (SELECT o_custkey AS grp, l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) - 1 AS turn, l_discount::DOUBLE AS gain, o_totalprice::DOUBLE / 1e5 AS reward, (CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 - 2 END)::DOUBLE AS advantage FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 t AS (SELECT *, sum(gain) OVER (PARTITION BY sample) AS relevance FROM l)"""


def trajectories(read):
    o = read("orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("sample"), (F.col("o_totalprice").cast("double") / 1e5).alias("reward"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 5 - 2).cast("double").alias("advantage"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    lines = dealt(read("lineitem").select("l_orderkey", *order), "l_orderkey")
    t = lines.select(F.col("l_orderkey").alias("sample"), number.alias("turn"), F.col("l_discount").cast("double").alias("gain")).join(o, "sample")
    return t.withColumn("relevance", F.sum("gain").over(Window.partitionBy("sample")))


@query(f"""WITH {_TRAJ}, r AS (SELECT *, reward - relevance + sum(gain) OVER (PARTITION BY sample ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS raw FROM t)
 SELECT sample, turn::INT AS turn, round(CASE WHEN turn = 0 OR count(*) OVER w <= 1 OR stddev_samp(raw) OVER w <= 1e-6 THEN advantage ELSE (raw - avg(raw) OVER w) / (stddev_samp(raw) OVER w + 1e-4) END, 5) + 0.0 AS query_advantage FROM r WINDOW w AS (PARTITION BY grp, turn)""")
def causal_returns(read):
    return C.causal_returns(trajectories(read), "grp", "sample", "turn").select("sample", "turn", (F.round("query_advantage", 5) + 0.0).alias("query_advantage"))


@query(f"""WITH {_TRAJ}, n AS (SELECT *, CASE WHEN count(*) OVER w <= 1 THEN 0.0 ELSE (gain - avg(gain) OVER w) / (stddev_samp(gain) OVER w + 1e-4) END AS credit, CASE WHEN count(*) OVER w <= 1 THEN 0.0 ELSE gain - avg(gain) OVER w END AS centred FROM t WINDOW w AS (PARTITION BY grp, turn))
 SELECT sample, turn::INT AS turn, round(credit, 9) + 0.0 AS credit, round(centred, 9) + 0.0 AS centred, round(CASE WHEN max(abs(advantage)) OVER (PARTITION BY grp) <= 1e-8 THEN credit ELSE 0.0 END, 9) + 0.0 AS gated FROM n""")
def credit_slots(read):
    t = C.slot_stats(kept(trajectories(read)), ["grp", "turn"], "gain")
    t = t.withColumns({"credit": C.scaled("gain"), "centred": C.scaled("gain", "group_turn_center")}).withColumn("gated", F.col("credit"))
    nine = lambda c: (S.rounded(F.col(c), 9) + 0.0).alias(c)
    return C.gated(t, "grp", "gated", "advantage").select("sample", "turn", nine("credit"), nine("centred"), nine("gated"))


@query("""SELECT o_orderkey AS sample, round(CASE WHEN count(*) OVER w <= 1 THEN 0.0 ELSE (o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 1e-4) END, 5) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def group_norm(read):
    t = C.normalized(read("orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("v")), ["o_custkey"], "v", "advantage")
    return t.select(F.col("o_orderkey").alias("sample"), F.round("advantage", 5).alias("advantage"))


# Events are tokens of a user's response: a view opens a query turn, that lasts until a purchase.
_TOK = """e AS (SELECT user_id AS sample, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), o AS (SELECT *, CASE WHEN event_type <> 'purchase' AND sum((event_type = 'view')::INT) OVER w > 0 THEN sum((event_type = 'view')::INT) OVER w - 1 ELSE -1 END AS ordinal, event_id % 7 <> 0 AS mask FROM e WINDOW w AS (PARTITION BY sample ORDER BY pos)),
 c AS (SELECT sample, ordinal, avg(value) / 100 - 1 AS credit FROM o WHERE ordinal >= 0 GROUP BY 1, 2), j AS (SELECT o.*, CASE WHEN mask THEN coalesce(credit, 0.0) ELSE 0.0 END AS credit, (sample % 5 - 2)::DOUBLE AS base FROM o LEFT JOIN c USING (sample, ordinal))"""


def token_rows(read):
    e = read("events").select(F.col("user_id").alias("sample"), "event_id", "value", "event_type", "ts")
    view = F.col("event_type") == "view"
    o = C.turn_ordinals(e, "sample", ["ts", "event_id"], view, F.col("event_type") != "purchase").withColumn("ordinal", F.greatest("ordinal", F.lit(-1))).withColumn("mask", F.col("event_id") % 7 != 0)
    credit = o.where("ordinal >= 0").groupBy("sample", "ordinal").agg((F.avg("value") / 100 - 1).alias("credit"))
    return C.scattered(o, credit, "sample", "credit").withColumn("base", (F.col("sample") % 5 - 2).cast("double"))


@query(f"""WITH {_TOK} SELECT event_id, ordinal::BIGINT AS ordinal, round(credit, 6) AS credit, round(CASE WHEN NOT mask THEN 0.0 WHEN ordinal >= 0 THEN 0.3 * base + 0.7 * credit WHEN event_type = 'purchase' THEN base ELSE 0.0 END, 6) AS composed,
 round(CASE WHEN NOT mask THEN 0.0 WHEN ordinal >= 0 THEN base + 0.5 * abs(base) * least(1.5, greatest(-1.5, credit)) ELSE base END, 6) AS signed, round(CASE WHEN NOT mask THEN 0.0 ELSE base + CASE WHEN value < 100 THEN 0.2 * (ln(1 + value) - 2) ELSE 0.0 END END, 6) AS teacher FROM j""")
def token_advantages(read):
    j = token_rows(read)
    inside, mask, base, credit = F.col("ordinal") >= 0, F.col("mask"), F.col("base"), F.col("credit")
    composed = F.when(~mask, 0.0).when(inside, 0.3 * base + 0.7 * credit).when(F.col("event_type") == "purchase", base).otherwise(0.0)
    signed = F.when(~mask, 0.0).when(inside, S.signed_query_advantage(base, credit)).otherwise(base)
    teacher = S.teacher_advantage(base, F.log1p("value"), F.lit(2.0), F.lit(0.2), S.failed_gate(F.col("value"), 100.0), mask)
    six = lambda c, n: S.rounded(c, 6).alias(n)
    return j.select("event_id", F.col("ordinal").cast("long").alias("ordinal"), six(credit, "credit"), six(composed, "composed"), six(signed, "signed"), six(teacher, "teacher"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS q, round(coalesce(value, 0) * 0.5 + coalesce(CASE WHEN value > 400 THEN NULL ELSE 2 END, 0), 6) AS reward FROM events""")
def running_value(read):
    odd = F.when(F.col("value") > 400, F.lit(float("nan"))).otherwise(2.0)
    e = scanned(read("events"), ["user_id"], ["ts", "event_id"], {"q": ("mean", F.col("value"))}).withColumn("odd", odd)
    return e.select("event_id", S.rounded(F.col("q"), 6).alias("q"), F.round(S.weighted_reward({"value": 0.5, "odd": 1.0}), 6).alias("reward"))


# A conversation is a sample; its turns are responses that ask, note or answer, in tokens of five characters; each seventh token isn't trained on.
_MASKS = """WITH c AS (SELECT conv_id AS sample, turn, CASE turn % 4 WHEN 0 THEN 'so <query>' || coalesce(text, '') || '</query> x' WHEN 1 THEN '<evidence>' || coalesce(text, '') WHEN 2 THEN 'ask <Query>' || coalesce(text, '') ELSE coalesce(text, '') || '<answer>a <query>b' END AS body FROM conversations),
 t AS (SELECT *, CASE WHEN contains(lower(body), '<answer>') THEN 'answer' WHEN contains(lower(body), '<query>') THEN 'query' WHEN contains(lower(body), '<evidence>') THEN 'evidence' END AS class, strpos(lower(body), '<query>') - 1 AS first FROM c),
 s AS (SELECT *, CASE WHEN strpos(lower(body)[first + 8:], '</query>') > 0 THEN first + 7 + strpos(lower(body)[first + 8:], '</query>') - 1 + 8 ELSE length(body) END AS stop, CASE WHEN class = 'query' THEN count(*) FILTER (class = 'query') OVER (PARTITION BY sample ORDER BY turn) - 1 ELSE -1 END AS ordinal FROM t),
 k AS (SELECT *, unnest(range(greatest(ceil(length(body) / 5.0), 1)::BIGINT)) AS pos FROM s)
 SELECT sample, turn, pos, CASE WHEN (pos + turn) % 7 <> 3 THEN ordinal ELSE -1 END::BIGINT AS ordinal, CASE WHEN (pos + turn) % 7 <> 3 AND class = 'query' AND pos * 5 < stop AND least(pos * 5 + 5, length(body)) > first THEN ordinal ELSE -1 END::BIGINT AS payload,
 (pos + turn) % 7 <> 3 AND coalesce(class = 'answer', false) AS answers FROM k"""


def response_tokens(read):
    text, kind = F.coalesce("text", F.lit("")), F.col("turn") % 4
    body = F.when(kind == 0, F.concat(F.lit("so <query>"), text, F.lit("</query> x"))).when(kind == 1, F.concat(F.lit("<evidence>"), text)).when(kind == 2, F.concat(F.lit("ask <Query>"), text)).otherwise(F.concat(text, F.lit("<answer>a <query>b")))
    c = read("conversations").select(F.col("conv_id").alias("sample"), "turn", body.alias("body"))
    n = F.greatest(F.ceil(F.length("body") / 5), F.lit(1))
    t = c.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return t.select("sample", "turn", "pos", F.substring("body", (F.col("pos") * 5 + 1).cast("int"), F.lit(5)).alias("piece"), ((F.col("pos") + F.col("turn")) % 7 != 3).alias("keep"))


@query(_MASKS)
def response_masks(read):
    """Ordinals of query turns, of what their tags enclose, and the mask of answers, token by token."""
    t = kept(response_tokens(read))
    at = ["sample", "turn", "pos"]
    payload = K.query_ordinals(t, payload_only=True).select(*at, F.col("ordinal").cast("long").alias("payload"))
    answers = K.action_mask(t, "answer").select(*at, F.col("selected").alias("answers"))
    return K.query_ordinals(t).select(*at, F.col("ordinal").cast("long").alias("ordinal")).join(payload, at).join(answers, at)
