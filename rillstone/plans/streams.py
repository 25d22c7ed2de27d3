"""Queries that run as streams: over several micro-batches, restarted from their checkpoint between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.plans.registry import query
from rillstone.sources.store import fresh_path
from rillstone.streaming import events as E
from rillstone.streaming import limits as L
from rillstone.streaming import runs as R

MOST, SECONDS, COOLDOWN, TRACKED, BUCKETS = 3, 172_800.0, 21_600.0, 12, 8

# The same rule, event by event of a bucket: clean up each minute, cap, cooldown, window.
_LIMITS = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, user_id % {BUCKETS} AS bucket, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id % {BUCKETS} ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
 r AS (SELECT bucket, 0::BIGINT AS i, 0::BIGINT AS event_id, -1e18::DOUBLE AS cleaned, []::STRUCT(c BIGINT, t DOUBLE[])[] AS held, 0.0::DOUBLE AS wait FROM (SELECT DISTINCT bucket FROM e)
 UNION ALL SELECT bucket, i, event_id, cleaned, CASE WHEN wait = 0 THEN list_append(list_filter(held, lambda x: x.c <> user_id), {{'c': user_id, 't': list_append(coalesce(mine, []), sec)}}) ELSE held END, wait
  FROM (SELECT *, (CASE WHEN mine IS NULL AND len(held) >= {TRACKED} THEN 60.0 WHEN mine IS NOT NULL AND {COOLDOWN} - (sec - mine[-1]) > 0 THEN {COOLDOWN} - (sec - mine[-1]) WHEN len(mine) >= {MOST} THEN greatest(1.0, mine[1] + {SECONDS} - sec) ELSE 0.0 END)::DOUBLE AS wait
   FROM (SELECT *, list_filter(held, lambda x: x.c = user_id)[1].t AS mine
    FROM (SELECT r.bucket, e.i, e.event_id, e.user_id, e.sec, CASE WHEN e.sec - r.cleaned >= 60 THEN e.sec ELSE r.cleaned END AS cleaned,
      CASE WHEN e.sec - r.cleaned >= 60 THEN list_filter(list_transform(r.held, lambda x: {{'c': x.c, 't': list_filter(x.t, lambda y: y > e.sec - {SECONDS})}}), lambda x: len(x.t) > 0) ELSE r.held END AS held
     FROM r JOIN e ON e.bucket = r.bucket AND e.i = r.i + 1))))
 SELECT event_id, bucket, round(wait, 3) AS retry_after FROM r WHERE i > 0"""


def _events(read):
    return read("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def _rule() -> dict:
    return {"most": MOST, "seconds": SECONDS, "cooldown": COOLDOWN, "tracked": TRACKED, "bucket": F.pmod(F.col("user_id"), F.lit(BUCKETS))}


@query(_LIMITS)
def limited_requests(read):
    """The limiter as a stream: events come in four slices of time, with a restart from the checkpoint before each."""
    events = _events(read)
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.unix_micros("a").alias("a"), F.unix_micros("b").alias("b")).first()
    a, step = ends["a"] or 0, ((ends["b"] or 0) - (ends["a"] or 0)) // 4 + 1
    part = F.floor((F.unix_micros("ts") - a) / step)
    found = R.in_slices(events, [part == i for i in range(4)], lambda rows: L.limited(rows, **_rule()), fresh_path(events.sparkSession, "limits"))
    return found.select("event_id", "bucket", F.round("retry_after", 3).alias("retry_after"))


@query(_LIMITS)
def limited_in_batch(read):
    """The limiter's batch twin."""
    return L.limits(_events(read), **_rule()).select("event_id", "bucket", F.round("retry_after", 3).alias("retry_after"))


# Turns answer, ask or do neither; pieces of 37 characters come in three slices, in no order, some of them twice.
_RAW = "CASE turn % 3 WHEN 0 THEN 'so <answer>' || coalesce(text, '') || '</answer>' WHEN 1 THEN 'look <query>' || coalesce(text, '') || '</query>' ELSE coalesce(text, '') END"
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TOKEN_EVENTS = f"""WITH c AS (SELECT conv_id || '-' || turn AS stream, {_RAW} AS raw FROM conversations), m AS (SELECT *, strpos(raw, '<answer>') AS a, strpos(raw, '<query>') AS q FROM c),
 t AS (SELECT *, CASE WHEN a > 0 AND (q = 0 OR a < q) THEN 'answer' WHEN q > 0 THEN 'query' ELSE '' END AS mode FROM m),
 s AS (SELECT *, CASE mode WHEN 'answer' THEN raw[a + 8:] WHEN 'query' THEN raw[q + 7:] ELSE '' END AS rest FROM t),
 x AS (SELECT *, CASE WHEN strpos(rest, '</' || mode || '>') > 0 THEN rest[1:strpos(rest, '</' || mode || '>') - 1] ELSE rest END AS shown, strpos(rest, '</' || mode || '>') > 0 AS closed FROM s),
 f AS (SELECT *, {_TRIM("CASE WHEN closed OR mode = 'answer' THEN shown ELSE '' END")} AS said FROM x)
 SELECT stream, md5(CASE WHEN mode = 'answer' THEN shown ELSE '' END) AS shown, CASE WHEN said = '' THEN 'error' WHEN mode = 'answer' THEN 'done' ELSE 'query' END AS kind,
 md5(CASE WHEN said <> '' THEN said WHEN mode = 'answer' THEN 'empty_answer' ELSE 'invalid_agent_action' END) AS said, (CASE WHEN mode = 'answer' THEN 1 ELSE 0 END)::BIGINT AS starts FROM f"""


def token_pieces(read, size: int = 37):
    """(stream, seq, piece, last, slice) of every turn; a fifth of the pieces again in the last slice."""
    text, kind = F.coalesce("text", F.lit("")), F.col("turn") % 3
    raw = F.when(kind == 0, F.concat(F.lit("so <answer>"), text, F.lit("</answer>"))).when(kind == 1, F.concat(F.lit("look <query>"), text, F.lit("</query>"))).otherwise(text)
    c = read("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream"), raw.alias("raw"))
    n = F.greatest(F.ceil(F.length("raw") / size), F.lit(1))
    cut = c.withColumn("n", n).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = cut.select("stream", "seq", F.substring("raw", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"), F.pmod(F.xxhash64("stream", "seq"), F.lit(3)).alias("slice"))
    return rows.unionByName(rows.where("seq % 5 = 0").withColumn("slice", F.lit(2).cast("long")))


def _by_stream(events):
    text = F.when(F.col("kind") == "answer_delta", F.struct("n", "text"))
    last = F.max_by(F.struct("kind", "text"), "n")
    told = events.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), "").alias("shown"), last.alias("last"), F.count_if(F.col("kind") == "answer_start").alias("starts"))
    return told.select("stream", F.md5(F.col("shown").cast("binary")).alias("shown"), F.col("last.kind").alias("kind"), F.md5(F.col("last.text").cast("binary")).alias("said"), "starts")


@query(_TOKEN_EVENTS)
def token_stream_events(read):
    """A model's pieces as a stream: late and repeated ones in three micro-batches, with restarts."""
    pieces = token_pieces(read)
    spark = pieces.sparkSession
    found = R.in_slices(pieces, [F.col("slice") == i for i in range(3)], lambda rows: E.streamed_events(rows.drop("slice")), fresh_path(spark, "events"))
    return _by_stream(found)


@query(_TOKEN_EVENTS)
def token_events_in_batch(read):
    return _by_stream(E.events_of(token_pieces(read)))
