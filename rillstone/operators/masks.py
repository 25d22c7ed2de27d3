"""Which tokens of a response belong to which kind of turn: action masks, query ordinals, and their way onto an encoded frame.

Tokens are (sample, turn, pos, piece, keep): a turn's tokens in order, each with its own text, `keep` those that are
trained on. A turn is one of answer, query, evidence by the first of these opening tags that it has at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.scans import scanned

SCOPES = ("answer", "query", "evidence")
TURN = ["sample", "turn"]


def turn_class(text: Column) -> Column:
    """answer, query or evidence by the opening tags in a turn; an answer ends it before a query can run. Null without any."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(f"<{s}>")), s) for s in SCOPES])


def turns_of(tokens: DataFrame) -> DataFrame:
    """(sample, turn, class, ordinal, first, end): each turn's class, the number from 0 of query turns (else -1), and where the query's tags begin and end in its text.

    A query that isn't closed reaches to the end: a stop word may have cut its closing tag off.
    """
    piece = F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "")
    t = tokens.groupBy(*TURN).agg(text.alias("text")).withColumn("class", turn_class(F.col("text"))).withColumn("low", F.lower("text"))
    t = t.withColumn("first", F.instr("low", "<query>") - 1)
    after = F.instr(F.expr("substring(low, first + 8)"), "</query>")
    end = F.when(after > 0, F.col("first") + 7 + after - 1 + 8).otherwise(F.length("text"))
    t = t.select(*TURN, "class", F.when(F.col("class") == "query", F.col("first")).alias("first"), F.when(F.col("class") == "query", end).alias("end"))
    n = scanned(t, ["sample"], ["turn"], {"_n": ("sum", F.coalesce((F.col("class") == "query").cast("int"), F.lit(0)))})
    return n.withColumn("ordinal", F.when(F.col("class") == "query", F.col("_n") - 1).otherwise(-1)).drop("_n")


def offsets(tokens: DataFrame) -> DataFrame:
    """`tokens` with start and stop: the characters of its turn that each covers."""
    size = F.length(F.coalesce("piece", F.lit(""))).cast("long")
    return scanned(tokens, TURN, ["pos"], {"stop": ("sum", size)}).withColumn("start", F.col("stop") - size)


def overlapping(items: DataFrame, spans: DataFrame, keys: Sequence[str], *, width: int = 512) -> DataFrame:
    """`items` (keys, start, stop) with `inside`: whether each overlaps any of `spans` (keys, first, end).

    Both are dealt by blocks of `width` offsets that they touch, so a key with very many items is spread and no two
    are compared but those that share a block. Empty items and spans overlap nothing. Keys of null meet no span.
    """
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    some = items.where("stop > start").select(*keys, "start", "stop").distinct().withColumn("_block", blocks(F.col("start"), F.col("stop")))
    own = spans.where("end > first").select(*keys, "first", "end").withColumn("_block", blocks(F.col("first"), F.col("end")))
    hit = some.join(own, [*keys, "_block"]).where("start < end and stop > first").select(*keys, "start", "stop").distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, [*keys, "start", "stop"], "left").withColumn("inside", F.coalesce("_hit", F.lit(False))).drop("_hit")


def action_mask(tokens: DataFrame, scope: str) -> DataFrame:
    """`tokens` with `selected`: kept tokens of turns whose class is `scope`; of all kept ones for scope all."""
    if scope == "all":
        return tokens.withColumn("selected", F.coalesce("keep", F.lit(False)))
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    own = turns_of(tokens).select(*TURN, "class")
    return tokens.join(own, TURN).withColumn("selected", F.coalesce(F.col("keep") & (F.col("class") == scope), F.lit(False))).drop("class")


def query_ordinals(tokens: DataFrame, payload_only: bool = False) -> DataFrame:
    """`tokens` with `ordinal`: the number of the query turn that a kept token is in, else -1; with `payload_only` only tokens that touch the query's tags or what is between."""
    turns = turns_of(tokens)
    if not payload_only:
        return tokens.join(turns.select(*TURN, "ordinal"), TURN).withColumn("ordinal", F.when(F.col("keep"), F.col("ordinal")).otherwise(-1))
    marked = overlapping(offsets(tokens), turns.select(*TURN, "first", "end").where("first is not null"), TURN)
    own = marked.join(turns.select(*TURN, "ordinal"), TURN)
    return own.withColumn("ordinal", F.when(F.col("keep") & F.col("inside"), F.col("ordinal")).otherwise(-1)).drop("start", "stop", "inside")


def turn_starts(frame: Column, mask: Column, turns: Column, losses: Column) -> Column:
    """Where each of a sample's turns (arrays of token ids) stands in its frame, from 0: the first place from the end of the turn before on.

    Chat templates put tokens between turns, so a turn is looked for as a run of equal ids, of which those that are trained on
    (`losses`) are trained on in the frame's `mask`, too. Lists of different lengths, or a turn without a place, are an error.
    """
    pairs = F.arrays_zip(turns.alias("turn"), losses.alias("loss"))

    def fits(at: Column, turn: Column, loss: Column) -> Column:
        n = F.size(turn)
        here = F.slice(mask, at + 1, n)
        return (F.slice(frame, at + 1, n) == turn) & F.forall(F.arrays_zip(loss.alias("l"), here.alias("m")), lambda x: (x["l"] == 0) | (x["m"] == 1))

    def step(acc: Column, x: Column) -> Column:
        turn, loss = x["turn"], x["loss"]
        last = F.size(frame) - F.size(turn)
        places = F.filter(F.sequence(acc["cursor"], F.greatest(acc["cursor"], last)), lambda at: (at <= last) & fits(at, turn, loss))
        start = F.get(places, F.lit(0))
        bad = F.raise_error(F.lit("a turn's tokens and its loss mask differ in length")).cast("int")
        none = F.raise_error(F.lit("a turn has no place in its frame")).cast("int")
        sure = F.when(F.size(turn) != F.size(loss), bad).when(start.isNull(), none).otherwise(start)
        return F.struct((sure + F.size(turn)).alias("cursor"), F.concat(acc["starts"], F.array(sure)).alias("starts"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("starts")), step)["starts"]
    return F.when(F.size(turns) != F.size(losses), F.raise_error(F.lit("turns and loss masks differ in number")).cast("array<int>")).otherwise(found)


def onto_frame(tokens: DataFrame, frame: DataFrame, value: str) -> DataFrame:
    """`frame` (sample, place, mask) with `value` of the sample's kept tokens: its n-th trained place has that of the n-th kept token.

    A sample with more or fewer of one than of the other is an error.
    """
    kept_ones = scanned(tokens.where("keep"), ["sample"], ["turn", "pos"], {"_n": ("count", F.lit(1))}).select("sample", "_n", F.col(value).alias(value))
    places = scanned(frame.where("mask"), ["sample"], ["place"], {"_n": ("count", F.lit(1))}).select("sample", "_n", "place")
    counts = kept_ones.select("sample", F.lit(1).alias("k")).unionByName(places.select("sample", F.lit(-1).alias("k"))).groupBy("sample").agg(F.sum("k").alias("k")).where("k <> 0")
    if odd := counts.limit(5).collect():
        raise ValueError(f"kept tokens and trained places differ in number in samples {[r['sample'] for r in odd]}")
    both = places.join(kept_ones, ["sample", "_n"]).drop("_n")
    return frame.join(both, ["sample", "place"], "left")
