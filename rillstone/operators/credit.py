"""Credit of turns within groups of trajectories, and its way to tokens. Rows are (group, sample, turn, ...), turns from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.scans import scanned


def slot_stats(rows: DataFrame, slot: Sequence[str], value: str) -> DataFrame:
    """`rows` with _n, _mean and _sd of `value` in each slot.

    By aggregation and a join, so that a slot of very many rows is combined map-side and no task sorts it;
    an empty key makes one slot of all.
    """
    stats = rows.groupBy(*slot).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    keys = [stats[k].alias(f"_k{i}") for i, k in enumerate(slot)]
    same = [F.col(f"_k{i}").eqNullSafe(rows[k]) for i, k in enumerate(slot)]
    return rows.join(stats.select(*keys, "_n", "_mean", "_sd"), same or F.lit(True), "left").drop(*[f"_k{i}" for i in range(len(slot))])


def scaled(value: str, scale: str = "group_turn", eps: float = 1e-4) -> Column:
    """Over the columns of :func:`slot_stats`: centred in its slot and, unless scale is group_turn_center, divided by the sample deviation; a slot of one is 0; scale none leaves values."""
    if scale == "none":
        return F.col(value).cast("double")
    if scale not in ("group_turn", "group_turn_center"):
        raise ValueError(f"unknown scale {scale!r}")
    centred = F.col(value) - F.col("_mean")
    return F.when(F.col("_n") <= 1, 0.0).otherwise(centred / (F.col("_sd") + eps) if scale == "group_turn" else centred)


def normalized(rows: DataFrame, slot: Sequence[str], value: str, to: str, *, scale: str = "group_turn", eps: float = 1e-4) -> DataFrame:
    """`rows` with `value` :func:`scaled` in its slot."""
    if scale == "none":
        return rows.withColumn(to, scaled(value, scale))
    return slot_stats(rows, slot, value).withColumn(to, scaled(value, scale, eps)).drop("_n", "_mean", "_sd")


def gated(rows: DataFrame, group: str, credit: str, outcome: str, tol: float = 1e-8) -> DataFrame:
    """Credit only in groups whose outcomes are all within `tol` of 0; elsewhere 0."""
    most = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.abs(outcome)).alias("_most"))
    return rows.join(most, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(credit, F.when(F.col("_most") <= tol, F.col(credit)).otherwise(0.0)).drop("_g", "_most")


def causal_returns(rows: DataFrame, group: str, sample: str, turn: str, *, weight: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """`rows` (gain by turn; reward, advantage, relevance by sample) with `query_advantage`.

    A turn's return keeps the reward but for relevance and adds what evidence is gained from it on. The first
    turn has the sample's own advantage; later ones are scaled within (group, turn), and fall back to the
    sample's advantage where a slot has one row or no spread. Gains must add up to the relevance.
    """
    after = Window.partitionBy(sample).orderBy(turn).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(sample)
    broken = F.abs(F.sum("gain").over(whole) - F.col("relevance")) > tol
    raw = F.when(broken, F.raise_error(F.lit("the gains of a sample don't add up to its relevance"))).otherwise(F.col("reward") - weight * F.col("relevance") + weight * F.sum("gain").over(after))
    out = slot_stats(rows.withColumn("_raw", raw.cast("double")), [group, turn], "_raw")
    flat = (F.col(turn) == 0) | (F.col("_n") <= 1) | (F.col("_sd") <= tol)
    return out.withColumn("query_advantage", F.when(flat, F.col("advantage")).otherwise((F.col("_raw") - F.col("_mean")) / (F.col("_sd") + 1e-4))).drop("_raw", "_n", "_mean", "_sd")


def turn_ordinals(tokens: DataFrame, sample: str, order: Sequence[str], starts: Column, inside: Column) -> DataFrame:
    """`tokens` with `ordinal`: the number (from 0) of the query turn that a token is inside, else -1."""
    seen = scanned(tokens, [sample], order, {"_seen": ("sum", starts.cast("int"))})
    return seen.withColumn("ordinal", F.when(inside, F.col("_seen") - 1).otherwise(-1)).drop("_seen")


def scattered(tokens: DataFrame, credit: DataFrame, sample: str, value: str) -> DataFrame:
    """`tokens` (sample, ordinal, mask) with the credit (sample, ordinal, value) of their turn; 0 outside turns and the mask."""
    own = tokens.join(credit.select(sample, "ordinal", F.col(value).alias("_v")), [sample, "ordinal"], "left")
    return own.withColumn(value, F.when(F.col("mask"), F.coalesce("_v", F.lit(0.0))).otherwise(0.0)).drop("_v")
