"""Running values over groups of any size: a scan in two levels.

Rows are dealt by ranges of (group, order), so a group of very many rows is spread over many tasks. Each range
runs over its own rows; what the group's earlier ranges come to is added from one small table. A group goes on from
one range into the next at each border at most, so that table has fewer rows than there are ranges, and
is broadcast for that reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.sources.store import kept


def dealt(rows: DataFrame, *keys: str, each: int = 500_000) -> DataFrame:
    """`rows` dealt by the hash of `keys` into parts of about `each` rows, and into no fewer than the session's.

    What a task sorts or groups then has one size however many rows there are: a number of parts that is set once grows
    them with the table, and parts merged by their compressed bytes may be many times as large in memory. Counts `rows`, so
    it is meant for tables as they are read.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *keys)


def _both(a: Column, b: Column, kind: str) -> Column:
    """What two neighbouring runs come to; a run without a value is null and changes nothing."""
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str], wanted: dict[str, tuple[str, Column]], *, backward: bool = False, own: bool = True) -> DataFrame:
    """`rows` with, for each name of `wanted`, its value over the group's rows up to each one in `order`.

    A kind is sum, count (of values that aren't null), max, min or mean. `backward` runs from each row to the group's last;
    without `own` the row itself is left out. `order` has to tell a group's rows apart; nulls come first. A group key
    of null is a group. Values of no row are null, counts 0.
    """
    parts: dict[str, tuple[str, Column]] = {}
    for name, (kind, value) in wanted.items():
        if kind in ("count", "mean"):
            parts[f"_c_{name}"] = ("sum", F.when(value.isNotNull(), 1).otherwise(0).cast("long"))
        if kind in ("sum", "mean"):
            parts[f"_s_{name}"] = ("sum", value)
        elif kind in ("max", "min"):
            parts[f"_s_{name}"] = (kind, value)
        elif kind != "count":
            raise ValueError(f"unknown kind {kind!r}")
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    dealt = kept(rows.withColumns({n: v for n, (_, v) in parts.items()}).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    by_part = [F.desc("_part") if backward else F.asc("_part")]
    earlier = Window.partitionBy(*group).orderBy(*by_part).rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(*group, "_part").agg(*[fold[k](n).alias(n) for n, (k, _) in parts.items()])
    before = whole.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_at"), F.count("*").over(earlier).alias("_ranges"), *[fold[k](n).over(earlier).alias(f"_b{n}") for n, (k, _) in parts.items()])
    before = F.broadcast(before.where("_ranges > 0").drop("_ranges"))
    frame = (0 if own else 1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, 0 if own else -1)
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(*frame)
    run = dealt.withColumns({f"_r{n}": fold[k](n).over(inside) for n, (k, _) in parts.items()})
    same = reduce(lambda a, b: a & b, [F.col(f"_g{i}").eqNullSafe(run[g]) for i, g in enumerate(group)], F.col("_at") == F.col("_part"))
    both = run.join(before, same, "left").withColumns({f"_r{n}": _both(F.col(f"_b{n}"), F.col(f"_r{n}"), k) for n, (k, _) in parts.items()})
    out = {}
    for name, (kind, _) in wanted.items():
        total, count = F.col(f"_r_s_{name}"), F.coalesce(F.col(f"_r_c_{name}"), F.lit(0))
        out[name] = count if kind == "count" else F.when(count > 0, total / count) if kind == "mean" else total
    return both.select(*rows.columns, *[c.alias(n) for n, c in out.items()])


def return_to_go(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, to: str) -> DataFrame:
    """`rows` with the sum of `value` from each one to its group's last."""
    return scanned(rows, group, order, {to: ("sum", value)}, backward=True)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], to: str) -> DataFrame:
    """`rows` with their number in the group, from 1."""
    return scanned(rows, group, order, {to: ("count", F.lit(1))})


def prior_counts(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, kinds: Sequence[str], to: str) -> DataFrame:
    """`rows` with how often each kind came before each one, as kind:count joined by bars: of one size whatever the group's."""
    names = {f"_k{i}": ("count", F.when(value == k, 1)) for i, k in enumerate(kinds)}
    counted = scanned(rows, group, order, names, own=False)
    return counted.withColumn(to, F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), F.col(n).cast("string")) for k, n in zip(kinds, names, strict=True)])).drop(*names)


def first_seen(rows: DataFrame, key: str, group: Sequence[str], form: Column, order: Sequence[str], to: str) -> DataFrame:
    """`rows` with whether each is the first of its group with its form; `key` tells all rows apart.

    The firsts come from an aggregate, combined before the shuffle, and meet the rows by key, so no group is in one task.
    """
    firsts = rows.groupBy(*group, form.alias("_form")).agg(F.min_by(key, F.struct(*order)).alias(key)).select(key, F.lit(True).alias("_first"))
    return rows.join(firsts, key, "left").withColumn(to, F.coalesce("_first", F.lit(False))).drop("_first")
