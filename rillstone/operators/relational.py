"""Joins, windows, aggregates, curation and tree operators over DataFrames.

Every operator that orders rows takes an explicit tie-break; every join states what
becomes of rows without a partner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.scans import scanned
from rillstone.sources.store import kept

# Joins ---------------------------------------------------------------------------------
def reason_join(candidates: DataFrame, labels: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Candidates with their label and `reason`: kept, missing_label or failed_label."""
    marked = labels.withColumn("_seen", F.lit(True))
    reason = F.when(F.col("_seen").isNull(), "missing_label").when(~F.coalesce(ok, F.lit(False)), "failed_label").otherwise("kept")
    return candidates.join(marked, list(keys), "left").withColumn("reason", reason).drop("_seen")


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join; raises where either side lacks an id or repeats one. Both sides' ids are counted in one aggregate."""
    both = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = both.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    for what, bad in {"missing or repeated on the left": "_l <> 1", "missing or repeated on the right": "_r <> 1"}.items():
        counts = counts.withColumn(what, F.expr(f"{key} is null or {bad}"))
    if found := counts.where("`missing or repeated on the left` or `missing or repeated on the right`").limit(10).collect():
        raise ValueError("; ".join(f"{w}: {[r[key] for r in found if r[w]]}" for w in ("missing or repeated on the left", "missing or repeated on the right") if any(r[w] for r in found)))
    return left.join(right, key)


def positional_join(left: DataFrame, right: DataFrame, group: str, pos: str) -> DataFrame:
    """Full outer join of two step lists by position."""
    return left.join(right, [group, pos], "full")


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key and how many others it had."""
    first = F.min_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("_r"), (F.count("*") - 1).alias("n_dropped")).select("_r.*", "n_dropped")


# Windows -------------------------------------------------------------------------------
def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def group_scaled(rows: DataFrame, value: str, group: Sequence[str], least: float = 1e-9) -> DataFrame:
    """`rows` with norm (scaled into 0..1 in the group, 0.5 without spread) and z (by the population's deviation, 0 without).

    Groups are aggregated map-side and joined back, so no task sorts or holds a whole group. `rows` are made once and
    written, since the aggregate and the join both read them.
    """
    rows = kept(rows, "scaled")
    stats = rows.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    v, span = F.col(value), F.col("_hi") - F.col("_lo")
    out = rows.join(stats, list(group)).withColumn("norm", F.when(span < least, 0.5).otherwise((v - F.col("_lo")) / span))
    return out.withColumn("z", F.when(F.col("_sd") < least, 0.0).otherwise((v - F.col("_mean")) / F.col("_sd"))).drop("_lo", "_hi", "_mean", "_sd")


def group_softmax(rows: DataFrame, logit: str, group: Sequence[str], to: str) -> DataFrame:
    """`rows` with the softmax of `logit` in the group.

    One aggregate gives each group's greatest value and sum: a task's part of a group is summed by the part's own greatest value, and
    parts are brought to one scale when they meet. `rows` are written once, and read by the aggregate and the join.
    """
    rows = kept(rows.withColumn("_part", F.spark_partition_id()), "softmax")
    tops = rows.groupBy(*group, "_part").agg(F.max(logit).alias("_m"))
    parts = rows.join(tops, [*group, "_part"]).groupBy(*group, "_part", "_m").agg(F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_s"))
    top = Window.partitionBy(*group)
    total = parts.withColumn("_top", F.max("_m").over(top)).groupBy(*group, "_top").agg(F.sum(F.col("_s") * F.exp(F.col("_m") - F.col("_top"))).alias("_sum"))
    return rows.join(total, list(group)).withColumn(to, F.exp(F.col(logit) - F.col("_top")) / F.col("_sum")).drop("_top", "_sum", "_part")


def prior_values(value: Column, group: Sequence[str], order: Sequence[Column]) -> Column:
    """The values before each row: lists that grow with the group, for groups that are short. See scans.prior_counts for others."""
    return F.collect_list(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


# Curation ------------------------------------------------------------------------------
def hash_unit(seed: str, key: Column) -> Column:
    """A fixed number in 0..1 for each key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0


def split_of(seed: str, key: Column, ratio: float) -> Column:
    return F.when(hash_unit(seed, key) < ratio, "dev").otherwise("train")


def hash_ranked(rows: DataFrame, seed: str, key: str, n: int, group: Sequence[str] = ()) -> DataFrame:
    """The n rows of least hash (in each group): a sample that any engine draws alike."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")).cast("binary"), 256)
    if group:
        return top_n(rows.withColumn("_h", digest), group, [F.col("_h"), F.col(key)], n).drop("_h", "rank")
    return rows.withColumn("_h", digest).orderBy("_h", key).limit(n).drop("_h")


def budget_pack(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The leading rows of each group whose sizes together keep to `budget`, with `used`."""
    return scanned(rows, group, order, {"used": ("sum", F.col(size))}).where(F.col("used") <= budget)


# Vectors -------------------------------------------------------------------------------
def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # The norm is an element that the inner function is bound to: else it would be taken again for each component.
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))), F.lit(0))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, id, score): exact top-k by inner product of unit vectors.

    Queries of at most `block_bytes` are broadcast and meet every Arrow batch in one matrix product; a task keeps only its own
    k best of a query. More queries meet the corpus in one shuffle of cells (see `vectors`), without a pass of the driver a block.
    """
    import numpy as np
    import pyarrow as pa

    from rillstone.operators.vectors import best_among, bounded_topk

    spark = corpus.sparkSession
    q = queries.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vec_col)).alias("v"))
    stats = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = stats["d"] or 1
    q = q.where(F.size("v") == width)
    vectors = corpus.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vec_col)).alias("v")).where(F.size("v") == width)
    if (stats["n"] or 0) * width * 8 > block_bytes:
        found, _ = bounded_topk(q, vectors, width, k, block_bytes=block_bytes)
        return top_n(found, ["query_id"], [F.desc("score"), F.col("id")], k)
    table = q.toArrow().combine_chunks()
    matrix = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width) if table.num_rows else np.zeros((0, width))
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(), matrix))

    def run(batches):
        ids, m = shared.value
        if len(ids):
            score, found = best_among(((b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows), m, k)
            good = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(1))), pa.array(found[good]), pa.array(score[good])], ["query_id", "id", "score"])

    found = vectors.mapInArrow(run, "query_id long, id long, score double")
    return top_n(found, ["query_id"], [F.desc("score"), F.col("id")], k)


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int, *, block_terms: int = 2_000_000) -> DataFrame:
    """(query_id, rank, doc_id, score): exact top-k by 3 * shared title tokens + shared text tokens.

    `queries` is (query_id, tokens) and `docs` (doc_id, title, text), all distinct token arrays. Queries go in blocks of at
    most `block_terms` tokens, one after the other where there are several; a block is broadcast as lists of
    queries by token, and a task keeps its k best of each. Every document competes, those without a shared token last.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), hashed("tokens").alias("t"))
    passes = max(1, -(-(q.agg(F.sum(F.size("t"))).first()[0] or 0) // block_terms))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed("title").alias("title"), hashed("text").alias("text"))
    out = None
    for number in range(passes):
        table = q.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).orderBy("query_id").toArrow().combine_chunks()
        ids = table["query_id"].to_numpy()
        sizes = np.array([len(x) for x in table["t"]], np.int64)
        terms, place = np.unique(table["t"].combine_chunks().flatten().to_numpy() if len(ids) else np.zeros(0, np.int64), return_inverse=True)
        by = np.argsort(place, kind="stable")
        shared = spark.sparkContext.broadcast((ids, terms, np.searchsorted(place[by], np.arange(len(terms) + 1)), np.repeat(np.arange(len(ids)), sizes)[by]))

        def run(batches, shared=shared):
            ids, terms, ptr, who = shared.value
            if not len(ids):
                return
            score, found = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                for a in range(0, b.num_rows, 256):
                    part = b.slice(a, 256)
                    new = np.zeros((len(ids), part.num_rows), np.int64)
                    for column, worth in ((1, 3), (2, 1)):
                        lists = part.column(column)
                        doc = np.repeat(np.arange(part.num_rows), np.array([0 if x is None or not x.is_valid else len(x) for x in lists], np.int64))
                        value = lists.flatten().to_numpy()
                        at = np.minimum(np.searchsorted(terms, value), max(len(terms) - 1, 0))
                        good = terms[at] == value if len(terms) else np.zeros(len(value), bool)
                        at, doc = at[good], doc[good]
                        n = ptr[at + 1] - ptr[at]
                        start = np.repeat(ptr[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
                        pair = who[start + np.arange(int(n.sum()))] * part.num_rows + np.repeat(doc, n)
                        new += worth * np.bincount(pair, minlength=new.size).reshape(new.shape)
                    score, found = np.concatenate([score, new], 1), np.concatenate([found, np.broadcast_to(part.column(0).to_numpy(), new.shape)], 1)
                    best = np.lexsort((found, -score), axis=1)[:, :k]
                    score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
            good = score >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, good.sum(1))), pa.array(found[good]), pa.array(score[good])], ["query_id", "doc_id", "score"])

        one = d.mapInArrow(run, "query_id long, doc_id long, score long")
        if passes > 1:
            one = kept(one, "lexical")
            shared.unpersist()
        out = one if out is None else out.unionByName(one)
    return top_n(out, ["query_id"], [F.desc("score"), F.col("doc_id")], k)
