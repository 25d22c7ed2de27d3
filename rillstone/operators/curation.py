"""Joins with counted outcomes, samples, unions and the assembly of training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.operators.relational import hash_unit, top_n
from rillstone.operators.scans import scanned
from rillstone.sources.store import small


# Joins -----------------------------------------------------------------------------------
def with_missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and the rows of `left` without a partner."""
    return left.join(right, list(keys)), left.join(right, list(keys), "left_anti")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every row of `left` with its partner; a row without one fails the job."""
    marked = right.withColumn("_there", F.lit(True))
    gone = F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return left.join(marked, key, "left").withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), gone)).where("_ok is null").drop("_there", "_ok")


def reachable(rows: DataFrame, key: str, names: str, known: DataFrame, name: str) -> DataFrame:
    """(key, n_names, n_known): how many of an array of names are among the known ones, in normal form on both sides."""
    flat = rows.select(key, F.explode_outer(F.array_distinct(names)).alias(name))
    seen = known.select(name).distinct().withColumn("_known", F.lit(1))
    return flat.join(seen, name, "left").groupBy(key).agg(F.count(name).alias("n_names"), F.count("_known").alias("n_known"))


def overlap_report(left: DataFrame, right: DataFrame, form: Column, key: str, examples: int = 5) -> DataFrame:
    """One row: rows of `left` whose normal form, and whose key, are in `right`, and the first examples by key."""
    a, b = left.withColumn("_f", form), right.withColumn("_f", form)
    both = a.join(b.select("_f").distinct(), "_f", "left_semi")
    ids = left.join(right.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_same_key"))
    first = both.orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return both.agg(F.count("*").alias("n_same_text")).join(ids).join(first)


def first_source_wins(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """The first row of each key, with how many others it had and how many other values of `value` they held."""
    found = rows.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r"), (F.count("*") - 1).alias("n_dropped"), (F.count_distinct(value) - 1).alias("n_conflicts"))
    return found.select("_r.*", "n_dropped", "n_conflicts")


#: Fixed value: what stands between the parts of a pair's key.
PAIR_MARK = "\n--R3REF--\n"


def digest_key(*parts: Column, mark: str = PAIR_MARK) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(mark, *parts).cast("binary"), 256), 1, 32)


def distinct_pairs(rows: DataFrame, query: str, reference: str, mark: str = PAIR_MARK) -> DataFrame:
    """(key, query, reference) of each distinct pair of trimmed texts of which neither is blank; rows of an equal key are equal."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    some = rows.select(text(query).alias("query"), text(reference).alias("reference")).where("query <> '' and reference <> ''")
    return some.select(digest_key(F.col("query"), F.col("reference"), mark=mark).alias("key"), "query", "reference").dropDuplicates(["key"])


def chunked(rows: DataFrame, order: Sequence[str], text: str, size: int) -> DataFrame:
    """`rows` whose text isn't blank, with chunk and place: `size` rows a chunk in that order, numbered by ranges and not in one task."""
    some = rows.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    at = scanned(some, [], order, {"_n": ("count", F.lit(1))})
    return at.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).withColumn("place", (F.col("_n") - 1) % size).drop("_n")


def in_left_order(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows with a partner, sorted by the left side's `order`; keys that the right side repeats give a row each."""
    return left.join(right, key).orderBy(*order)


def failures_of(samples: DataFrame, results: DataFrame, key: str, correct: str) -> DataFrame:
    """Samples whose result is wrong (`correct` 0), with the result's columns; samples without a result are left out."""
    return samples.join(results.where(F.col(correct) == 0), key)


# Samples ---------------------------------------------------------------------------------
def sha_rank(seed: str, key: Column) -> Column:
    """SHA-256 of seed, a zero byte and the key: an order that any engine draws alike."""
    return F.sha2(F.concat(F.lit(seed).cast("binary"), F.unhex(F.lit("00")), key.cast("string").cast("binary")), 256)


def hash_subset(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The n rows of least hash; fails if there are fewer."""
    out = rows.withColumn("_h", sha_rank(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")
    found = rows.limit(n).count()
    if found < n:
        raise ValueError(f"{n} rows wanted, {found} there")
    return out


def ratio_sample(rows: DataFrame, seed: str, key: str, source: str, ratios: dict[str, float], total: int) -> DataFrame:
    """At most int(total * ratio) rows of each source, those of least hash; sources without a ratio are left out."""
    cap = F.coalesce(*[F.when(F.col(source) == s, int(total * r)) for s, r in ratios.items()], F.lit(0))
    ranked = rows.withColumn("_h", sha_rank(seed, F.col(key))).withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy("_h", key)))
    return ranked.where(F.col("_r") <= cap).drop("_h", "_r")


def diversified(rows: DataFrame, group: str, flag: Column, value: str, order: str, n: int) -> DataFrame:
    """n rows of different groups: flagged ones first, then by least value, then by greatest."""
    passes = [(0, F.col(order).cast("double"), flag), (1, F.col(value), F.lit(True)), (2, -F.col(value), F.lit(True))]
    every = None
    for number, by, good in passes:
        one = rows.where(good).select("*", F.struct(F.lit(number).alias("pass"), by.cast("double").alias("by"), F.col(order).alias("at")).alias("_rank"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(group).agg(F.min("_rank").alias("_rank"), F.min_by(F.struct(*rows.columns), "_rank").alias("_row"))
    return best.orderBy("_rank").limit(n).select("_row.*")


def first_units(rows: DataFrame, unit: Sequence[str], order: str, n: int) -> DataFrame:
    """All rows of the n units that come first."""
    units = rows.groupBy(*unit).agg(F.min(order).alias("_o")).orderBy("_o", *unit).limit(n).drop("_o")
    return rows.join(small(units), list(unit), "left_semi")


def by_number(rows: DataFrame, key: str) -> DataFrame:
    """Sorted by the key as a number if every key is one, else as text."""
    plain = rows.where(F.expr(f"try_cast({key} as bigint) is null")).isEmpty()
    return rows.orderBy(F.expr(f"try_cast({key} as bigint)") if plain else F.col(key))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """`rows` with their place from 0 in that order: ranges are sorted side by side, and one count a range comes to the driver."""
    from itertools import accumulate

    from rillstone.sources.store import kept

    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = kept(dealt, "ranges").withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = dealt.groupBy("_part").count().orderBy("_part").collect()
    starts = spark.createDataFrame(list(zip([r["_part"] for r in counts], accumulate([0] + [r["count"] for r in counts]))), "_part long, _start long")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_at", "_part", "_row", "_start")


# Sets ------------------------------------------------------------------------------------
def distinct_in_order(values: Column, form=F.lower) -> Column:
    """Values whose form none before has."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: form(y) == form(x)), acc).otherwise(F.concat(acc, F.array(x))))


def distinct_docs(rows: DataFrame, key: str, title: str, text: str, order: Sequence[str], head: int = 80) -> DataFrame:
    """The first of each key's documents with one title and one beginning."""
    first = rows.groupBy(key, title, F.left(text, F.lit(head)).alias("_head")).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


# Evidence --------------------------------------------------------------------------------
def gold_evidence(facts: Column, context: Column, form) -> Column:
    """array<struct<title, sentences>> by distinct title, in order of the facts, array<struct<title, sent_id>>.

    Sentences come from the context, array<struct<title, sentences array<string>>>, by title and number within bounds; repeats go.
    """
    named = F.filter(facts, lambda f: F.trim(F.coalesce(f["title"], F.lit(""))) != "")
    keys = F.array_distinct(F.transform(named, lambda f: form(f["title"])))

    def item(key: Column) -> Column:
        own = F.filter(named, lambda f: form(f["title"]) == key)
        held = F.try_element_at(F.filter(context, lambda c: form(c["title"]) == key), F.lit(-1))["sentences"]  # the last of equal titles
        said = F.transform(own, lambda f: F.when(f["sent_id"] >= 0, F.trim(F.get(held, f["sent_id"]))))
        return F.struct(F.trim(F.get(own, F.lit(0))["title"]).alias("title"), F.array_distinct(F.filter(said, lambda s: s.isNotNull() & (s != ""))).alias("sentences"))

    return F.transform(keys, item)


def hop_evidence(hops: Column, paragraphs: Column, form) -> Column:
    """array<struct<title, sentences>> of the paragraphs that hops (array<int>) name by idx; of supporting ones if that gives none.

    paragraphs: array<struct<idx, title, text, supporting>>.
    """
    used = F.filter(F.transform(hops, lambda h: F.try_element_at(F.filter(paragraphs, lambda p: p["idx"] == h), F.lit(-1))), lambda p: p.isNotNull() & (F.coalesce(p["title"], F.lit("")) != ""))
    marked = F.filter(paragraphs, lambda p: p["supporting"] & (F.coalesce(p["title"], F.lit("")) != ""))

    def grouped(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: form(p["title"])))
        texts = lambda key: distinct_in_order(F.filter(F.transform(F.filter(ps, lambda p: form(p["title"]) == key), lambda p: F.coalesce(p["text"], F.lit(""))), lambda t: t != ""))
        return F.transform(keys, lambda key: F.struct(F.get(F.filter(ps, lambda p: form(p["title"]) == key), F.lit(0))["title"].alias("title"), texts(key).alias("sentences")))

    return F.when(F.size(used) > 0, grouped(used)).otherwise(grouped(marked))


# Assembly --------------------------------------------------------------------------------
def assembled(candidates: DataFrame, unit: Sequence[str], *, least: int = 2, alpha: float = 0.5, drop_negative: bool = True) -> DataFrame:
    """One row a unit with its kept candidates and their rank targets.

    `candidates` has reason (see reason_join), label, score, doc_id. A unit keeps candidates whose reason is
    'kept'; status says what becomes of it: ok, too_few or all_negative. The target is a softmax over
    alpha * label + (1 - alpha) * score, scaled into 0..1 in the unit (0.5 without spread).
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("reason") == "kept", F.struct("doc_id", F.col("label").cast("double").alias("label"), F.col("score").cast("double").alias("score")))))
    count = lambda r: F.count_if(F.col("reason") == r)
    u = candidates.groupBy(*unit).agg(kept.alias("_k"), count("missing_label").alias("n_missing"), count("failed_label").alias("n_failed"))
    lo, hi = F.array_min(F.transform("_k", lambda c: c["score"])), F.array_max(F.transform("_k", lambda c: c["score"]))
    u = u.withColumns({"n_kept": F.size("_k"), "n_pos": F.aggregate("_k", F.lit(0.0), lambda acc, c: acc + c["label"]).cast("int"), "_lo": lo, "_hi": hi})
    norm = lambda c: F.when(F.col("_hi") - F.col("_lo") < 1e-9, 0.5).otherwise((c["score"] - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    u = u.withColumn("_z", F.transform("_k", lambda c: alpha * c["label"] + (1 - alpha) * norm(c)))
    u = u.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e))
    status = F.when(F.col("n_kept") < least, "too_few").when((F.col("n_pos") == 0) & F.lit(drop_negative), "all_negative").otherwise("ok")
    listed = F.transform("_k", lambda c, i: F.struct(c["doc_id"].alias("doc_id"), c["label"].cast("int").alias("label"), F.round(norm(c), 6).alias("score_norm"), F.round(F.get("_e", i) / F.col("_s"), 6).alias("target")))
    return u.select(*unit, status.alias("status"), "n_missing", "n_failed", "n_kept", "n_pos", (F.col("n_pos") == F.col("n_kept")).alias("all_positive"), listed.alias("candidates"))


def packed_prompt(prefix: Column, blocks: Column, suffix: Column, most: int, sep: str = "\n") -> Column:
    """struct(prompt, used, truncated): as many leading blocks as keep the whole prompt within `most` bytes; the first that doesn't ends it."""
    base = F.octet_length(prefix) + F.octet_length(suffix)
    start = F.struct(F.lit(0).alias("n"), base.alias("bytes"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        more = acc["bytes"] + F.octet_length(x) + F.when(acc["n"] > 0, len(sep.encode())).otherwise(0)
        full = acc["full"] | (more > most)
        return F.struct(F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(full, acc["bytes"]).otherwise(more).alias("bytes"), full.alias("full"))

    n = F.aggregate(blocks, start, step, lambda acc: acc["n"])
    return F.struct(F.concat(prefix, F.array_join(F.slice(blocks, F.lit(1), n), sep), suffix).alias("prompt"), n.alias("used"), (n < F.size(blocks)).alias("truncated"))


def chat(system: Column, user: Column) -> Column:
    """Messages of a prompt: array<struct<role, content>>."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user))


def rendered_history(history: Column) -> Column:
    """array<struct<query, evidence>> as numbered lines; empty without history."""
    return F.array_join(F.transform(history, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". query: "), h["query"], F.lit(" | evidence: "), F.coalesce(h["evidence"], F.lit("None")))), "\n")


def training_row(instruction: Column, output: Column) -> Column:
    """struct(status, instruction, output) of a step record: question and earlier steps in, the current step's action out."""
    from rillstone.functions import text as T

    question, before, now = T.question_of(instruction), T.step_blocks(instruction), T.step_blocks(output)
    one = F.get(now, F.lit(0))
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.trim(c))
    said = lambda word, tag, c: F.concat(F.coalesce(one["analysis"], F.lit("")), F.lit(f"\n\nSo the {word} is <{tag}>"), c, F.lit(f"</{tag}>"))
    out = F.coalesce(said("answer", "answer", some(one["answer"])), said("next query", "query", some(one["query"])))
    thoughts = F.array_join(F.filter(F.transform(before, lambda s: s["analysis"]), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    status = (
        F.when(F.coalesce(question, F.lit("")) == "", "no_question").when(F.size(now) == 0, "no_current_step").when(F.size(now) > 1, "output_not_single_step").when(out.isNull(), "current_step_no_query_or_answer")
        .when(~T.single_action(out), "unbalanced_output_tags").otherwise("ok")
    )
    text = F.concat(F.lit("Question: "), question, F.when(thoughts != "", F.concat(F.lit("\nPrevious Thoughts: "), thoughts)).otherwise(""))
    return F.struct(status.alias("status"), F.when(status == "ok", text).alias("instruction"), F.when(status == "ok", F.trim(out)).alias("output"))


# Records ---------------------------------------------------------------------------------
def without_columns(rows: DataFrame, names: Sequence[str] = (), prefix: str = "teacher_", required: Sequence[str] = ()) -> DataFrame:
    """`rows` without the named columns and those that begin with `prefix`; an error names required ones that are missing."""
    if gone := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"missing required fields: {gone}")
    return rows.drop(*[c for c in rows.columns if c in names or c.startswith(prefix)])


def valid_inputs(rows: DataFrame, key: str, question: str, golds: str) -> Column:
    """Whether a row has an id, a question that isn't blank and some gold."""
    return F.col(key).isNotNull() & (F.trim(F.coalesce(question, F.lit(""))) != "") & (F.coalesce(F.size(golds), F.lit(0)) > 0)


def unrolled(rows: DataFrame, lead: str, others: Sequence[str]) -> DataFrame:
    """One row an element of the list column `lead`: the other columns' elements at its place, or null beyond their ends."""
    flat = rows.select("*", F.posexplode(lead).alias("row_idx", "_one"))
    return flat.withColumns({lead: F.col("_one"), **{c: F.get(c, F.col("row_idx")) for c in others}}).drop("_one")


def shown_history(steps: Column) -> Column:
    """array<struct<query, evidence>> of steps, array<struct<query, evidence, docs array<struct<title, text>>>>: the first document where no evidence was read."""
    doc = lambda s: F.get(s["docs"], F.lit(0))
    seen = lambda s: F.when(s["evidence"].isNotNull(), F.trim(F.when(s["evidence"] != "", s["evidence"]).otherwise("None"))).otherwise(F.trim(F.coalesce(F.concat(doc(s)["title"], F.lit(". "), doc(s)["text"]), F.lit(""))))
    return F.transform(steps, lambda s: F.struct(F.coalesce(s["query"], F.lit("")).alias("query"), seen(s).alias("evidence")))


def oracle_context(paragraphs: Column, once: bool) -> Column:
    """Paragraphs, array<struct<title, text>>, that have a text, as [title] blocks; with `once` the first of each title."""
    full = F.filter(paragraphs, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    if once:
        titles = F.transform(full, lambda p: p["title"])
        full = F.filter(F.transform(full, lambda p, i: F.when((F.array_position(titles, p["title"]) == i + 1) & (p["title"] != ""), p)), lambda p: p.isNotNull())
    return F.array_join(F.transform(full, lambda p: F.concat(F.lit("["), p["title"], F.lit("]\n"), p["text"])), "\n\n")


def unit_recall(rows: DataFrame, found: str, gold: str, first: Column) -> DataFrame:
    """One row: gold names found over gold names, counted on the rows where `first` holds, and how many those are."""
    hits, n = F.size(F.array_intersect(found, gold)), F.size(gold)
    return rows.where(first).agg(F.count("*").alias("n_units"), F.coalesce(F.bround(F.try_divide(F.sum(hits).cast("double"), F.sum(n).cast("double")), 4), F.lit(0.0)).alias("recall"))


def observed(rows: DataFrame, name: str, **counts: Column):
    """(rows, observation): counters that fill while the rows are written, without a pass of their own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen
