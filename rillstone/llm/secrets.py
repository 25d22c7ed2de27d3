"""Secret scans with character Markov models (operator 9), in built-in functions only.

Three fixed patterns give the base spans. Beside them, every maximal run of 20 or more
token characters outside them is scored by two first-order character Markov models,
one of random strings and one of ordinary identifiers; a run whose log-likelihood
ratio a character reaches `threshold` is a span of kind ``markov``. A run of over 512
is scored in pieces of 512, each half over the one before; its pieces that reach the
threshold outside the base spans are merged where they overlap. The models are two
tables of character pairs counted from labelled samples: random strings of several
encodings made from hashes, and as ordinary ones fixed identifiers and the words of at
most `sample_docs` documents (those of the least hashes of their ids) outside the base
spans. What comes to the driver is one count a pair of characters and label.

Positions come from the pieces between matches: a match starts where the pieces and
matches before it end, counted in code points.

Defined results: null and empty texts have no spans; nested or touching spans of
different kinds all stay; equal starts order by kind as listed; repeated rows are all
kept; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order that ties keep, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PIECE = 512
IDENTIFIERS = "user name index value list item count total error message request response handler config option buffer stream reader writer table column query result session thread worker manager factory service client server path file line token parser node tree graph edge cache key map set hash list page image event state action update delete insert create default test case data model view controller main init start stop time date number string array object class method field type version license the of and to in".split()

SPAN = "array<struct<start:int,end:int,rank:int>>"
_N = len(ALPHABET) + 1


def _found(text: Column, pattern: str, rank: int, good, piece: int | None = None) -> Column:
    """Spans of the matches of `pattern`, or of half-overlapping pieces of longer ones, for which good(whole match, second group) holds."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(2)) if rank == 0 else whole
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank")))
        out = F.when(x["whole"].isNotNull() & good(x["whole"], x["value"]), F.concat(acc["out"], span)).otherwise(acc["out"])
        if piece:
            at = F.filter(F.sequence(F.lit(0), F.length(x["whole"]) - piece // 2 - 1, F.lit(piece // 2)), lambda i: good(part := F.substring(x["whole"], i + 1, F.lit(piece)), part))
            parts = F.transform(at, lambda i: F.struct((begin + i).alias("start"), F.least(begin + i + piece, end).alias("end"), F.lit(rank).alias("rank")))
            out = F.when(F.length(x["whole"]) > piece, F.concat(acc["out"], parts)).otherwise(out)
        return F.struct(end.alias("at"), out.alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _merged(spans: Column) -> Column:
    """Spans in order of their starts, overlapping ones made one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
        return F.when(last["end"] >= s["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), both)).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(SPAN), step)


def base_spans(text: Column) -> Column:
    """The base spans of all kinds."""
    yes = lambda whole, value: F.lit(True)
    return F.concat(_found(text, ASSIGN, 0, lambda whole, value: F.length(value) >= ASSIGN_VALUE), _found(text, ACCESS, 1, yes), _found(text, HEX, 2, yes))


def _symbol(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def _pairs(token: Column) -> Column:
    """Character pairs of a token as numbers."""
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: _symbol(F.substring(token, i, F.lit(1))) * _N + _symbol(F.substring(token, i + 1, F.lit(1))))


def labelled_samples(docs: DataFrame, *, n_random: int = 3000, sample_docs: int = 400) -> DataFrame:
    """(token, secret): the default training samples; see the module's docstring."""
    spark = docs.sparkSession
    key = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 512)
    made = spark.range(n_random).select(
        F.explode(F.array(F.substring(F.base64(F.unhex(key)), 1, 40), F.substring(key, 1, 40), F.regexp_replace(F.substring(F.base64(F.unhex(F.sha2(key.cast("binary"), 512))), 1, 44), "[+/=]", "_"), F.upper(F.substring(F.conv(F.substring(key, 1, 15), 16, 36), 1, 20)))).alias("token")
    )
    names = F.array(*[F.lit(x) for x in IDENTIFIERS])
    pick = lambda k: F.element_at(names, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIERS))) + 1).cast("int"))
    idents = spark.range(n_random).select(F.explode(F.array(F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(4), F.initcap(pick(5)), F.initcap(pick(6))), F.concat_ws("-", pick(7), pick(8), pick(9)), F.concat_ws("/", pick(1), pick(5), pick(9)), F.upper(F.concat_ws("_", pick(2), pick(6))))).alias("token"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{6,64}+(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("token"))
    return made.withColumn("secret", F.lit(True)).unionByName(idents.unionByName(words).withColumn("secret", F.lit(False)))


def pair_table(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character after each other, by pair number."""
    rows = samples.where("token is not null and secret is not null").select("secret", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("secret", "pair").count().collect()
    n = {True: [0.0] * (_N * _N), False: [0.0] * (_N * _N)}
    for r in rows:
        n[r["secret"]][r["pair"]] += r["count"]
    out = []
    for a in range(_N):
        total = {s: sum(n[s][a * _N : (a + 1) * _N]) + 0.5 * _N for s in n}
        out += [math.log((n[True][a * _N + b] + 0.5) / total[True]) - math.log((n[False][a * _N + b] + 0.5) / total[False]) for b in range(_N)]
    return out


def scan(docs: DataFrame, samples: DataFrame | None = None, *, threshold: float = 0.7) -> DataFrame:
    """(doc_id, base, found): arrays of spans (start, end, rank in KINDS); `found` holds the base ones too."""
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in pair_table(samples if samples is not None else labelled_samples(docs))])), "array<double>")

    def random(token: Column) -> Column:
        ratio = F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))
        return ratio >= F.length(token) * threshold

    based = docs.withColumn("base", base_spans(F.col("text"))).withColumn("runs", _found(F.col("text"), TOKEN, 3, lambda whole, value: random(whole), PIECE))
    apart = _merged(F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))
    # Structs order by their fields: start, then end; ties of the start go by kind, so the kind stands second here.
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))), lambda s: s)
    return based.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", apart)).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
