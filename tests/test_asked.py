"""Model questions, selectors, pairs, chunks and metrics by name on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from rillstone.operators import curation as C
from rillstone.operators import metrics as M
from rillstone.sources import formats as X
from rillstone.streaming import models as A


def test_answers_that_fail(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "bb")], "id int, p string").coalesce(1)
    tries = []

    def broken(prompts):
        raise RuntimeError("429 rate limit")

    def short(prompts):
        return []

    for model, said in ((broken, "RuntimeError: 429 rate limit"), (short, "ValueError: as many responses as prompts are wanted")):
        got = {r["id"]: r for r in A.asked(rows, "p", model, attempts=2).collect()}
        assert got[1]["response"] is None and got[1]["failure"] == said and got[2]["attempts"] == 0
        assert got[1]["attempts"] == (2 if model is broken else 1)
        with pytest.raises(Exception):
            A.asked(rows, "p", model, attempts=2, on_failure="raise").collect()

    def second_time(prompts, tries=tries):
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("timeout")
        return [(p * 2, len(p), 2 * len(p)) for p in prompts]

    got = {r["id"]: r for r in A.asked(rows, "p", second_time).collect()}
    assert got[3]["response"] == "bbbb" and got[3]["attempts"] == 2 and got[3]["tokens_out"] == 4 and got[3]["failure"] is None


def test_what_answers_mean(spark):
    said = {"CORRECT": "correct", "it is Incorrect": "incorrect", "correct, not incorrect": "incorrect", "maybe": "unjudgeable", None: "ERROR:gone"}
    rows = spark.createDataFrame([(k,) for k in said], "r string")
    assert {r["r"]: r["v"] for r in rows.select("r", A.verdict(F.col("r"), F.lit("gone")).alias("v")).collect()} == said
    cases = ['{"error_category": "late", "rationale": "x"}', "[1]", "no", None, '"late"', "{}"]
    got = {r["r"]: r["e"] for r in spark.createDataFrame([(c,) for c in cases], "r string").select("r", A.error_class(F.col("r"), F.lit(None).cast("string")).alias("e")).collect()}
    assert got[cases[0]]["error_category"] == "late" and got["{}"]["error_category"] is None and all(got[c]["error_category"] == "classification_failed" for c in cases[1:5])
    values = {"score 70": 0.7, "-5": 0.0, "120 of 130": 1.0, "none": None}
    assert {r["r"]: r["v"] for r in spark.createDataFrame([(k,) for k in values], "r string").select("r", A.value_of(F.col("r")).alias("v")).collect()} == values
    texts = {"<evidence> a\nb </evidence>": "a\nb", "a": "", None: "", "<evidence>": ""}
    assert {r["r"]: r["v"] for r in spark.createDataFrame([(k,) for k in texts], "r string").select("r", A.evidence_of(F.col("r")).alias("v")).collect()} == texts


def test_selectors_by_item(spark):
    rows = [("s", 1, 1, ["a", "b"], ["x"]), ("s", 1, 2, ["c"], ["c", "a"]), ("s", 2, 1, [], ["q"]), ("s", 3, 1, ["z"], [])]
    got = M.selector_report(spark.createDataFrame(rows, "selector string, item int, step int, picked array<string>, gold array<string>")).first()
    # item 1 has golds x, c, a: one hit of two picked, then one of one
    assert got["n_steps"] == 4 and got["n_items"] == 3 and got["item_hit_pct"] == 33.3
    assert got["hit"] == 0.6667 and got["recall"] == round((1 / 3 + 1 / 3 + 0) / 3, 4) and got["noise"] == round((0.5 + 0 + 0) / 3, 4)


def test_metrics_by_name(spark):
    rows = spark.createDataFrame([("The cat", ["a cat", "dog"]), (None, ["x"])], "answer string, gold array<string>")
    got = M.scored(rows, names=["f1"]).collect()
    assert got[0]["f1"] == 1.0 and got[1]["f1"] == 0.0 and "em" not in got[0]
    with pytest.raises(ValueError):
        M.scored(rows, names=["bleu"])


def test_slices_and_chunks(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), F.when(F.col("id") % 10 > 0, "t").alias("t")).repartition(5)
    assert sorted(r["k"] for r in X.row_slice(rows, ["k"], 10, 4).collect()) == [10, 11, 12, 13]
    got = C.chunked(rows, ["k"], "t", 40).collect()
    want = sorted(r["k"] for r in got)
    assert len(got) == 90 and all((r["chunk"], r["place"]) == divmod(want.index(r["k"]), 40) for r in got)
    path = str(tmp_path / "chunks")
    assert X.write_chunks(rows.select("k"), "k", 30, path) == 4 and X.write_chunks(rows.select("k"), "k", 30, path) == 0
    assert X.write_chunks(rows.select("k").unionByName(spark.range(100, 101).toDF("k")), "k", 30, path) == 1
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == list(range(101))
    pairs = C.distinct_pairs(spark.createDataFrame([("q", "r "), (" q", "r"), ("q", ""), (None, "r")], "a string, b string"), "a", "b").collect()
    assert len(pairs) == 1 and pairs[0]["query"] == "q" and len(pairs[0]["key"]) == 32


def test_quantiles(spark):
    import numpy as np

    values = [("a", v) for v in (0.5, 3.25, 3.25, -2.0, 10.75, 4.0)] + [("b", 7.0), ("b", None), (None, 1.0), (None, 2.0)]
    got = {r["g"]: (r["q1"], r["m"]) for r in M.quantiles(spark.createDataFrame(values, "g string, v double"), "v", {"q1": 0.25, "m": 0.5}, ["g"]).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in values if k == g and v is not None]
        assert got[g] == pytest.approx((np.quantile(own, 0.25), np.quantile(own, 0.5)))


def test_digests_json_fields_and_waits(spark):
    """Values of what no query compares: keyed digests, fields that may be JSON, waits between tries."""
    import hashlib

    from rillstone.functions import text as T
    from rillstone.streaming import machines as W

    got = spark.createDataFrame([("abc",), ("é" * 300,), (None,)], "x string").select(T.keyed_digest(F.col("x"), b"k").alias("d")).collect()
    want = [hashlib.blake2b(x[:256].encode(), key=b"k", digest_size=16).hexdigest() for x in ("abc", "é" * 300, "")]
    assert [r["d"] for r in got] == want
    assert [W.delay(n, 1.0, share=1.0) for n in (0, 1, 2, 9)] == [1.0, 2.0, 4.0, 30.0] and W.delay(1, 1.0, share=0.0) == 1.0
    assert W.retryable(ValueError("HTTP 429")) and W.retryable(TimeoutError("Timed out")) and not W.retryable(ValueError("bad schema"))
