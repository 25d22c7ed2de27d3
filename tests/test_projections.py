"""Projections of run records with missing fields, and protocol checks, on cases with known answers."""

import json

from pyspark.sql import functions as F

from rillstone.operators import projections as P
from rillstone.operators import protocol as V


def test_records_with_missing_fields(spark):
    step = lambda q, **o: {"query": q, **o}
    infos = [
        {}, {"retrieved_steps": [step("A b"), step("a  B!", exact_duplicate=True, search_executed=False), step(None), step("c", retrieval_error="x")]},
        {"num_turns": 6, "retrieved_steps": [step("a")]}, {"num_turns": 0, "finish_reason": "", "actual_retrieval_rpc_count": 9}, {"retrieved_steps": [step(str(i)) for i in range(5)]},
    ]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(infos)], "i int, j string").coalesce(1)
    b = {r["i"]: r["b"] for r in rows.select("i", P.behavior_of(F.from_json("j", P.INFO)).alias("b")).collect()}
    assert b[0]["num_turns"] == 0 and b[0]["finish_reason"] == "stopped" and not b[0]["has_exact_duplicate"]
    assert (b[1]["num_queries"], b[1]["actual_search_count"], b[1]["exact_duplicate_count"], b[1]["intercepted_repeat_count"], b[1]["repeat_count_from_text"], b[1]["retrieval_error_count"]) == (4, 3, 1, 1, 1, 1)
    assert b[2]["finish_reason"] == "max_turns_exceeded" and b[2]["num_turns"] == 6 and b[3]["actual_search_count"] == 9 and b[3]["finish_reason"] == "stopped" and b[4]["finish_reason"] == "max_turns_exceeded"
    trace = [{"rollout_infos": None}, {"rollout_infos": {}}, {"rollout_infos": {"retrieved_steps": [{"docs": [{"title": "t", "text": "x"}]}, {}]}}, {"rollout_infos": {"retrieved_steps": [{"docs": [{"title": "u", "text": "y"}]}]}}]
    t = spark.createDataFrame([(json.dumps(trace),), ("[]",), (None,)], "j string").select(F.from_json("j", P.TRACE).alias("t")).select(P.first_steps(F.col("t")).alias("s"), P.retrieved_docs(F.col("t")).alias("d")).collect()
    assert len(t[0]["s"]) == 2 and [d["title"] for d in t[0]["d"]] == ["t", "u"] and t[1]["s"] == t[1]["d"] == [] and t[2]["d"] == []


def test_means_pairs_and_golds(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert rows.agg(P.mean(F.col("v")).alias("m")).first()["m"] == 2.0 and rows.where("v is null").agg(P.mean(F.col("v")).alias("m")).first()["m"] is None
    pairs = {("a", "b"): "ok", ("a", "a"): "equal", (" \n", "b"): "empty", (None, "b"): "empty", ("a", None): "empty"}
    got = spark.createDataFrame([*pairs], "c string, r string").select("c", "r", P.preference_row(F.lit("s"), F.lit("u"), F.col("c"), F.col("r")).alias("p")).collect()
    assert {(r["c"], r["r"]): r["p"]["status"] for r in got} == pairs and all((r["p"]["row"] is not None) == (r["p"]["status"] == "ok") for r in got)
    golds = {("Rome", "rome "): ("rome ", "answer_already_same"), ("Rome", "Oslo"): ("Oslo", "answer_replaced"), ("Rome", None): ("Rome", "missing_gold"), ("", "Oslo"): (None, None), (None, None): (None, None)}
    got = spark.createDataFrame([*golds], "a string, g string").select("a", "g", P.canonical_answer(F.col("a"), F.col("g")).alias("x")).collect()
    assert {(r["a"], r["g"]): tuple(r["x"]) for r in got} == golds


def test_protocol(spark):
    """A clean run passes; a repeated id, another id set, too many failures and a run that isn't there are named."""
    step = (True, False, None, 2)
    rows = []
    for config, ids in (("s2", [1, 2]), ("s3", [1, 3, 3])):
        for i in ids:
            rows.append((config, "d", i, 2, 2, (2, 2, "p", 1, 1, False, False, int(i == 3)), [step], "x", None, ["role"]))
    schema = "config string, dataset string, id long, max_searches int, top_k int, behavior struct<max_searches:int,top_k:int,forced_answer_protocol:string,logical_search_count:int,actual_retrieval_rpc_count:int,forced_answer:boolean,forced_answer_valid:boolean,retrieval_error_count:int>, steps array<struct<search_executed:boolean,exact_duplicate:boolean,retrieval_error:string,n_docs:bigint>>, answer string, error string, message_keys array<string>"
    expected = spark.createDataFrame([("s2", "d", 2), ("s3", "d", 2), ("s4", "d", 2)], "config string, dataset string, rows long")
    broken, summary = V.validated(spark.createDataFrame(rows, schema), expected, "p", 0.5)
    assert {(r["config"], r["rule"]): r["n"] for r in broken.collect()} == {("s3", "row_count"): 3, ("s3", "duplicate_ids"): 1, ("s3", "id_set_differs"): 1, ("s3", "service_failure_rate"): 2, ("s4", "missing_results"): 1}
    assert {r["config"]: (r["n"], r["passed"]) for r in summary.collect()} == {"s2": (2, True), "s3": (3, False), "s4": (0, False)}
