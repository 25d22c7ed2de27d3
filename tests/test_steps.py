"""Functions and operators over steps, trees, credit and state machines on cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from rillstone.functions import scoring as S
from rillstone.functions import text as T
from rillstone.operators import credit as C
from rillstone.operators import curation as U
from rillstone.operators import metrics as M
from rillstone.operators import relational as R
from rillstone.operators import trees as G
from rillstone.sources import formats as X
from rillstone.streaming import limits
from rillstone.streaming import machines as A


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    x = F.col("x")
    for text, want in {
        "<evidence>Paris is big.</evidence>": "Paris is big.", "<evidence>None</evidence> So the next query is <query>who</query>": "", "Error Reflection: No errors found.": "No errors found.",
        "To answer this question, we must look.\nThe city  is old.": "The city is old.", " ".join(["w"] * 30): " ".join(["w"] * 25), "a <answer>b": "a b",
    }.items():
        assert one(spark, T.clean_thought(x), x=text) == want
    assert one(spark, T.clean_thought(x, fallback=F.lit("f")), x="<query>q</query>") == "f" and one(spark, T.clean_thought(x, fallback=F.lit("f")), x=None) == "f"
    assert one(spark, T.clean_subquery(x), x='So the next query is "who is it".\nmore') == "who is it" and one(spark, T.clean_subquery(x), x="<query> a </query><query> b </query>") == "b"
    assert one(spark, T.inferred_subquery(x, F.lit("q")), x="So the next query is who won. And more.") == "who won" and one(spark, T.inferred_subquery(x, F.lit("q")), x="We should Find the mayor. Then Look up the town.") == "the town" and one(spark, T.inferred_subquery(x, F.lit("q")), x="nothing") == "q"


def test_tags(spark):
    x = F.col("x")
    for text, want in {"<query>a</query>": "query_only", "<answer>a</answer>": "answer_only", "a": "neither", "<query>a</query><answer>b</answer>": "query_then_answer", "<answer>b</answer> <query>a</query>": "answer_then_query", "<answer>b</answer><query>a</query><answer> </answer>": "query_then_answer"}.items():
        assert one(spark, T.completion_shape(x), x=text) == want
    assert one(spark, T.ends_with_answer(x), x="<answer>b</answer><query>a</query><answer> </answer>") == 0.0 and one(spark, T.ends_with_answer(x), x="<query>a</query><answer>b</answer>") == 1.0
    assert one(spark, T.close_tag(x, "query"), x="so <query>who </que") == "so <query>who </que</query>" and one(spark, T.close_tag(x, "query"), x="so <query>who </query ") == "so <query>who </query>"
    assert one(spark, T.before_closing(x, "answer"), x="big </ans") == "big " and one(spark, T.before_closing(x, "answer"), x="big <b") == "big <b" and one(spark, T.before_closing(x, "answer"), x="a</answer>b") == "a"
    assert one(spark, T.tagged_parts(x), x="So the next query is who won.") == "So the next query is <query>who won</query>" and one(spark, T.last_protocol_answer(x), x="So the answer is Rome. Yes") == "Rome"
    assert one(spark, T.similarity_ratio(x, F.lit("abcd")), x="bcde") == 0.75


def test_transitions(spark):
    rows = [
        ("Who is the mother of John Smith?", "query_rewrite", "<query>John Smith mother</query>", "", [], ["Who is the mother of John Smith?"]), ("Who is the mother of John Smith?", "query_rewrite", "<query>John Smith mother</query>", "", ["John Smith mother"], []),
        ("Who?", "document_analysis", "<evidence>None</evidence>", "x", [], ["Who?"]), ("Who?", "reasoning", "<answer>me</answer>", "", [], ["Who?"]), ("Who?", "reasoning", "<answer>me</answer>", "", [], []),
    ]
    got = S.transitions(spark.createDataFrame(rows, "question string, action string, response string, query string, history array<string>, open_gaps array<string>")).collect()
    assert got[0]["failure_type"] == "success" and got[0]["phi_q"] > 0.9 and got[1]["phi_q"] == 0.2 and got[1]["failure_type"] == "query_fail"
    assert got[2]["failure_type"] == "query_fail" and got[2]["phi_c"] == 0.0 and got[3]["phi_s"] == -1.0 and got[3]["failure_type"] == "stop_fail" and got[4]["phi_s"] == 1.0 and got[4]["typed_score"] == 1.0


def test_trees_of_any_depth(spark):
    rows = [(0, i, max(i - 1, 1)) for i in range(1, 102)] + [(0, 201, 202), (0, 202, 201), (0, 203, 201), (0, 300, 299)]
    n = spark.createDataFrame(rows, "tree long, node long, parent long")
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in G.paths(n).collect()}
    assert got == {**{i: (1, i - 1, list(range(1, i + 1))) for i in range(1, 102)}, 300: (300, 0, [300])}


def test_tree_search(spark):
    q = spark.createDataFrame([(1, "abcdef"), (2, "x")], "id long, text string")
    found = G.tree_search(q, "id", lambda s, k: {"text": s["text"] + str(k)}, lambda s: (sum(map(ord, s["text"])) % 7) / 7, rollouts=30, width=2, depth=3).collect()
    for key in (1, 2):
        t = {r["node"]: r for r in found if r["id"] == key}
        kids = {k: [r for r in t.values() if r["parent"] == k] for k in t}
        assert t[0]["visits"] == 30 and all(len(c) <= 2 for c in kids.values()) and max(r["depth"] for r in t.values()) == 3
        for k, r in t.items():  # a node's visits are its own valuations and its children's
            below = sum(c["visits"] for c in kids[k])
            assert r["visits"] >= below and (r["depth"] == 3 or k == 0 or r["visits"] - below == 1)
        assert math.isclose(t[0]["q"], sum(c["q"] * c["visits"] for c in kids[0]) / 30)


def test_credit(spark):
    rows = [("p", "a", 0, 0.5, 1.0, 0.1, 0.5), ("p", "b", 0, 0.2, 2.0, -0.1, 0.4), ("p", "b", 1, 0.2, 2.0, -0.1, 0.4)]
    t = spark.createDataFrame(rows, "grp string, sample string, turn int, gain double, reward double, advantage double, relevance double")
    got = {(r["sample"], r["turn"]): r["query_advantage"] for r in C.causal_returns(t, "grp", "sample", "turn").collect()}
    assert got == {("a", 0): 0.1, ("b", 0): -0.1, ("b", 1): -0.1}  # the first turn, and a slot of one, have the sample's own
    with pytest.raises(Exception):
        C.causal_returns(t.withColumn("relevance", F.lit(9.0)), "grp", "sample", "turn").collect()
    with pytest.raises(ValueError):
        S.signed_query_advantage(F.lit(1.0), F.lit(1.0), 0.9, 1.5)
    assert one(spark, S.failed_gate(F.col("x")), x=float("nan")) and not one(spark, S.failed_gate(F.col("x")), x=1.0)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, float(i - 4)) for i in range(11)], "k long, d double")
    got = M.bootstrap_summary(M.bootstrap_sums(rows, "k", ["d"], rounds=400)).first()
    assert got["low"] < 1.0 < got["high"] and got["p_two_sided"] == pytest.approx(min(1.0, 2 * min(got["p_le"], got["p_ge"])))


def test_ranked_values(spark):
    values = [0.5, 3.25, 3.25, -2.0, 10.75, 4.0, 4.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = M.ranked_value(rows, "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).first()
    pick = lambda q: sorted(values)[round((len(values) - 1) * q)]
    assert (got["p50"], got["p95"], got["p0"]) == (pick(0.5), pick(0.95), pick(0.0))


def test_lexical_search_in_blocks(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "query_id long, tokens array<string>")
    d = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, [], ["a", "c"]), (3, ["b", "c"], ["x"])], "doc_id long, title array<string>, text array<string>")
    want = [(1, 1, 1, 5), (1, 2, 3, 3), (2, 1, 3, 3), (2, 2, 2, 1), (3, 1, 1, 0), (3, 2, 2, 0)]
    for size in (1000, 1):
        assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in R.lexical_topk(q, d, 2, block_terms=size).collect()) == want


def test_aligned_and_samples(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception):
        U.aligned(a, a.where("k = 1").withColumn("v", F.lit(1)), "k").collect()
    assert U.aligned(a, a.withColumn("v", F.lit(1)), "k").count() == 2
    with pytest.raises(ValueError):
        U.hash_subset(a, "s", "k", 3)
    assert [r["k"] for r in U.numbered(spark.range(50).withColumnRenamed("id", "k").repartition(4), ["k"], "at").where("k = at").collect()] != [] and U.numbered(a, ["k"], "at").where("at = k - 1").count() == 2


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    X.publish(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        X.publish(rows.limit(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(FileNotFoundError):
        X.existing(spark, [str(tmp_path / "none")])
    with pytest.raises(KeyError):
        X.Paths({"a": "b"}).other
    (tmp_path / "x.jsonl").write_text('{"k": 1, "v": "a"}\n\n{broken\n{"k": 2, "v": "b"}\n')
    assert [tuple(r) for r in X.broken_lines(spark, str(tmp_path / "x.jsonl"), "k long, v string").collect()] == [(3, "{broken")]
    # Files that are read in many small pieces, numbered each and through.
    for i in range(3):
        (tmp_path / f"n{i}.jsonl").write_text("".join("{broken\n" if j % 40 == 7 else "\n" if j == 3 else f'{{"k": {j}, "v": "{i}"}}\n' for j in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        numbers = [(r["file"][-8:-6], r["number"]) for r in X.lines(spark, str(tmp_path / "n*.jsonl")).where("value = '{broken'").orderBy("file", "number").collect()]
        through = [r["number"] for r in X.broken_lines(spark, str(tmp_path / "n*.jsonl"), "k long, v string", 7, through=True).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers == [(f"n{i}", j) for i in range(3) for j in (8, 48, 88)] and through == [8, 48, 88, 108, 148, 188, 208]
    (tmp_path / "y.json").write_text('\n [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]')
    assert X.sniffed(spark, str(tmp_path / "y.json"), "k long, v string").count() == 2


def test_answer_events(spark):
    pieces = ["so <ans", "wer>Par", "is </a", "b </ans", "wer> more"]
    got = one(spark, A.answer_events(F.col("x")), x=pieces)
    assert got["deltas"] == ["Par", "is ", "</ab "] and got["done"]
    for pieces, deltas, done in (([], [], False), (["<answer>"], [], False), (["<answer>é<", "", "/answer>x</answer>"], ["é"], True), (["<answer>a</answer>", "b"], ["a"], True), (["</answer><answer>a<", "b"], ["a", "<b"], True), (["<answer>a", None, "b"], ["a"], None)):
        got = one(spark, A.answer_events(F.col("x")), x=pieces)
        assert (got["deltas"], got["done"]) == (deltas, done), pieces


def test_answer_events_of_a_long_text(spark):
    """Each piece costs its own length: a text of a million characters in pieces of four (before: its square, and no end in hours)."""
    pieces = ["<answer>", *(f"é{i % 100:02d}<" for i in range(250_000)), "</ans", "wer>"]
    got = one(spark, A.answer_events(F.col("x")), x=pieces)
    assert "".join(got["deltas"]) == "".join(pieces[1:-2]) and got["done"] and len(got["deltas"]) == 250_001


def test_limiter_rule():
    from collections import deque

    times = deque()
    waits = [limits.decide(times, t, 2, 10.0, 3.0) for t in (0.0, 1.0, 3.0, 9.0, 10.5)]
    assert waits == [0.0, 2.0, 0.0, 1.0, 0.0] and list(times) == [3.0, 10.5]
