"""Scans, masks, search in lockstep, protocol checks and TeX arguments against plain loops."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillstone.operators import lockstep as K
from rillstone.operators import masks as M
from rillstone.operators import metrics as B
from rillstone.operators import scans as S
from rillstone.operators import trees as G
from rillstone.sources import formats as X


def hot_rows(n=3000):
    rng = random.Random(1)
    return [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randrange(1000), None if rng.random() < 0.1 else rng.randrange(-50, 50)) for i in range(n)]


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_scan(spark, backward, own):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "i long, g string, at int, v int").repartition(4)
    wanted = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "mean": ("mean", F.col("v"))}
    got = {r["i"]: (r["s"], r["c"], r["hi"], r["lo"], r["mean"]) for r in S.scanned(df, ["g"], ["at", "i"], wanted, backward=backward, own=own).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups[r[1]].append(r)
    assert len(got) == len(rows)
    for group in groups.values():
        for k, r in enumerate(group):
            part = group[k + (not own) :] if backward else group[: k + own]
            v = [x[3] for x in part if x[3] is not None]
            want = (sum(v), len(v), max(v), min(v), sum(v) / len(v)) if v else (None, 0, None, None, None)
            assert got[r[0]] == pytest.approx(want) if v else got[r[0]] == want
    with pytest.raises(ValueError):
        S.scanned(df, ["g"], ["i"], {"x": ("median", F.col("v"))})


def test_one_hot_group_is_spread(spark):
    """Nine tenths of the rows are one group's: no range, and so no task of the scan, has more than its share."""
    df = spark.createDataFrame([(i, 7 if i % 10 else i) for i in range(20_000)], "i long, g long").repartition(8)
    dealt = df.repartitionByRange(8, "g", "i").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 20_000 / 8 * 1.6
    got = S.numbered(df, ["g"], ["i"], "n").where("g = 7").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d")).first()
    assert got["m"] == got["d"] == 18_000


def test_first_seen(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", None), (4, "a", None), (5, "b", "x"), (6, None, "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "i long, g string, f string")
    got = {r["i"] for r in S.first_seen(df, "i", ["g"], F.col("f"), ["i"], "fresh").where("fresh").collect()}
    assert got == {1, 3, 5, 6}


def plain_masks(turns):
    """{(turn, pos): (class, ordinal, payload ordinal)} of a sample's turns, each a list of (piece, keep)."""
    out, n = {}, 0
    for t, pieces in enumerate(turns):
        low = "".join(p or "" for p, _ in pieces).lower()
        kind = next((k for k in ("answer", "query", "evidence") if f"<{k}>" in low), None)
        first = low.find("<query>")
        close = low.find("</query>", first + 7)
        end = len(low) if close < 0 else close + 8
        at = 0
        for pos, (p, keep) in enumerate(pieces):
            size = len(p or "")
            inside = kind == "query" and at + size > first and at < end and size > 0
            out[t, pos] = (kind, n if kind == "query" and keep else -1, n if inside and keep else -1)
            at += size
        n += kind == "query"
    return out


def test_masks(spark):
    rng = random.Random(5)
    bodies = ["so <query>who <query>x</query> y</query>", "<evidence>e</evidence>", "<QUERY>open end", "a<answer>b</answer><query>c</query>", "nothing", "", "</query> <query>z</query>", "<quer y>no", "é <query>梦</query>"]
    rows, want = [], {}
    for s in range(12):
        turns = []
        for t in range(rng.randrange(1, 7)):
            body, pieces = rng.choice(bodies), []
            while body or not pieces:
                k = rng.randrange(0, 6)
                pieces.append((body[:k] or (None if rng.random() < 0.5 else ""), rng.random() < 0.8))
                body = body[k:]
            turns.append(pieces)
            rows += [(s, t, pos, p, keep) for pos, (p, keep) in enumerate(pieces)]
        want |= {(s, *k): v for k, v in plain_masks(turns).items()}
    df = spark.createDataFrame(rows, "sample long, turn long, pos long, piece string, keep boolean").repartition(3)
    at = lambda r: (r["sample"], r["turn"], r["pos"])
    assert {at(r): r["ordinal"] for r in M.query_ordinals(df).collect()} == {k: v[1] for k, v in want.items()}
    assert {at(r): r["ordinal"] for r in M.query_ordinals(df, payload_only=True).collect()} == {k: v[2] for k, v in want.items()}
    kept = {at(r) for r in df.where("keep").collect()}
    for scope in (*M.SCOPES, "all"):
        assert {at(r) for r in M.action_mask(df, scope).where("selected").collect()} == {k for k, v in want.items() if k in kept and (scope == "all" or v[0] == scope)}
    with pytest.raises(ValueError):
        M.action_mask(df, "other")
    frame = df.where("keep").selectExpr("sample", "turn * 100 + pos as place", "true as mask").unionByName(spark.createDataFrame([(0, -1, False)], "sample long, place long, mask boolean"))
    got = {(r["sample"], r["place"]): r["ordinal"] for r in M.onto_frame(M.query_ordinals(df), frame, "ordinal").collect()}
    assert got == {(0, -1): None, **{(s, t * 100 + p): want[s, t, p][1] for s, t, p in kept}}
    with pytest.raises(Exception):
        M.onto_frame(M.query_ordinals(df), frame.where("not mask or place > 0"), "ordinal").collect()


def test_overlaps(spark):
    rng = random.Random(6)
    items = [(rng.randrange(2), a, a + rng.randrange(0, 9)) for a in (rng.randrange(60) for _ in range(200))]
    spans = [(rng.randrange(2), a, a + rng.randrange(0, 30)) for a in (rng.randrange(60) for _ in range(4))]
    got = M.overlapping(spark.createDataFrame(items, "k long, start long, stop long"), spark.createDataFrame(spans, "k long, first long, end long"), ["k"], width=7).collect()
    assert len(got) == len(items)
    for r in got:
        assert r["inside"] == any(k == r["k"] and r["start"] < e and r["stop"] > f and r["stop"] > r["start"] and e > f for k, f, e in spans)


def test_turn_starts(spark):
    one = lambda f, m, t, x: spark.createDataFrame([(f, m, t, x)], "f array<int>, m array<int>, t array<array<int>>, x array<array<int>>").select(M.turn_starts(*map(F.col, "fmtx")).alias("s")).first()["s"]
    frame, mask = [9, 1, 2, 9, 1, 2, 3, 8], [0, 0, 0, 0, 1, 1, 1, 0]
    assert one(frame, mask, [[1, 2]], [[1, 1]]) == [4] and one(frame, mask, [[1, 2]], [[0, 0]]) == [1]
    assert one(frame, mask, [[1, 2], [2, 3]], [[0, 0], [1, 1]]) == [1, 5] and one(frame, mask, [], []) == []
    for bad in ([[[1, 2], [1]], [[1, 1], [1]]], [[[7]], [[1]]], [[[1, 2]], [[1]]], [[[1]], []]):
        with pytest.raises(Exception):
            one(frame, mask, *bad)


def test_lockstep_is_tree_search(spark):
    """Without attribution, and with rules that never end a path, visits and means are those of the search tree by tree."""
    q = spark.createDataFrame([(1, "abcdef"), (2, "x"), (3, "hello")], "id long, text string")
    worth = lambda text: (sum(map(ord, text)) % 7) / 7
    plain = G.tree_search(q, "id", lambda s, k: {"text": s["text"] + str(k)}, lambda s: worth(s["text"]), rollouts=25, width=2, depth=3).collect()
    said = F.concat(F.coalesce(F.try_element_at("thoughts", F.lit(-1)), F.concat(F.lit("<query>"), F.col("text"))), F.size("nodes").cast("string"))
    model = lambda rows: rows.withColumn("response", said)
    total = F.aggregate(F.split(F.expr("substring(response, 8)"), ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c)))
    judge = lambda rows: rows.withColumns({"failure": F.lit("success"), "score": (total % 7) / 7.0})
    got = K.lockstep_search(q, "id", model, judge, rollouts=25, width=2, depth=3).collect()
    key = lambda r: (r["id"], r["node"], r["parent"], r["depth"], r["visits"])
    assert sorted(map(key, got)) == sorted(map(key, plain))
    means = {(r["id"], r["node"]): r["q"] for r in plain}
    assert all(math.isclose(r["q"], means[r["id"], r["node"]], abs_tol=1e-12) for r in got)


def test_lockstep_repairs(spark):
    """A failed step's child is a repair, or a normal step where the model has no repair; a model without any response leaves the tree."""
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    model = lambda rows: rows.withColumn("response", F.when((F.col("method") != "normal") & (F.col("id") == 4), F.lit(None).cast("string")).when(F.col("id") == 3, F.lit("")).otherwise(F.concat(F.lit("<query>"), "method")))
    judge = lambda rows: rows.withColumns({"failure": F.when(F.col("id") == 2, "claim_fail").otherwise("query_fail"), "score": F.lit(0.5)})
    got = {(r["id"], r["node"]): r for r in K.lockstep_search(q, "id", model, judge, rollouts=3, width=1, depth=4).collect()}
    assert [got[1, k]["method"] for k in range(4)] == ["normal", "normal", "query_rewrite", "query_rewrite"] and got[1, 3]["action"] == "document_analysis"
    assert got[2, 2]["method"] == "evidence_reexamine" and got[2, 3]["action"] == "reasoning" and got[4, 2]["method"] == "normal"
    assert got[3, 0]["visits"] == 0 and (3, 1) not in got and got[1, 0]["visits"] == 3 and got[1, 0]["q"] == 0.5


def test_tex(spark):
    def plain(text, command):
        out, pos = [], text.find(command)
        while pos >= 0:
            pos += len(command)
            left, depth, found = text.find("{", pos), 0, None
            for i in range(left, len(text)) if left >= 0 else ():
                depth += (text[i] == "{") - (text[i] == "}")
                if depth == 0:
                    found = text[left + 1 : i]
                    break
            out.append(found)
            pos = text.find(command, pos)
        return out

    def uncommented(text):
        lines = []
        for line in text.split("\n"):
            out, escaped = "", False
            for ch in line:
                if ch == "%" and not escaped:
                    break
                out += ch
                escaped = ch == "\\" and not escaped
            lines.append(out)
        return "\n".join(lines)

    rng = random.Random(7)
    texts = ["".join(rng.choices(["{", "}", "\\cap", "a", "\\", "%", "\n", "é", "\\{"], k=rng.randrange(0, 40))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.arguments(F.col("t"), "\\cap").alias("x"), X.without_comments(F.col("t")).alias("y")).collect()
    for r in got:
        assert r["x"] == plain(r["t"], "\\cap") and r["y"] == uncommented(r["t"])


def test_bootstrap_keys_and_seeds(spark):
    rows = spark.createDataFrame([(str(i), "g" if i % 2 else "h", float(i % 5)) for i in range(60)], "k string, g string, d double")
    one = {(r["group"], r["round"]): r["m"] for r in B.bootstrap_sums(rows, "k", ["d"], "g", rounds=20, pair="a:b").collect()}
    alone = {(r["group"], r["round"]): r["m"] for r in B.bootstrap_sums(rows.where("g = 'g'"), "k", ["d"], "g", rounds=20, pair="a:b").collect()}
    other = {(r["group"], r["round"]): r["m"] for r in B.bootstrap_sums(rows, "k", ["d"], "g", rounds=20, pair="a:c").collect()}
    assert all(one[k] == alone[k] for k in alone) and one != other
    for bad in ("x", None, "1.5"):
        with pytest.raises(Exception):
            B.bootstrap_sums(rows.unionByName(spark.createDataFrame([(bad, "g", 1.0)], rows.schema)), "k", ["d"], rounds=3).collect()


def test_distinct_texts(spark):
    import unicodedata

    from rillstone.functions import text as T

    rng = random.Random(8)
    lists = [[rng.choice(["ﬁ", "FI", "Straße", "STRASSE", " a  b ", "A B", "", " ", "Ⅳ", "iv", "é", "É", "é", None]) for _ in range(rng.randrange(0, 9))] for _ in range(50)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>").select("i", T.distinct_texts(F.col("v")).alias("x")).collect()
    for r in got:
        want = {}
        for t in lists[r["i"]]:
            plain = " ".join(unicodedata.normalize("NFKC", t or "").split())
            if plain:
                want.setdefault(plain.casefold(), plain)
        assert r["x"] == list(want.values())


def test_least_similarity(spark):
    """Against plain difflib over all pairs: ties, empty and equal texts, junk in long ones, and one node with more texts than a tile."""
    from difflib import SequenceMatcher

    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ab c", [5, 3, 2, 1], k=n))
    kids = {1: ["abc", "abd", "xyz"], 2: ["same", "same"], 3: ["", ""], 4: ["", "a"], 5: ["one"], 6: [text(rng.randrange(0, 12)) for _ in range(40)], 7: [text(260) for _ in range(4)], 8: ["ab", "ba", "ab"], 9: [text(9) + "a" for _ in range(60)]}
    rows, at = [], 100
    for parent, texts in kids.items():
        for t in texts:
            rows.append((0, at, parent, t))
            at += 1
    got = {r["node"]: r["similarity"] for r in G.least_similarity(spark.createDataFrame(rows, "tree long, node long, parent long, t string"), "t", tile=16).collect()}
    want = {p: min(SequenceMatcher(None, a, b).ratio() for i, a in enumerate(x) for b in x[i + 1 :]) for p, x in kids.items() if len(x) > 1}
    assert got == want


def test_ways_up(spark):
    rng = random.Random(10)
    parent = {i: (i if i < 3 else rng.randrange(max(0, i - 4), i)) for i in range(300)}
    rows = [(1, i, p, None if i % 5 == 0 else f"v{i}") for i, p in parent.items()]
    got = {r["node"]: r["seen"] for r in G.seen_on_path(spark.createDataFrame(rows, "tree long, node long, parent long, v string"), F.col("v"), "seen").collect()}
    for i in parent:
        way, at = [], i
        while parent[at] != at:
            at = parent[at]
            way.append(at)
        assert got[i] == [f"v{k}" for k in reversed(way) if k % 5]


@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_vector_search_in_cells(spark, spread):
    """Many queries: the rows of all products; clustered vectors spare most pairs, and ties and zero vectors stay right."""
    import numpy as np

    from rillstone.operators import relational as R
    from rillstone.operators import vectors as V

    rng = np.random.default_rng(11)
    middles = rng.standard_normal((16, 12)) * spread
    x = middles[np.arange(2000) % 16] + rng.standard_normal((2000, 12))
    x[5] = x[21]
    x[7] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    scores = np.round(u[::20] @ u.T, 9)
    want = {int(q): np.lexsort((np.arange(2000), -s))[:5].tolist() for q, s in zip(range(0, 2000, 20), scores, strict=True)}
    for size in (16 << 20, 2000):
        got = {}
        for r in sorted(R.vector_topk(df.where("vec_id % 20 = 0"), df, 5, block_bytes=size).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want
    plain = df.select(F.col("vec_id").alias("id"), R.unit(F.col("embedding")).alias("v"))
    _, spared = V.bounded_topk(plain.where("id % 20 = 0 and id <> 0"), plain.where("id <> 7"), 12, 5, pivots=64)
    assert (spared > 0.3) == (spread > 0)


def test_dealt_parts_keep_their_size(spark):
    """Parts grow in number, not in size, and a key's rows stay together."""
    from rillstone.operators.scans import dealt

    rows = spark.range(4000).select((F.col("id") % 1000).alias("k"), "id")
    few, many = dealt(rows, "k", each=10_000), dealt(rows, "k", each=100)
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 40
    got = many.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.collect_set("k").alias("k")).collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["n"] for r in got) < 300 and sum(len(r["k"]) for r in got) == 1000


def test_item_selectors_deals_lines_once_into_bounded_parts(spark):
    """The report groups and joins where the lines were dealt: no further shuffle by item whose parts would grow with the table."""
    from rillstone.plans import asked

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    plan = asked.item_selectors(read)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [x for x in plan if "Exchange hashpartitioning(item" in x]
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)


def test_best_of_many_queries_takes_bounded_memory():
    """Products are held a square at a time (before: 1,024 for each query, several times over)."""
    import tracemalloc

    import numpy as np

    from rillstone.operators.vectors import best_of

    rng = np.random.default_rng(3)
    m, v = rng.integers(-9, 9, (20_000, 4)).astype(float), rng.integers(-9, 9, (2_000, 4)).astype(float)
    tracemalloc.start()
    _, found, score = best_of(np.arange(len(m)), m, np.arange(len(v)), v, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    for i in range(0, len(m), 1999):
        want = sorted((-float(m[i] @ x), j) for j, x in enumerate(v))[:3]
        assert list(zip((-score[3 * i : 3 * i + 3]).tolist(), found[3 * i : 3 * i + 3].tolist(), strict=True)) == want
