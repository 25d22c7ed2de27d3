"""Limits, token streams and sinks: by brute force, over several micro-batches, with restarts and deaths between them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone.sources import published as P
from rillstone.streaming import events as E
from rillstone.streaming import limits as L
from rillstone.streaming import machines as A
from rillstone.streaming import runs as R


def plain_waits(requests, most, seconds, cooldown, tracked):
    """The rule on lists: every interval all clients are cleaned; no shortcut."""
    interval, cleaned, held, out = min(60.0, seconds), -math.inf, {}, []
    for client, now in requests:
        if now - cleaned >= interval:
            held = {c: [t for t in times if t > now - seconds] for c, times in held.items()}
            held = {c: times for c, times in held.items() if times}
            cleaned = now
        times = held.get(client, [])
        if not times and len(held) >= tracked:
            wait = interval
        elif times and cooldown > 0 and now - times[-1] < cooldown:
            wait = cooldown - (now - times[-1])
        elif len(times) >= most:
            wait = max(1.0, times[0] + seconds - now)
        else:
            wait = 0.0
            held[client] = [*times, now]
        out.append(wait)
    return out


OPTIONS = [(2, 10.0, 0.0, 3), (3, 200.0, 5.0, 4), (1, 70.0, 0.0, 2), (5, 30.0, 2.0, 100)]


@pytest.mark.parametrize("options", OPTIONS)
def test_rule(options):
    rng = random.Random(1)
    now, requests = 0.0, []
    for _ in range(4000):
        now += rng.choice([0.0, 0.5, 1.0, 7.0, 40.0])
        requests.append((rng.randrange(8), now))
    rule = L.Limiter(*options)
    got = [rule.wait(c, t) for c, t in requests]
    assert got == plain_waits(requests, *options) and len(rule.clients) <= options[3]
    assert {w > 0 for w in got} == {True, False}


def requests_table(spark, n=600):
    rng = random.Random(2)
    now, rows = 1_700_000_000.0, []
    for i in range(n):
        now += rng.choice([0.0, 0.5, 1.0, 7.0, 40.0])
        rows.append((i, 7 if rng.random() < 0.6 else rng.randrange(8), now))
    return rows, spark.createDataFrame([*rows, (n, None, now), (n + 1, 3, None)], "event_id long, user_id long, at double").withColumn("ts", F.timestamp_seconds("at")).repartition(3)


@pytest.mark.parametrize("options", OPTIONS[1:3])
def test_stream_batch_and_brute_force(spark, tmp_path, options):
    """Four micro-batches with a restart before each give what one pass gives; one client has most of the rows."""
    rows, df = requests_table(spark)
    most, seconds, cooldown, tracked = options
    rule = {"most": most, "seconds": seconds, "cooldown": cooldown, "tracked": tracked, "bucket": F.pmod(F.col("user_id"), F.lit(2))}
    want = {}
    for b in (0, 1):
        mine = [(i, c, t) for i, c, t in rows if c % 2 == b]
        want |= dict(zip([i for i, *_ in mine], plain_waits([(c, t) for _, c, t in mine], *options), strict=True))
    close = lambda found: {r["event_id"]: r["retry_after"] for r in found.collect()} == pytest.approx(want, abs=1e-5)
    assert close(L.limits(df, **rule))
    slices = [F.coalesce(F.floor(F.col("event_id") / 151), F.lit(0)) == i for i in range(4)]
    assert close(R.in_slices(df, slices, lambda s: L.limited(s, **rule), str(tmp_path)))


def test_window_load(spark):
    rows, df = requests_table(spark, 300)
    got = {r["event_id"]: r["n"] for r in L.window_load(df.where("at is not null and user_id is not null"), 30).collect()}
    assert got == {i: sum(c == d and t - 30 <= u <= t for _, d, u in rows) for i, c, t in rows}


TEXTS = ["so <answer>Paris is </b big</answer> more", "<query>who</query><answer>x", "nothing", "<answer></answer>", "<answer>open end </ans", "<answer> a < b </answer", "", "<answ", "x<answer>é梦</answer><query>q</query>", "<query> </query>"]


def plain_events(pieces):
    """Events from all prefixes of a text, each looked at anew."""
    out, shown, raw, mode = [], "", "", None
    for piece in pieces:
        raw += piece
        if mode is None and ("<answer>" in raw or "<query>" in raw):
            mode = "answer" if "<query>" not in raw or -1 < raw.find("<answer>") < raw.find("<query>") else "query"
            if mode == "answer":
                out.append(("answer_start", None))
        if mode == "answer":
            content = raw[raw.find("<answer>") + 8 :]
            if "</answer>" in content:
                visible = content[: content.find("</answer>")]
            else:
                visible = content
                for k in range(8, 0, -1):
                    if content.endswith("</answer>"[:k]):
                        visible = content[:-k]
                        break
            if len(visible) > len(shown):
                out.append(("answer_delta", visible[len(shown) :]))
                shown = visible
    part = lambda tag: raw.partition(f"<{tag}>")[2].partition(f"</{tag}>")[0].strip() if f"</{tag}>" in raw.partition(f"<{tag}>")[2] else ""
    if mode == "answer":
        answer = part("answer") or shown.strip()
        out.append(("done", answer) if answer else ("error", "empty_answer"))
    else:
        out.append(("query", part("query")) if part("query") else ("error", "invalid_agent_action"))
    return out


def test_token_events_late_and_repeated(spark, tmp_path):
    rng = random.Random(3)
    want, rows = {}, []
    for i, text in enumerate(TEXTS * 3):
        size = i % 5 + 1
        pieces = [text[k : k + size] for k in range(0, len(text), size)] or [""]
        want[str(i)] = plain_events(pieces)
        for seq, p in enumerate(pieces):
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((str(i), seq, p, seq == len(pieces) - 1, rng.randrange(4)))
    df = spark.createDataFrame(rows, "stream string, seq long, piece string, last boolean, slice int").repartition(3)

    def told(found):
        out = {}
        for r in sorted(found.collect(), key=lambda r: (r["stream"], r["n"])):
            assert r["n"] == len(out.setdefault(r["stream"], []))
            out[r["stream"]].append((r["kind"], r["text"]))
        return out

    assert told(E.events_of(df)) == want
    assert told(R.in_slices(df, [F.col("slice") == k for k in range(4)], lambda s: E.streamed_events(s.drop("slice")), str(tmp_path))) == want


def test_token_events_take_their_state_with_the_rows(spark, tmp_path):
    """No call to a state server for each stream: any store will do, and the session's is left as it is."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    unset = spark.conf.get(name, None)
    rows = [(str(i), seq, piece, seq == 1, 1 - seq) for i in range(50) for seq, piece in enumerate(["<answer>a", f"{i}</answer>"])]
    df = spark.createDataFrame(rows, "stream string, seq long, piece string, last boolean, slice int")
    try:
        found = R.in_slices(df, [F.col("slice") == k for k in range(2)], lambda s: E.streamed_events(s.drop("slice")), str(tmp_path))
        assert {r["stream"]: r["text"] for r in found.where("kind = 'done'").collect()} == {str(i): f"a{i}" for i in range(50)}
        assert spark.conf.get(name, None) == unset
    finally:
        if before is not None:
            spark.conf.set(name, before)


class Death(Exception):
    pass


@pytest.mark.parametrize("at", ["written", "committed"])
def test_each_row_once(spark, tmp_path, at):
    """A run that dies after the write or after the commit, then goes on from its checkpoint."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def die(batch, step):
        if step == at:
            raise Death(step)

    spark.range(10).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    with pytest.raises(Exception):
        R.run_out(stream(), out, check, die)
    assert R.committed(spark, out, "id long").count() == (0 if at == "written" else 10)
    spark.range(10, 25).write.mode("append").parquet(source)
    R.run_out(stream(), out, check)
    R.run_out(stream(), out, check)
    assert sorted(r["id"] for r in R.committed(spark, out, "id long").collect()) == list(range(25))


def test_publication_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        P.published(spark, path)
    P.publish_version(spark.range(3), path)
    reader = P.published(spark, path)
    for step in ("written", "drafted"):

        def die(now, step=step):
            if now == step:
                raise Death(now)

        with pytest.raises(Death):
            P.publish_version(spark.range(7), path, fail=die)
        assert P.published(spark, path).count() == 3
    with pytest.raises(ValueError):
        P.publish_version(spark.range(2), path, least=3)
    P.publish_version(spark.range(7), path)
    assert P.published(spark, path).count() == 7 and reader.count() == 3
    assert P.swept(spark, path, keep=0) == 4 and P.published(spark, path).count() == 7
    with pytest.raises(Exception):
        P.make_once(spark, f"{path}/_current", "x")


def asking(always):
    return lambda history, question: F.when(F.lit(always) | (F.col("id") % 2 == 0), F.concat(F.lit("<query>q"), F.size(history).cast("string"))).otherwise("<answer>a</answer>")


def test_budget_is_kept(spark):
    q = spark.createDataFrame([(i, "who") for i in range(4)], "id long, question string")
    corpus = spark.createDataFrame([("q0", 1, ("t", "x"))], "query string, rank int, doc struct<title:string,text:string>")
    run = lambda **o: A.cohort(q, "id", asking(True), A.lookup(corpus), A.first_line, **o).collect()
    with pytest.raises(ValueError):
        run(max_turns=8, max_searches=5)
    for force, valid in (("<query>again</query>", False), ("So it is <answer>b", True), ("<answer> </answer>", False)):
        for r in run(max_turns=8, **A.scheduler("budgeted", lambda h, x, force=force: F.lit(force), 5)):
            b = r["behavior"]
            assert b["logical_search_count"] == b["actual_retrieval_rpc_count"] == 5 and b["num_turns"] == r["turns"] == 6
            assert r["forced"] and b["forced_answer_valid"] == valid and b["force_reason"] == "search_budget"
            assert (r["answer"], r["error"]) == (("b", None) if valid else (None, "forced_answer_format_failure"))
            assert b["finish_reason"] == ("forced_answer_after_search_budget" if valid else "forced_answer_format_failure")
            assert [h["evidence"] for h in r["history"]][:2] == ["x", "None"]
    none = A.cohort(q, "id", asking(False), A.lookup(corpus), A.first_line, **A.scheduler("budgeted", lambda h, x: F.lit("<answer>c</answer>"), 0)).collect()
    assert all(r["answer"] == "c" and r["history"] == [] for r in none)
    with pytest.raises(ValueError):
        A.scheduler("other")


def test_items_one_by_one(spark):
    def one(row):
        if row["id"] == 2:
            raise ValueError("no answer")
        return {"answer": row["q"] * row["id"], "turns": row["id"]}

    rows = spark.createDataFrame([(i, "x") for i in range(4)], "id int, q string").coalesce(1)
    got = A.per_item(rows, "id", one, "answer string, turns int", threads=3).collect()
    assert [tuple(r) for r in got] == [(0, "", 0, None), (1, "x", 1, None), (2, None, None, "ValueError: no answer"), (3, "xxx", 3, None)]


def test_retrievers(spark):
    corpus = spark.createDataFrame([(1, "Paris", "city of light"), (2, "Rome", "eternal city"), (3, "Oslo", "north")], "doc_id long, title string, text string")
    rows = spark.createDataFrame([(1, "what of Paris city"), (2, "Rome"), (3, "nothing here"), (4, "Rome")], "id long, query string")
    titles = lambda found: {r["id"]: [d["title"] for d in r["docs"]] for r in found.collect()}
    assert titles(A.lexical_retriever(corpus, 2)(rows)) == {1: ["Paris", "Rome"], 2: ["Rome"], 3: [], 4: ["Rome"]}
    has = lambda w: F.lower("text").contains(w).cast("double")
    encode = lambda texts, query: texts.withColumn("vector", F.array(has("paris"), has("rome"), has("oslo") + F.lit(0.01)))
    got = titles(A.dense_retriever(corpus, encode, 1)(rows))
    assert got[1] == ["Paris"] and got[2] == got[4] == ["Rome"] and got[3] == ["Oslo"]
    asked = A.cohort(rows.selectExpr("id", "query as question"), "id", lambda h, q: F.when(F.size(h) == 0, F.concat(F.lit("<query>"), q)).otherwise(F.concat(F.lit("<answer>"), F.element_at(h, -1)["evidence"])), A.lexical_retriever(corpus, 1), A.first_line).collect()
    assert {r["id"]: r["answer"] for r in asked} == {1: "city of light", 2: "eternal city", 3: "None", 4: "eternal city"}


def test_kept_tables_are_swept(spark):
    from rillstone.sources import store

    store.swept(spark)
    rows = store.kept(spark.range(5))
    assert rows.count() == 5 and store.swept(spark) == 1
    with pytest.raises(Exception):
        rows.count()
    assert store.small(spark.range(10), 640).join(spark.range(3), "id").count() == 3 and store.small(spark.range(100), 640).count() == 100
