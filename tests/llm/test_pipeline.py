"""Each stage of the corpus pipeline against brute force on one small corpus, its odd rows, and the whole run."""

import random
import re

import pytest

pytest.importorskip("rillstone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = say(20)
    rows = []
    for i in range(200):
        toxic = i % 5 == 0
        rows.append((i, say(30) + (" vile scum" if toxic else "") + "\n" + say(12), int(toxic)))
    copied = say(60) + "\n" + say(40)
    extra = [(300, copied, 0), (301, copied, 0), (302, copied.replace(copied.split()[3], "changed"), 0), (310, f"{say(20)} {item} {say(20)}", 0), (311, f"{say(600)} {item}", 0), (320, None, 0), (321, "", 0), (322, "one", 0)]
    return rows + extra, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, item = corpus()
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t, _ in rows] + [(None, "no id here", "en", "s", 10), (322, "one", "en", "s", 3)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {i: (t, x) for i, t, x in corpus()[0]}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and set(ids(clean)) == {i for i, (_, x) in rows.items() if not x} | {None}
    lined = stages["line_dedup"](spark, docs, folder)
    kept = {r["doc_id"]: r for r in lined.collect()}
    assert lined.schema.names == docs.schema.names and 301 not in kept and 302 not in kept and kept[300]["text"] == rows[300][0] and kept[320]["text"] is None and kept[321]["text"] == ""
    assert all(kept[i]["text"] == rows[i][0] and kept[i]["n_chars"] == len(rows[i][0]) for i in range(200))
    single = stages["jaccard"](spark, docs, folder)
    left = set(ids(single))
    assert 300 in left and not {301, 302} & left and set(range(200)) <= left and {320, 321, 322, None} <= left and len(ids(single)) == docs.count() - 2
    apart = set(ids(stages["decontaminate"](spark, docs, folder)))
    assert 310 not in apart and 311 in apart and set(range(200)) <= apart and {320, 321, 322, None} <= apart
    coded = stages["pieces"](spark, docs, folder)
    assert coded.count() == docs.count() and {r["doc_id"]: r["n_pieces"] for r in coded.collect()}[320] == 0 and coded.where("not round_trip").count() == 0


def test_clashing_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    for extra in ("score", "predicted", "drops", "n_lines", "spans", "contaminated", "component_id", "_score", "held_out"):
        docs = docs.selectExpr("*", f"0.25d as {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r["score"] == r["spans"] == r["_score"] == r["n_lines"] == 0.25 for r in out.collect()), name


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    rows = {i: (t, x) for i, t, x in corpus()[0]}
    assert set(out) == {i for i, (_, x) in rows.items() if not x} - {301, 302, 310} | {None}
    assert all(r["round_trip"] for r in out.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0, name
    assert re.match("corpus", corpus_pipeline.__name__)


def test_lean_functions_make_room_and_give_the_same():
    from rillstone.llm import textkit

    def double(batches):
        for b in batches:
            yield 2 * b

    def total(group):
        return sum(group)

    assert textkit.released(double) is double
    cleared = []
    textkit.KEPT |= {"other": lambda: cleared.append("other"), __name__: lambda: cleared.append("own")}
    try:
        with textkit.lean():
            many, one = textkit.released(double), textkit.released(total)
        assert list(many([1, 2])) == [2, 4] and one([1, 2]) == 3 and "other" in cleared and "own" not in cleared
    finally:
        del textkit.KEPT["other"], textkit.KEPT[__name__]
    assert textkit.released(total) is total


def test_encoding_leaves_no_model_in_its_workers(spark):
    import pyarrow as pa

    from rillstone.llm import pieces
    from rillstone.llm.queries import tokenizer

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pieces.load.cache_info().currsize] * b.num_rows, pa.int64())], ["n"])

    path = tokenizer("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    left = lambda keep: {r["n"] for _ in [pieces.encode_pieces(docs, path, keep_model=keep).collect()] for r in spark.range(40).repartition(4).mapInArrow(held, "n long").collect()}
    assert left(True) & {1}
    for _ in range(8):  # workers come in turn: each that holds a model gets a task
        found = left(False)
    assert found == {0}


def test_lean_functions_keep_no_tables_of_powers():
    """They would stay at the size of the longest block in every worker, waiting ones too."""
    import numpy as np

    from rillstone.llm import textkit

    def hashed(batches):
        for b in batches:
            yield textkit.span_hash(b, np.array([0]), np.array([len(b)])).tolist()

    data = np.full(3 << 20, 97, np.uint8)
    with textkit.lean():
        run = textkit.released(hashed)
    assert list(run([data])) == list(hashed([data]))
    list(run([data, data[:5]]))
    assert not textkit._POW


def test_lines_of_one_template_go_in_the_pipeline(spark):
    """The line stage loses no link: of lines with words of their own at eight places one is left."""
    line = lambda k: " ".join(f"own{k}x{m}" if m % 5 == 2 and m < 40 else f"w{m}" for m in range(60))
    docs = spark.createDataFrame([(k, f"text {k} number {k * k} of its kind {k + 7}\n" + line(k), "en", "s", 1) for k in range(60)], SCHEMA).repartition(3)
    kept = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert len(kept) == 60 and [k for k, t in kept.items() if "\n" in t] == [0]


def test_no_text_is_shuffled_to_drop_copies(spark, folder):
    """Documents that go are told where they lie, whatever the size of the tables."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for stage in ("line_dedup", "jaccard"):
            plan = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
