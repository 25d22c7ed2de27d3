"""Question-answering state machines in lockstep, incremental answer events, and cached responses.

Generators, retrievers and evidence readers are functions of columns or DataFrames, so a model's batch function, a
served index or a fixed rule can stand in each place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.sources.store import kept

HISTORY = "array<struct<query:string,evidence:string,searched:boolean,duplicate:boolean,failed:boolean>>"

#: (history, question) -> the model's text.
Generator = Callable[[Column, Column], Column]
#: (rows with `query`) -> the rows with `docs`, array<struct<title, text>>; null where the search failed.
Retriever = Callable[[DataFrame], DataFrame]
#: (query, docs) -> evidence text.
Reader = Callable[[Column, Column], Column]


def lookup(corpus: DataFrame, top: int = 5) -> Retriever:
    """A retriever over (query, rank, doc) rows: of an equal query the `top` documents of least rank, in that order."""
    best = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    few = corpus.withColumn("_n", best).where(F.col("_n") <= top).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "doc"))).alias("docs"))
    docs = few.withColumn("docs", F.transform("docs", lambda d: d["doc"]))

    def search(rows: DataFrame) -> DataFrame:
        none = F.array().cast(docs.schema["docs"].dataType)
        return rows.join(docs, "query", "left").withColumn("docs", F.coalesce("docs", none))

    return search


def first_line(query: Column, docs: Column) -> Column:
    return F.coalesce(F.get(docs, F.lit(0))["text"], F.lit("None"))


def words_in(text: Column) -> Column:
    """How many words a text has: stands for a model's token count."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def cohort(questions: DataFrame, key: str, reason: Generator, retrieve: Retriever, read: Reader, *, max_turns: int = 6, intercept: bool = False, max_searches: int | None = None, force: Generator | None = None, count: Callable[[Column], Column] = words_in) -> DataFrame:
    """`questions` (key, question) with history, answer, error, forced, turns and behavior.

    Each turn every open question reasons; an answer ends it, a query is searched and read into its history,
    anything else is the error no_query_or_answer. With `intercept`, a query whose normal form stands in the
    history is noted but not searched. Open ones end as max_turns_exceeded after `max_turns`.

    With `max_searches` there is a budget of queries (intercepted ones count) in place of `max_turns`, and `force` is needed: a question
    that has spent it neither reasons nor searches again but gets one text by `force`, and so does one whose
    reasoning has neither query nor answer. A forced text without an answer is the error forced_answer_format_failure, whatever else it asks for.

    A turn is one pass over the open questions; its result is written to the shared folder, so turns don't pile up
    lineage and a lost executor repeats one turn at most. `behavior` has what each question took: turns, logical and actual
    searches, repeats, failed searches, words by `count`, whether, why and with what success it was forced, and how it ended.
    """
    if (max_searches is None) != (force is None):
        raise ValueError("a budget of searches and a forced answer go together")
    if max_searches is not None and max_searches < 0:
        raise ValueError(f"max_searches must be at least 0, not {max_searches}")
    budget = max_searches is not None
    text, number = F.lit(None).cast("string"), F.lit(0).cast("long")
    state = questions.withColumns({"history": F.array().cast(HISTORY), "answer": text, "error": text, "forced": F.lit(False), "open": F.lit(True), "turns": F.lit(0), "reason": text, "finish": text, "reasoner": number, "forcing": number})
    names = state.columns
    done: list[DataFrame] = []
    closed = lambda out: T.close_tag(T.close_tag(out, "query"), "answer")
    for turn in range(max_searches + 1 if budget else max_turns):
        h, q = F.col("history"), F.col("question")
        spent = F.size("history") >= max_searches if budget else F.lit(False)
        said = state.withColumn("_out", closed(F.when(~spent, reason(h, q))))
        said = said.withColumns({"_answer": T.last_tag(F.col("_out"), "answer"), "query": F.when(~spent, T.first_tag(F.col("_out"), "query"))})
        odd = ~spent & F.col("_answer").isNull() & F.col("query").isNull()
        said = said.withColumn("forced", (spent | odd) if budget else F.lit(False))
        end = {
            "turns": F.lit(turn + 1) + F.when(odd & F.col("forced"), 1).otherwise(0), "reasoner": F.col("reasoner") + count(F.col("_out")),
            "answer": F.col("_answer"), "error": F.when(odd, "no_query_or_answer"), "finish": F.when(F.col("_answer").isNotNull(), "model_answer").when(odd, "no_query_or_answer"),
            "open": F.col("_answer").isNull() & F.col("query").isNotNull(),
        }
        if budget:
            said = said.withColumn("_last", F.when(F.col("forced"), T.close_tag(force(h, q), "answer")))
            said = said.withColumn("_given", F.nullif(T.first_tag(F.col("_last"), "answer"), F.lit("")))
            failed = F.col("forced") & F.col("_given").isNull()
            why = F.when(F.col("forced"), F.when(spent, "search_budget").otherwise("invalid_reasoner_format"))
            after = F.when(failed, "forced_answer_format_failure").when(spent, "forced_answer_after_search_budget").otherwise("forced_answer_after_format_failure")
            end |= {
                "answer": F.when(F.col("forced"), F.col("_given")).otherwise(F.col("_answer")), "error": F.when(failed, "forced_answer_format_failure"), "reason": why, "finish": F.when(F.col("forced"), after).otherwise(end["finish"]),
                "forcing": count(F.col("_last")).cast("long"), "open": ~F.col("forced") & end["open"],
            }
        said = kept(said.withColumns(end), "turn")
        done.append(said.where("not open").select(*names))
        asked = said.where("open")
        if asked.isEmpty():
            state = asked.select(*names)
            break
        form = T.query_form(F.col("query"))
        again = (form != "") & F.exists("history", lambda h: T.query_form(h["query"]) == form)
        asked = asked.withColumn("_again", again)
        aside = intercept or budget
        rows = retrieve(asked.where("not _again") if aside else asked).withColumn("_searched", F.lit(True))
        if aside:
            rows = rows.unionByName(asked.where("_again").withColumn("_searched", F.lit(False)), allowMissingColumns=True)
        evidence = F.when(F.col("_searched"), read(F.col("query"), F.col("docs"))).otherwise("None")
        step = F.array(F.struct(F.col("query").alias("query"), evidence.alias("evidence"), F.col("_searched").alias("searched"), F.col("_again").alias("duplicate"), (F.col("_searched") & F.col("docs").isNull()).alias("failed")))
        state = kept(rows.withColumn("history", F.concat("history", step.cast(HISTORY))).select(*names), "state")
    out = state.withColumns({"error": F.lit("max_turns_exceeded"), "finish": F.lit("max_turns_exceeded"), "open": F.lit(False)})
    for d in done:
        out = out.unionByName(d)
    many = lambda which: F.size(F.filter("history", which)).cast("long")
    logical, searched, repeats = F.size("history").cast("long"), many(lambda h: h["searched"]), many(lambda h: h["duplicate"])
    evidence = F.aggregate("history", F.lit(0).cast("long"), lambda n, h: n + count(h["evidence"]))
    behavior = F.struct(
        F.col("turns").cast("long").alias("num_turns"), logical.alias("logical_search_count"), searched.alias("actual_retrieval_rpc_count"), searched.alias("actual_search_count"), logical.alias("num_queries"), repeats.alias("exact_duplicate_count"), repeats.alias("repeat_count_from_text"),
        many(lambda h: h["failed"]).alias("retrieval_error_count"), F.col("reasoner").alias("reasoner_token_count"), evidence.alias("evidence_token_count"), F.col("forcing").alias("forced_answer_token_count"),
        F.col("forced").alias("forced_answer"), (F.col("forced") & F.col("answer").isNotNull()).alias("forced_answer_valid"), F.col("reason").alias("force_reason"), F.col("finish").alias("finish_reason"),
    )
    return out.withColumn("behavior", behavior).drop("open", "reason", "finish", "reasoner", "forcing")


def answer_events(pieces: Column, tag: str = "answer") -> Column:
    """struct(deltas, done): what of the answer each piece of a streamed text lets show, in order.

    Nothing shows before the opening tag; the beginning of a closing tag at the end of what has come is held back
    until the next piece decides. A text's pieces lie one after another in their Arrow array, so both tags are looked for once
    in the whole text and each piece costs its own length only. At a null piece the text breaks off, and done is null.
    """
    opening, closing = f"<{tag}>".encode(), f"</{tag}>".encode()

    def cut(data: bytes, ends: np.ndarray) -> tuple[list[bytes], bool]:
        """The deltas of a text whose pieces end at `ends`, and whether a closing tag is in it."""
        done = closing in data
        start = data.find(opening)
        if start < 0:
            return [], done
        start += len(opening)
        stop = data.find(closing, start)
        whole = len(data) + 1 if stop < 0 else stop + len(closing)
        ends = ends[ends >= start]
        shown = ends.copy()
        raw = np.frombuffer(data, np.uint8)
        # From the shortest on, so that the longest ending that begins the closing tag counts.
        for size in range(1, len(closing)):
            some = np.flatnonzero(ends - start >= size)
            for i in range(size):
                some = some[raw[ends[some] - size + i] == closing[i]]
                if not len(some):
                    break
            shown[some] = ends[some] - size
        shown = np.unique(np.maximum.accumulate(np.where(ends >= whole, stop, shown)))
        edges = [start, *shown[shown > start].tolist()]
        return [data[i:j] for i, j in zip(edges, edges[1:], strict=False)], done

    @F.arrow_udf("struct<deltas:array<string>,done:boolean>")
    def events(texts: pa.Array) -> pa.Array:
        deltas, done, size = [], [], [0]
        missing = texts.is_null().to_numpy(zero_copy_only=False)
        for i, gone in enumerate(missing.tolist()):
            found, closed = [], None
            if not gone:
                own = texts[i].values.cast(pa.binary()).to_pylist()
                broken = None in own
                own = own[: own.index(None)] if broken else own
                found, closed = cut(b"".join(own), np.cumsum([len(x) for x in own], dtype=np.int64))
                closed = None if broken else closed
            deltas += found
            size.append(len(deltas))
            done.append(closed)
        lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(deltas, pa.binary()).cast(pa.string()))
        return pa.StructArray.from_arrays([lists, pa.array(done, pa.bool_())], ["deltas", "done"], mask=pa.array(missing))

    return events(pieces)


def cached(rows: DataFrame, prompt: str, answer: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, int]:
    """`rows` with `response` from the cache at `path`, after the prompts it lacks are answered, once each, and added; how many those were."""
    from rillstone.sources.formats import exists

    spark = rows.sparkSession
    wanted = rows.select(F.sha2(F.col(prompt).cast("binary"), 256).alias("_key"), F.col(prompt).alias(prompt)).distinct()
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select("_key"), "_key", "left_anti")
    new = kept(answer(wanted).select("_key", "response"), "answers")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    held = spark.read.schema("_key string, response string").parquet(path)
    return rows.withColumn("_key", F.sha2(F.col(prompt).cast("binary"), 256)).join(held, "_key", "left").drop("_key"), n


def scheduler(name: str, force: Generator | None = None, max_searches: int = 5) -> dict:
    """Options of the cohort by name: plain search, queries that repeat noted but not searched, or a search budget with an answer by `force`."""
    known = {"plain": {}, "intercepting": {"intercept": True}, "budgeted": {"max_searches": max_searches, "force": force}}
    if name not in known:
        raise ValueError(f"unknown scheduler {name!r}; there are {', '.join(known)}")
    return known[name]


def routed(rows: DataFrame, key: str, reason: Generator, analyse: Callable[[Column, Column, Column], Column], answer: Generator, retrieve: Retriever, *, max_iter: int = 4) -> DataFrame:
    """(key, question) to (key, answer, n_thoughts, actions): the older loop, whose every thought goes into one history.

    A thought that asks is searched, or the query that the thoughts imply if it has none; then comes document
    analysis, reasoning after an analysis, and in the last round answer generation. A thought with an answer ends it.
    `reason` and `answer` are functions of (thoughts array<string>, question), `analyse` of the documents found, too.
    """
    state = rows.withColumns({"thoughts": F.array().cast("array<string>"), "actions": F.array().cast("array<string>"), "answer": F.lit(None).cast("string")})
    names = state.columns
    done = None
    for step in range(max_iter + 1):
        last = F.try_element_at("actions", F.lit(-1))
        kind = F.when(F.size("actions") == 0, "begin_reasoning").when(F.lit(step == max_iter), "answer_generation").when(last == "document_analysis", "reasoning").otherwise("document_analysis")
        state = state.withColumn("_kind", kind)
        if step:
            said = F.coalesce(T.last_tag(F.try_element_at("thoughts", F.lit(-1)), "query"), F.lit(""))
            asked = state.withColumn("query", F.when(said != "", said).otherwise(T.inferred_subquery(F.array_join("thoughts", " "), F.col("question"))))
            state = retrieve(asked).select(*names, "_kind", "docs")
        q, t = F.col("question"), F.col("thoughts")
        out = F.when(F.col("_kind") == "answer_generation", answer(t, q))
        if step:
            out = out.when(F.col("_kind") == "document_analysis", analyse(t, q, F.col("docs")))
        out = out.otherwise(reason(t, q))
        state = state.withColumn("_out", out).withColumns({"thoughts": F.concat("thoughts", F.array("_out")), "actions": F.concat("actions", F.array("_kind")), "answer": T.last_tag(F.col("_out"), "answer")})
        state = kept(state.select(*names), "routed")
        ended = state.where("answer is not null")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("answer is null")
    return done.unionByName(state).select(key, "answer", F.size("thoughts").alias("n_thoughts"), F.array_join("actions", ">").alias("actions"))


def delay(attempt: int, base: float = 1.0, cap: float = 30.0, share: float = 0.5) -> float:
    """Seconds to wait before a further attempt: doubled each time up to `cap`, and a share (0 to 1) of its upper half."""
    return min(base * 2**attempt, cap) * (0.5 + 0.5 * share)


RETRYABLE = ("timeout", "timed out", "rate limit", "429", "500", "502", "503", "504", "connection", "overloaded")


def retryable(error: Exception) -> bool:
    return any(k in str(error).lower() for k in RETRYABLE)


def generated(rows: DataFrame, prompt: str, call: Callable[[list[str]], list[str]], *, attempts: int = 3, on_failure: str = "raise", base: float = 0.0) -> DataFrame:
    """`rows` with `response` and `attempts`: a batch function over prompts, in order, tried again where its error may pass.

    A batch that fails for good fails the job, or with on_failure "skip" leaves nulls.
    """
    import pandas as pd

    names = rows.columns

    def run(frames):
        import random
        import time

        for frame in frames:
            texts, tries = None, 0
            while texts is None and tries < attempts:
                tries += 1
                try:
                    texts = list(call(frame[prompt].tolist()))
                    if len(texts) != len(frame):
                        raise ValueError("as many responses as prompts are wanted")
                except Exception as e:
                    texts = None
                    if tries == attempts or not retryable(e):
                        if on_failure == "raise":
                            raise
                        break
                    time.sleep(delay(tries, base, share=random.random()))
            out = frame[names].copy()
            out["response"] = pd.Series(texts if texts is not None else [None] * len(frame), index=frame.index, dtype=object)
            out["attempts"] = tries
            yield out

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", response string, attempts int")


def encoder_text(text: Column, query: bool, prefix: str = "Represent this sentence for searching relevant passages: ") -> Column:
    """What an encoder reads: queries have the prefix, documents don't."""
    return F.concat(F.lit(prefix), text) if query else text


def per_item(rows: DataFrame, key: str, one: Callable[[dict], dict], schema: str, *, threads: int = 8) -> DataFrame:
    """(key, columns of `schema`, failure) of a machine that runs one item from beginning to end, `threads` items of a batch at a time.

    For machines whose steps wait for a service: `one` takes a row and returns its columns. An item that fails has nulls and its error,
    and no other item with it; results keep the batch's order.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    out = StructType([rows.schema[key], *wanted.fields]).add("failure", "string")
    names = [f.name for f in wanted.fields]
    arrow = to_arrow_schema(out)

    def run(batches):
        def tried(row: dict) -> dict:
            try:
                found = one(row)
                return {key: row[key], **{n: found.get(n) for n in names}, "failure": None}
            except Exception as e:
                return {key: row[key], **dict.fromkeys(names), "failure": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                yield pa.RecordBatch.from_pylist(list(pool.map(tried, b.to_pylist())), schema=arrow)

    return rows.mapInArrow(run, out)


def lexical_retriever(corpus: DataFrame, top: int = 3) -> Retriever:
    """A retriever over (doc_id, title, text): exact search by shared words, those of titles counting three times."""
    from rillstone.operators.relational import lexical_topk

    words = lambda c: F.array_distinct(T.tokens(T.ascii_words(c)))
    tokens = corpus.select("doc_id", words(F.col("title")).alias("title"), words(F.col("text")).alias("text"))

    def search(rows: DataFrame) -> DataFrame:
        asked = rows.select("query").distinct().withColumn("query_id", F.xxhash64("query"))
        asked = kept(asked, "asked")
        found = lexical_topk(asked.select("query_id", words(F.col("query")).alias("tokens")), tokens, top).where("score > 0")
        return _with_docs(rows, asked, found, corpus)

    return search


def dense_retriever(corpus: DataFrame, encode: Callable[[DataFrame, bool], DataFrame], top: int = 3) -> Retriever:
    """A retriever over (doc_id, title, text) by vectors: `encode` adds `vector` to rows of `text`, and is told whether they are queries."""
    from rillstone.operators.relational import vector_topk

    vectors = kept(encode(corpus.select("doc_id", F.concat_ws("\n", "title", "text").alias("text")), False).select(F.col("doc_id").alias("vec_id"), "vector"), "vectors")

    def search(rows: DataFrame) -> DataFrame:
        asked = kept(rows.select("query").distinct().withColumn("query_id", F.xxhash64("query")), "asked")
        own = encode(asked.select("query_id", F.col("query").alias("text")), True).select(F.col("query_id").alias("vec_id"), "vector")
        found = vector_topk(own, vectors, top, vec_col="vector").withColumnRenamed("id", "doc_id")
        return _with_docs(rows, asked, found, corpus)

    return search


def _with_docs(rows: DataFrame, asked: DataFrame, found: DataFrame, corpus: DataFrame) -> DataFrame:
    """`rows` with the documents found for their query, in rank order."""
    docs = found.join(corpus, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("title", "text").alias("doc")))).alias("_d"))
    lists = asked.join(docs, "query_id", "left").select("query", F.coalesce(F.transform("_d", lambda x: x["doc"]), F.array().cast("array<struct<title:string,text:string>>")).alias("docs"))
    return rows.join(lists, "query", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<title:string,text:string>>")))
