"""Questions to outside models as batch jobs: judge, classify, value and distil, with what each answer cost.

A model is a batch function over prompts that gives (text, tokens in, tokens out) each, in order. How it is asked, tried again
and skipped is one operator; what its text means is a column each, so that answers that were kept are read again without asking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators.curation import PAIR_MARK, distinct_pairs
from rillstone.streaming.machines import delay, retryable

#: Batch of prompts -> (text, tokens in, tokens out) of each.
Model = Callable[[list[str]], list[tuple[str | None, int, int]]]


def asked(rows: DataFrame, prompt: str, model: Model, *, attempts: int = 3, on_failure: str = "skip", base: float = 0.0) -> DataFrame:
    """`rows` with response, tokens_in, tokens_out, attempts and failure (the last error's text, else null).

    A batch whose error may pass is tried again, with growing waits; one that fails for good leaves nulls and its error, or with
    on_failure "raise" fails the job. Rows without a prompt are not asked. Tokens of tries that failed are not known and not counted.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import random
        import time

        for b in batches:
            prompts = b.column(b.schema.get_field_index(prompt)).to_pylist()
            places = [i for i, p in enumerate(prompts) if p is not None]
            found, tries, failure = None, 0, None
            while places and found is None and tries < attempts:
                tries += 1
                try:
                    found = list(model([prompts[i] for i in places]))
                    if len(found) != len(places):
                        found = None
                        raise ValueError("as many responses as prompts are wanted")
                except Exception as e:
                    failure = f"{type(e).__name__}: {e}"
                    if tries == attempts or not retryable(e):
                        if on_failure == "raise":
                            raise
                        break
                    time.sleep(delay(tries, base, share=random.random()))
            out = [(None, 0, 0, 0, None)] * len(prompts)
            for k, i in enumerate(places):
                out[i] = (*found[k], tries, None) if found is not None else (None, 0, 0, tries, failure)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]], [*names, "response", "tokens_in", "tokens_out", "attempts", "failure"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, response string, tokens_in long, tokens_out long, attempts int, failure string")


def verdict(response: Column, failure: Column) -> Column:
    """correct, incorrect or unjudgeable by what a judge says; ERROR: and the reason where it said nothing."""
    said = F.lower(F.trim(response))
    wrong = F.contains(said, F.lit("incorrect"))
    return F.when(response.isNull(), F.concat(F.lit("ERROR:"), F.coalesce(failure, F.lit("None")))).when(wrong, "incorrect").when(F.contains(said, F.lit("correct")), "correct").otherwise("unjudgeable")


def error_class(response: Column, failure: Column) -> Column:
    """struct(error_category, rationale) of a classifier's JSON object; classification_failed where it is none."""
    got = F.try_parse_json(response)
    field = lambda name: F.try_variant_get(got, f"$.{name}", "string")
    category = field("error_category")
    whole = F.coalesce(F.schema_of_variant(got).startswith("OBJECT"), F.lit(False))
    why = F.concat(F.lit("API error: "), F.coalesce(failure, F.lit("no JSON object")))
    return F.struct(F.when(whole, category).otherwise("classification_failed").alias("error_category"), F.when(whole, field("rationale")).otherwise(why).alias("rationale"))


def value_of(response: Column) -> Column:
    """A rater's last number, in hundredths, within 0 and 1; null without a number."""
    number = T.last_number(response).cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100.0)))


def evidence_of(response: Column) -> Column:
    """What a reader has distilled, between its tags; empty where they are missing."""
    return F.coalesce(T.first_tag(response, "evidence"), F.lit(""))


def distilled(pairs: DataFrame, query: str, reference: str, prompt: Callable[[Column, Column], Column], model: Model, done: DataFrame | None = None, mark: str = PAIR_MARK, **options) -> DataFrame:
    """(key, query, reference, evidence_raw, evidence, tokens_in, tokens_out) of each distinct pair that `done` (key) lacks.

    Pairs count once by the digest of both texts, however many rows have them; a pair that fails has no row and is asked again next time.
    """
    keyed = distinct_pairs(pairs, query, reference, mark)
    if done is not None:
        keyed = keyed.join(done.select("key"), "key", "left_anti")
    got = asked(keyed.withColumn("_prompt", prompt(F.col("query"), F.col("reference"))), "_prompt", model, **options)
    return got.where("response is not null").select("key", "query", "reference", F.col("response").alias("evidence_raw"), evidence_of(F.col("response")).alias("evidence"), "tokens_in", "tokens_out")


def costs(answers: DataFrame, by: list[str], price_in: float, price_out: float, seconds: float | None = None) -> DataFrame:
    """Calls, failures, tokens and cost (prices are a million tokens') of each group, and with `seconds` calls and tokens a second."""
    n, i, o = F.count("*"), F.sum("tokens_in"), F.sum("tokens_out")
    out = {"n": n, "n_failed": F.count_if(F.col("response").isNull()), "tokens_in": i, "tokens_out": o, "cost": F.round((i * price_in + o * price_out) / 1e6, 6)}
    if seconds:
        out |= {"calls_per_second": F.round(n / seconds, 6), "tokens_per_second": F.round(o / seconds, 6)}
    return answers.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])
