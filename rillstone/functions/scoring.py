"""Scores of retrieval steps: transition quality, document selectors, rewards, credit and advantages.

Column functions read each input more than once: give them columns, not expressions (see `transitions`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import text as T


def _clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rounded(c: Column, n: int, even: bool = False) -> Column:
    """`c` with n decimals, scaled and rounded in double arithmetic: ties go away from 0, or to even."""
    scale = 10.0**n
    return (F.rint if even else F.round)(c * scale) / scale


def similarity_to(one: Column, others: Column) -> Column:
    """Greatest Jaccard similarity of a token set to any of an array of token sets; 0 without any."""
    return F.coalesce(F.array_max(F.transform(others, lambda o: T.set_jaccard(one, o))), F.lit(0.0))


def transitions(rows: DataFrame, theta_q: float = 0.45, theta_c: float = 0.45) -> DataFrame:
    """`rows` (question, action, response, query, history array<string>, open_gaps array<string>) with the scores of each step.

    phi_q: the query aims at the gap, keeps the question's entities and is new. phi_c: evidence is stated and
    speaks of question and query. phi_s: an answer is given with (-1) or without (1) open gaps. Each is 1, 1 and 0
    where it doesn't apply. failure_type names what fell short: success, one of the three, or mixed.
    """
    c = F.col
    some = lambda x: F.when(F.size(x) > 0, x)
    a = rows.withColumns({"_evidence": F.coalesce(T.last_tag(c("response"), "evidence"), F.lit("")), "_answer": F.coalesce(T.last_tag(c("response"), "answer"), F.lit("")), "_query": F.when(F.coalesce(c("query"), F.lit("")) != "", c("query")).otherwise(F.coalesce(T.last_tag(c("response"), "query"), F.lit("")))})
    a = a.withColumn("_evidence", F.when(c("_evidence") != "", c("_evidence")).when(F.contains(F.lower("response"), F.lit("relevant evidence is")), F.trim("response")).otherwise(""))
    a = a.withColumn("_gap", F.when(F.size("open_gaps") > 0, F.array_join("open_gaps", " ")).otherwise(c("question")))
    a = a.withColumns({"_qe": T.entities(c("question")), "_qt": T.content_tokens(c("question")), "_ye": T.entities(c("_query")), "_yt": T.content_tokens(c("_query")), "_ge": T.entities(c("_gap")), "_gt": T.content_tokens(c("_gap")), "_et": T.content_tokens(c("_evidence")), "_ht": F.transform("history", T.content_tokens)})
    a = a.withColumns({"_te": F.coalesce(some(c("_ge")), c("_qe")), "_max": similarity_to(c("_yt"), c("_ht")), "_none": T.plain_form(F.when(c("_evidence") != "", c("_evidence")).otherwise(c("response"))).rlike(r"\bnone\b|\bno documents found\b|\bno relevant evidence\b")})
    aim = F.greatest(T.set_overlap(c("_ye"), c("_te")), T.set_jaccard(c("_yt"), F.coalesce(some(c("_gt")), c("_qt"))))
    keep = F.when(F.size("_qe") > 0, F.least(F.lit(1.0), F.size(F.array_intersect("_ye", "_qe")) / F.least(F.size("_qe"), F.lit(2)))).otherwise(T.set_jaccard(c("_yt"), c("_qt")))
    a = a.withColumns({"_aim": aim, "_keep": keep})
    worth = 0.45 * c("_aim") + 0.35 * c("_keep") + 0.20 * (1.0 - c("_max"))
    a = a.withColumn("_q", F.when(c("_query") == "", 0.0).otherwise(rounded(_clamped(F.when(c("_max") >= 0.85, F.least(worth, F.lit(0.20))).otherwise(worth)), 4, even=True)))
    empty = (c("_evidence") == "") | c("_none")
    a = a.withColumns({"_empty": empty, "_c": F.when(empty, 0.0).otherwise(rounded(_clamped(0.55 + 0.45 * T.set_jaccard(c("_et"), F.array_union("_qt", "_yt"))), 4, even=True))})
    analysis = c("action") == "document_analysis"
    asks = F.when(analysis, False).when(c("action").isin("query_rewrite", "force_continue"), True).when((c("_query") != "") | F.contains("response", F.lit("<query>")), True).otherwise(c("action").isin("begin_reasoning", "reasoning") & (c("_answer") == ""))
    a = a.withColumns({"query_applicable": asks, "claim_applicable": analysis | F.contains("response", F.lit("<evidence>")), "stop_applicable": c("_answer") != ""})
    a = a.withColumns({"phi_q": F.when(c("query_applicable"), c("_q")).otherwise(1.0), "phi_c": F.when(c("claim_applicable"), c("_c")).otherwise(1.0), "phi_s": F.when(~c("stop_applicable"), 0.0).when(F.size("open_gaps") > 0, -1.0).otherwise(1.0)})
    blank = c("claim_applicable") & c("_empty") & analysis
    failed = F.array_compact(F.array(
        F.when((c("query_applicable") & (c("phi_q") < theta_q)) | blank, "query_fail"), F.when(c("claim_applicable") & (c("phi_c") < theta_c) & ~blank, "claim_fail"), F.when(c("stop_applicable") & (c("phi_s") < 0), "stop_fail"),
    ))
    a = a.withColumn("_failed", failed)
    a = a.withColumn("failure_type", F.when(F.size("_failed") == 0, "success").when(F.size("_failed") > 1, "mixed").otherwise(F.get("_failed", F.lit(0))))
    a = a.withColumn("typed_score", typed_score(c("phi_q"), c("phi_c"), c("phi_s")))
    return a.drop(*[x for x in a.columns if x.startswith("_")])


def typed_score(phi_q: Column, phi_c: Column, phi_s: Column) -> Column:
    return F.bround((phi_q + phi_c + F.when(phi_s > 0, 1.0).when(phi_s == 0, 0.5).otherwise(0.0)) / 3.0, 4)


def uct(q: Column, visits: Column, parent_visits: Column, c: float = 1.4) -> Column:
    """Mean value and exploration bonus of a child; infinite before its first visit."""
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(q + c * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1))) / F.greatest(visits, F.lit(1))))


# Selectors -------------------------------------------------------------------------------
#: Which parts of the selector score count in each named selector; the first two have scores of their own.
SELECTORS: dict[str, dict[str, bool]] = {
    "evidence": {}, "no_subquery": {"subquery": False}, "no_entity": {"entity": False}, "no_history": {"history": False},
}


def share_of_words(asked: Column, held: Column) -> Column:
    """Share of a word set that another holds; 0 of an empty set."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)


def selector_parts(rows: DataFrame) -> DataFrame:
    """`rows` (question, history, subquery, title, text: strings) with the parts of the selector score, each at its weight."""
    c = F.col
    a = rows.withColumn("_doc", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))))
    a = a.withColumns({"_dw": T.word_set(c("_doc")), "_sw": T.word_set(c("subquery")), "_qw": T.word_set(c("question")), "_hw": T.word_set(c("history")), "_en": F.array_union(T.capital_runs(c("question")), T.capital_runs(c("subquery"))), "_ti": T.strict_title(c("title"))})
    hits = F.size(F.filter("_en", lambda e: F.contains(c("_doc"), e)))
    named = F.exists("_en", lambda e: F.forall(F.split(e, r"\s+"), lambda w: F.contains(c("_ti"), w)))
    a = a.withColumns({
        "part_subquery": 2.0 * share_of_words(c("_sw"), c("_dw")), "part_question": share_of_words(c("_qw"), c("_dw")), "part_entity": F.when(F.size("_en") > 0, 1.5 * hits / F.size("_en")).otherwise(0.0),
        "part_history": F.when((F.size("_dw") > 0) & (F.size("_hw") > 0), 0.5 * F.size(F.array_except("_dw", "_hw")) / F.size("_dw")).otherwise(0.0), "part_title": F.when(named, 1.0).otherwise(0.0),
        "static": share_of_words(c("_qw"), c("_dw")),
    })
    return a.drop(*[x for x in a.columns if x.startswith("_")])


def selector_score(subquery: bool = True, question: bool = True, entity: bool = True, history: bool = True, title: bool = True) -> Column:
    """The selector score from its parts, without those switched off."""
    used = {"subquery": subquery, "question": question, "entity": entity, "history": history, "title": title}
    return sum((F.col(f"part_{k}") for k, on in used.items() if on), F.lit(0.0))


def selection_metrics(titles: Column, gold: Column) -> Column:
    """struct(hit, recall, noise) of selected titles (an array, as selected) against a set of gold ones; nulls without gold."""
    hits = F.size(F.array_intersect(titles, gold))
    some = lambda c: F.when(F.size(gold) > 0, c)
    return F.struct(some((hits > 0).cast("double")).alias("hit"), some(hits / F.size(gold)).alias("recall"), some(F.when(F.size(titles) > 0, 1.0 - hits / F.size(titles)).otherwise(0.0)).alias("noise"))


# Rewards ---------------------------------------------------------------------------------
def gold_hits(docs: Column, golds: Column) -> Column:
    """Places (from 0) of the golds, array<struct<title, sentences>>, that docs, array<struct<title, text>>, hold: by title, or by a sentence within a text."""
    titles = F.transform(docs, lambda d: T.loose_title(d["title"]))
    texts = F.transform(docs, lambda d: T.ascii_words(d["text"]))
    lines = lambda g: F.filter(F.transform(F.split(F.coalesce(g["sentences"], F.lit("")), "\n"), T.ascii_words), lambda s: s != "")
    found = lambda g: F.array_contains(titles, T.loose_title(g["title"])) | F.exists(lines(g), lambda s: F.exists(texts, lambda t: F.contains(t, s)))
    return F.filter(F.transform(golds, lambda g, i: F.when(found(g), i)), lambda i: i.isNotNull())


def new_hits(hits: Column) -> Column:
    """Of an array of hit lists by turn: how many places each turn is first to hit."""
    before = lambda i: F.flatten(F.slice(hits, F.lit(1), i))
    return F.transform(hits, lambda h, i: F.size(F.array_except(h, before(i))))


def reward_f1(r: DataFrame) -> Column:
    return F.coalesce(F.array_max(F.transform("_golds", lambda g: T.overlap_f1(F.col("_pred"), g))), F.lit(0.0))


def reward_em(r: DataFrame) -> Column:
    pred = F.array_join("_pred", " ")
    return ((pred != "") & F.exists("_golds", lambda g: F.array_join(g, " ") == pred)).cast("double")


def reward_relevance(r: DataFrame) -> Column:
    return F.when(F.size("golds") == 0, 0.0).otherwise(F.size(F.array_distinct(F.flatten("_hits"))) / F.size("golds"))


def reward_marginal(r: DataFrame, gamma: float = 0.9, penalty: float = 0.10) -> Column:
    """New evidence of each turn, discounted by turn; every query after all is covered costs `penalty`."""
    gain = F.aggregate(F.transform("_new", lambda n, i: F.pow(F.lit(gamma), i) * n / F.size("golds")), F.lit(0.0), lambda acc, x: acc + x)
    # A turn comes after full coverage if the turns before it hit every gold.
    late = F.size(F.filter(F.transform("_new", lambda n, i: F.aggregate(F.slice("_new", F.lit(1), i), F.lit(0), lambda acc, x: acc + x)), lambda s: s == F.size("golds")))
    return F.when(F.size("golds") == 0, 0.0).otherwise(gain - penalty * late)


def reward_gains(r: DataFrame) -> Column:
    """The turns' new evidence, undiscounted; empty without golds."""
    return F.when(F.size("golds") == 0, F.array().cast("array<double>")).otherwise(F.transform("_new", lambda n: n / F.size("golds")))


def reward_turn_cost(r: DataFrame) -> Column:
    return -F.greatest(F.size("steps") - 1, F.lit(0)).cast("double")


def reward_repeat(r: DataFrame, cap: int = 3) -> Column:
    q = F.filter(F.transform("steps", lambda s: T.query_form(s["query"])), lambda x: x != "")
    return -F.least(F.size(q) - F.size(F.array_distinct(q)), F.lit(cap)).cast("double")


def reward_max_turn(r: DataFrame, most: int = 6) -> Column:
    spent = F.coalesce(F.col("num_turns") >= most, F.size("steps") >= max(0, most - 1))
    return F.when(spent & (F.coalesce(T.first_tag(F.col("completion"), "answer"), F.lit("")) == ""), -1.0).otherwise(0.0)


def reward_format(r: DataFrame) -> Column:
    return T.ends_with_answer(F.col("completion"))


#: Rewards by name: functions of the prepared rollouts that give a column.
REWARDS: dict[str, Callable[[DataFrame], Column]] = {
    "f1": reward_f1, "em": reward_em, "relevance": reward_relevance, "marginal_relevance": reward_marginal, "query_evidence_gain": reward_gains,
    "turn_cost": reward_turn_cost, "repeat_query": reward_repeat, "max_turn": reward_max_turn, "format": reward_format,
}


def rewarded(rollouts: DataFrame, names: Sequence[str] = tuple(REWARDS)) -> DataFrame:
    """`rollouts` (completion, steps array<struct<query, docs>>, golden_answers, golds, num_turns) with the named rewards."""
    pred = T.tokens(T.answer_form(T.first_tag(F.col("completion"), "answer")))
    r = rollouts.withColumns({"_pred": pred, "_golds": F.transform("golden_answers", lambda g: T.tokens(T.answer_form(g))), "_hits": F.transform("steps", lambda s: gold_hits(s["docs"], F.col("golds")))})
    r = r.withColumn("_new", new_hits(F.col("_hits")))
    return r.withColumns({n: REWARDS[n](r) for n in names}).drop("_pred", "_golds", "_hits", "_new")


def weighted_reward(parts: dict[str, float]) -> Column:
    """Sum of reward columns at their weights; null and not-a-number count 0."""
    return sum((w * F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for n, w in parts.items()), F.lit(0.0))


# Token advantages ------------------------------------------------------------------------
def failed_gate(value: Column, threshold: float = 1.0) -> Column:
    """Whether a teacher's signal applies: the score is missing, not finite or below the threshold."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < threshold)


def teacher_advantage(base: Column, teacher: Column, policy: Column, coef: Column, gate: Column, mask: Column) -> Column:
    """Base advantage and the gated, masked log ratio of teacher to policy."""
    return F.when(mask, base + F.when(gate, coef * (teacher - policy)).otherwise(0.0)).otherwise(0.0)


def signed_query_advantage(base: Column, credit: Column, coef: float = 0.5, clip: float = 1.5) -> Column:
    """base + coef |base| clip(credit): never changes the sign of the base."""
    if coef < 0 or clip <= 0 or coef * clip >= 1:
        raise ValueError("coef must be 0 or more, clip above 0 and their product below 1")
    return base + coef * F.abs(base) * F.least(F.lit(clip), F.greatest(F.lit(-clip), credit))


def reweighted_advantage(base: Column, teacher: Column, policy: Column, mask: Column, taught: Column, lam: float = 0.5, clip: float = 0.2, negative_only: bool = False) -> Column:
    """base * ((1 - lam) + lam * clip(exp(sign(base) * log ratio))) on taught tokens, base on others, 0 outside the mask."""
    weight = F.least(F.lit(1 + clip), F.greatest(F.lit(1 - clip), F.exp(F.signum(base) * (teacher - policy))))
    factor = F.when(taught, (1 - lam) + lam * weight).otherwise(1.0)
    if negative_only:
        factor = F.when(base < 0, factor).otherwise(1.0)
    return F.when(mask, base * factor).otherwise(0.0)
