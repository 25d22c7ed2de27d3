"""Text normalizers, answer metrics and tag functions as Column expressions.

Each normalizer has its own name, for they differ on purpose: which characters go, in
which order, and whether they leave a space behind.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation and the articles that answer comparison ignores.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"\b(a|an|the)\b"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def answer_form(c: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), PUNCTUATION, ""), ARTICLES, " "))


def plain_form(c: Column) -> Column:
    """As `answer_form`, articles kept."""
    return squeeze(F.regexp_replace(F.lower(_text(c)), PUNCTUATION, ""))


def loose_title(c: Column) -> Column:
    return squeeze(F.lower(_text(c)))


def strict_title(c: Column) -> Column:
    """Characters other than a-z, 0-9 and white space go without a trace."""
    return squeeze(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9\s]", ""))


def ascii_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9]+", " "))


def query_form(c: Column) -> Column:
    """Runs of anything but letters, digits and underscores become a space."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}_]+", " "))


def tokens(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda x: x != "")


def word_set(c: Column) -> Column:
    """Distinct words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(c)), F.lit(r"\b([a-z]{3,})\b"), F.lit(1)))


def exact_match(pred: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: answer_form(g) == answer_form(pred))


def numbered(t: Column) -> Column:
    """Tokens with their number among equal ones, so that sets of them are multisets."""
    one = F.array(F.array_sort(t))  # the sorted array as a variable, so that it is made once
    return F.get(F.transform(one, lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit(" "), (i - F.array_position(s, x)).cast("string")))), F.lit(0))


def overlap_f1(p: Column, g: Column) -> Column:
    """Multiset F1 of two token arrays, each given as a column of its own; both empty is 1, one empty 0."""
    both = F.size(F.array_intersect(numbered(p), numbered(g)))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def holds_in_a_row(p: Column, g: Column) -> Column:
    """Whether the tokens g, some, stand in a row among p."""
    padded = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(g) > 0) & F.contains(padded(p), padded(g))


def token_f1(pred: Column, golds: Column) -> Column:
    """Best multiset token F1 over the golds. `pred` and `golds` are best columns, for they are read more than once."""
    p = tokens(answer_form(pred))
    return F.coalesce(F.array_max(F.transform(golds, lambda g: overlap_f1(p, tokens(answer_form(g))))), F.lit(0.0))


def cover_match(pred: Column, golds: Column) -> Column:
    """Whether some gold's tokens stand in a row among the prediction's."""
    return F.exists(golds, lambda g: holds_in_a_row(tokens(answer_form(pred)), tokens(answer_form(g))))


def tag_values(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def first_tag(c: Column, tag: str) -> Column:
    return F.trim(F.try_element_at(tag_values(c, tag), F.lit(1)))


def last_tag(c: Column, tag: str) -> Column:
    return F.trim(F.try_element_at(tag_values(c, tag), F.lit(-1)))


def tags_balanced(c: Column, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & (F.regexp_count(_text(c), F.lit(f"<{name}>")) == F.regexp_count(_text(c), F.lit(f"</{name}>")))
    return out


def set_jaccard(a: Column, b: Column) -> Column:
    """Both empty is 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def title_of(contents: Column) -> Column:
    """The first line, without spaces and then quotes around it."""
    return F.trim(F.regexp_replace(F.trim(F.substring_index(contents, "\n", 1)), r'^"+|"+$', ""))


def body_of(contents: Column, most: int = 500) -> Column:
    """What follows the first line, trimmed, at most `most` characters; empty without a second line."""
    at = F.instr(contents, "\n")
    return F.when(at > 0, F.left(F.regexp_replace(F.substring(contents, at + 1, F.length(contents)), r"^\s+|\s+$", ""), F.lit(most))).otherwise("")


# Further normalizers --------------------------------------------------------------------
def ascii_form(c: Column) -> Column:
    """Characters beyond ASCII become x: word borders then mean the same to every engine."""
    return F.regexp_replace(_text(c), r"[^\x00-\x7F]", "x")


def case_form(c: Column) -> Column:
    """Lower case; articles go first, then all but a-z, 0-9 and spaces become spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), ARTICLES, " "), "[^a-z0-9 ]", " "))


def collapsed(c: Column) -> Column:
    """Single spaces, case kept."""
    return squeeze(_text(c))


def folded(c: Column) -> Column:
    """Compatibility-composed (NFKC), single spaces, case-folded; Spark has no such function, so in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold())

    return run(_text(c))


def distinct_texts(values: Column) -> Column:
    """An array's texts that aren't blank, compatibility-composed with single spaces, the first of each case-folded form, in order; in Arrow batches."""
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        import unicodedata

        def one(texts):
            seen: dict[str, str] = {}
            for t in texts if texts is not None else ():
                plain = " ".join(unicodedata.normalize("NFKC", t or "").split())
                if plain:
                    seen.setdefault(plain.casefold(), plain)
            return list(seen.values())

        return lists.map(one)

    return run(values)


def signature(*parts: Column) -> Column:
    """Parts in lower case with single spaces, joined by bars."""
    return F.concat_ws("|", *[squeeze(F.lower(_text(p))) for p in parts])


# Words that carry no content in token sets.
STOPWORDS = (
    "a an the and or but if then else of in on at by for from to with without about into over under is are was were be been being do does did has have had "
    "who what when where which why how this that these those it its his her their there as than first second third last year name person people city country "
    "state university school film book album song actor actress writer president"
).split()


def content_tokens(c: Column) -> Column:
    """Distinct tokens of two characters or more that are no stopwords, from the form without punctuation."""
    return F.array_distinct(F.filter(tokens(plain_form(c)), lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS)))


# Entities --------------------------------------------------------------------------------
def entities(c: Column) -> Column:
    """Distinct runs of two capitalised words or more, single ones that are no stopwords, numbers of 3 or 4 digits, quoted strings."""
    t = _text(c)
    found = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    single = F.filter(found(r"\b([A-Z][a-z]+)\b"), lambda x: ~F.lower(x).isin(STOPWORDS))
    quoted = F.filter(F.transform(found(r'"([^"]+)"'), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(found(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), single, found(r"\b(\d{3,4})\b"), quoted))


def capital_runs(c: Column) -> Column:
    """Distinct runs of capitalised words, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(c), F.lit(r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\b"), F.lit(1)), F.lower))


def set_overlap(source: Column, target: Column) -> Column:
    """Share of `source` in `target`; of an empty source 1 if the target is empty too, else 0."""
    return F.when(F.size(source) == 0, F.when(F.size(target) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(source, target)) / F.size(source))


# Tags ------------------------------------------------------------------------------------
def close_tag(c: Column, tag: str) -> Column:
    """A closing tag at the end where an opened one has none; a broken one at the end goes."""
    whole = F.contains(c, F.lit(f"</{tag}>")) | ~F.contains(c, F.lit(f"<{tag}>"))
    return F.when(whole, c).otherwise(F.concat(F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), rf"</{tag}[^>]*$", ""), F.lit(f"</{tag}>")))


def before_closing(c: Column, tag: str) -> Column:
    """What stands before the closing tag, or before the beginning of one at the end of an unfinished text."""
    closing = f"</{tag}>"
    out = c
    for size in range(1, len(closing)):  # the longest ending that begins the tag is looked for first
        out = F.when(F.endswith(c, F.lit(closing[:size])), F.left(c, F.length(c) - size)).otherwise(out)
    return F.when(F.contains(c, F.lit(closing)), F.substring_index(c, closing, 1)).otherwise(out)


def tagged_parts(c: Column) -> Column:
    """Contents of 'So the next query is' and 'So the answer is' phrases, wrapped into their tags where they have none."""

    def wrap(t: Column, opening: str, tag: str) -> Column:
        content = F.trim(F.regexp_extract(t, rf"(?s){opening} (.*?)(?= So the answer is|$)", 1))
        bare = F.regexp_replace(content, r'[."]+$', "")
        made = F.when(bare.rlike(rf"<{tag}>.*</{tag}>"), bare).otherwise(F.concat(F.lit(f"<{tag}>"), bare, F.lit(f"</{tag}>")))
        return F.when((content != ""), F.replace(t, content, made)).otherwise(t)

    return wrap(wrap(_text(c), "So the next (?:query )?is", "query"), "So the answer is", "answer")


def last_protocol_answer(c: Column) -> Column:
    """The last answer tag's text, or what follows the last 'So the answer is', up to its first full stop."""
    t = _text(c)
    tag = F.try_element_at(F.regexp_extract_all(t, F.lit("<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))
    said = F.when(F.contains(t, F.lit("So the answer is")), F.substring_index(t, "So the answer is", -1))
    raw = F.regexp_replace(F.trim(F.coalesce(tag, said, F.lit(""))), r"(?s)<answer.*?>.*?</answer>|<query.*?>.*?</query>|answer>|<answer", "")
    return F.trim(F.substring_index(raw, ".", 1))


def action_of(c: Column) -> Column:
    """query, answer, evidence or other: the first of these whose opening tag occurs."""
    has = lambda tag: F.contains(_text(c), F.lit(f"<{tag}>"))
    return F.when(has("query"), "query").when(has("answer"), "answer").when(has("evidence"), "evidence").otherwise("other")


def _last_at(c: Column, tag: str) -> Column:
    """Where the last whole tag begins, from 1; 0 without one."""
    whole = F.regexp_extract_all(c, F.lit(rf"(?s)(<{tag}>.*?</{tag}>)"), F.lit(1))
    # The last whole tag begins where the text before it ends: cut the text at whole tags.
    pieces = F.split(c, rf"(?s)<{tag}>.*?</{tag}>", -1)
    before = F.aggregate(F.slice(pieces, F.lit(1), F.size(whole)), F.lit(0), lambda acc, x: acc + F.length(x))
    taken = F.aggregate(F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + F.length(x))
    return F.when(F.size(whole) > 0, before + taken + 1).otherwise(0)


def completion_shape(c: Column) -> Column:
    """answer_only, query_only, neither, or which of the two stands last."""
    t = _text(c)
    q, a = _last_at(t, "query"), _last_at(t, "answer")
    return F.when((q == 0) & (a == 0), "neither").when(q == 0, "answer_only").when(a == 0, "query_only").when(a > q, "query_then_answer").otherwise("answer_then_query")


def ends_with_answer(c: Column) -> Column:
    """1 if the last protocol tag is an answer that isn't empty."""
    t = _text(c)
    return ((_last_at(t, "answer") > _last_at(t, "query")) & (F.coalesce(last_tag(t, "answer"), F.lit("")) != "")).cast("double")


def answer_without_query(c: Column) -> Column:
    """The older rule: an answer and no query."""
    return ((F.size(tag_values(c, "answer")) > 0) & (F.size(tag_values(c, "query")) == 0)).cast("double")


# Cleaning --------------------------------------------------------------------------------
# Tags, phrases, headings and openings that thoughts are cleaned of.
_TAGS = "answer|query|evidence|reference|information"
_PHRASES = [r"So the answer is\s*", r"So the next query is\s*", r"So the next is\s*", r"Based on the (?:query|provided documents|reference)[,]?\s*the relevant evidence is\s*"]
_HEADINGS = "Error Reflection|Information Sufficiency|Conciseness|Conclusion|Analyze and Decompose the Question|Evaluate Your Knowledge|Respond Format|Instructions|Response format"
_OPENING = r"^\s*(?:To answer this question|To address this question|Let(?:'s| us) (?:break|analyze|consider))[^\.\n]*[\.\n]\s*"


def without_tags(c: Column) -> Column:
    """Whole tags with their contents go, then what is left of tags."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?is)<({_TAGS})[^>]*>.*?</\1>", ""), rf"(?i)</?({_TAGS})[^>]*>?", "")


def tidy(c: Column) -> Column:
    """Runs of line feeds, and of blanks and tabs, become one; ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\n{2,}", "\n"), r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def first_words(c: Column, n: int) -> Column:
    """The first n words with single spaces; shorter texts stay as they are."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.when(F.size(words) <= n, c).otherwise(F.array_join(F.slice(words, 1, n), " "))


def stated_evidence(c: Column) -> Column:
    """The last evidence tag's text, or null if there is none, or it is empty or 'none'."""
    last = F.regexp_replace(F.try_element_at(F.regexp_extract_all(_text(c), F.lit(r"(?is)<evidence[^>]*>(.*?)</evidence>"), F.lit(1)), F.lit(-1)), r"^\s+|\s+$", "")
    return F.when((last != "") & (F.lower(last) != "none"), last)


def clean_thought(c: Column, words: int = 25, fallback: Column | None = None) -> Column:
    """Stated evidence, or the text without tags, phrases, headings and opening; tidy, cut at `words`; else `fallback`."""
    t = without_tags(_text(c))
    for p in _PHRASES:
        t = F.regexp_replace(t, f"(?i){p}", "")
    t = F.regexp_replace(t, rf"(?i)(?:^|(?<=[\s\.]))({_HEADINGS})\s*[:：]\s*", "")
    t = F.regexp_replace(t, f"(?i){_OPENING}", "")
    out = first_words(tidy(F.coalesce(stated_evidence(c), t)), words)
    return F.when(out != "", out).otherwise(F.coalesce(fallback, F.lit("")) if fallback is not None else F.lit(""))


def clean_subquery(c: Column, fallback: Column | None = None) -> Column:
    """The last query tag's text, what follows 'So the next query is', or the text without tags; else `fallback`."""
    t = _text(c)
    some = lambda x: F.when(F.trim(x) != "", x)
    tag = F.regexp_replace(F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?is)<query[^>]*>(.*?)</query>"), F.lit(1)), F.lit(-1)), r"^\s+|\s+$", "")
    said = F.regexp_replace(F.trim(without_tags(F.regexp_extract(t, r"(?is)So the next query is\s*(.+?)(?:\n|$)", 1))), r'^["“]|["”\.]+$', "")
    return F.coalesce(some(tidy(tag)), some(tidy(said)), some(tidy(without_tags(t))), fallback if fallback is not None else F.lit(""), F.lit(""))


def inferred_subquery(c: Column, question: Column) -> Column:
    """The query that joined thoughts imply, by five rules in turn; the question if none holds."""
    t = _text(c)
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(
        some(F.regexp_extract(t, r"(?i)So the next query is\s*(.*?)(?:\.|$)", 1)),
        some(last("<query>(.*?)</query>")),
        F.trim(last(r"(?i)(?:Determine|Find|Search for|Look up|Identify|Discover)\s+(.*?)(?:\.|$)")),
        F.trim(last(r"\d+\.\s+(.*?[?\.»])")),
        question,
    )


# Step blocks -----------------------------------------------------------------------------
_LABELS = {"analysis": "The problem analysis:", "query": "The retrieval query:", "documents": "The retrieval documents:", "answer": "The final answer:"}


def step_blocks(c: Column) -> Column:
    """array<struct<analysis, query, documents, answer>> of the blocks under 'Step n:' lines; a section runs to the next later label."""
    blocks = F.split(F.regexp_replace(_text(c), r"^\s+|\s+$", ""), r"(?m)^Step\s+\d+\s*:\s*$", -1)
    names = list(_LABELS)

    def section(block: Column, name: str) -> Column:
        rest = F.substring(block, F.instr(block, _LABELS[name]) + len(_LABELS[name]), F.length(block))
        for later in names[names.index(name) + 1 :]:
            rest = F.substring_index(rest, _LABELS[later], 1)
        return F.when(F.contains(block, F.lit(_LABELS[name])), F.regexp_replace(rest, r"^\s+|\s+$", ""))

    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: F.struct(*[section(b, n).alias(n) for n in names]))


def question_of(c: Column) -> Column:
    """What follows 'The question:' at the beginning, up to the line's end; null without it."""
    return F.when(_text(c).rlike(r"^\s*The question:"), F.trim(F.regexp_extract(_text(c), r"^\s*The question:\s*(.*?)(?:\n|$)", 1)))


def single_action(c: Column) -> Column:
    """Tags balanced and exactly one closing query or answer tag."""
    return tags_balanced(c, "query", "answer", "evidence") & (F.regexp_count(_text(c), F.lit("</query>")) + F.regexp_count(_text(c), F.lit("</answer>")) == 1)


# Values in texts -------------------------------------------------------------------------
def last_number(c: Column) -> Column:
    """The last signed whole number as a double, null without one."""
    return F.try_element_at(F.regexp_extract_all(_text(c), F.lit(r"([+-]?\d+)"), F.lit(1)), F.lit(-1)).cast("double")


def stated_score(c: Column, default: float = 50.0) -> Column:
    """The last decimal number clamped into 0..100, or `default`."""
    found = F.try_element_at(F.regexp_extract_all(_text(c), F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)), F.lit(-1)).cast("double")
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), found)), F.lit(default))


def label_of(json: Column) -> Column:
    """struct(ok, label, reason) of a judgement in JSON whose label is yes/no, 0/1 or a boolean."""
    kind = F.get_json_object(json, "$.label")
    word = F.lower(F.trim(kind))
    label = F.when(word.isin("yes", "1", "true", "positive", "pos", "y"), 1).when(word.isin("no", "0", "false", "negative", "neg", "n"), 0)
    reason = F.when(~F.coalesce(F.trim(json).startswith("{"), F.lit(False)), "root_not_object").when(label.isNull(), F.concat(F.lit("bad_label="), F.coalesce(kind, F.lit("None"))))
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), label).alias("label"), reason.alias("reason"))


STEP_FIELDS = ("subquery", "subject_entity", "thought", "step_gold")


def steps_status(json: Column, most: int = 4) -> Column:
    """ok, or why a list of reasoning steps in JSON isn't one of 1 to `most` steps with four texts that aren't empty."""
    steps = F.from_json(F.get_json_object(json, "$.reasoning_steps"), "array<struct<" + ",".join(f"{f}:string" for f in STEP_FIELDS) + ">>")
    gap = lambda i, s: F.coalesce(*[F.when(F.trim(F.coalesce(s[f], F.lit(""))) == "", F.concat(F.lit("step"), i.cast("string"), F.lit(f"_missing_{f}"))) for f in STEP_FIELDS], F.lit(""))
    first = F.try_element_at(F.filter(F.transform(steps, lambda s, i: gap(i, s)), lambda x: x != ""), F.lit(1))
    return (
        F.when(~F.coalesce(F.trim(json).startswith("{"), F.lit(False)), "root_not_object").when(F.coalesce(F.size(steps), F.lit(0)) < 1, "missing_reasoning_steps_list")
        .when(F.size(steps) > most, F.concat(F.lit("too_many_steps="), F.size(steps).cast("string"))).otherwise(F.coalesce(first, F.lit("ok")))
    )


def decoded(c: Column, schema: str) -> Column:
    """A field parsed if it looks like JSON, else null."""
    return F.when(F.trim(c).rlike(r"^[\[{]"), F.from_json(c, schema))


def supporting_titles(json: Column) -> Column:
    """Distinct titles in order, from pairs, objects or one object of lists."""
    objects = F.from_json(json, "array<struct<title:string>>")["title"]
    pairs = F.transform(F.from_json(json, "array<array<string>>"), lambda x: F.get(x, F.lit(0)))
    column = F.from_json(json, "struct<title:array<string>>")["title"]
    found = F.when(F.trim(json).startswith("{"), column).when(F.regexp_like(json, F.lit(r"^\s*\[\s*\{")), objects).otherwise(pairs)
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def sentence_lines(values: Column) -> Column:
    """Lines of nested texts, trimmed, empty ones gone."""
    return F.filter(F.flatten(F.transform(F.flatten(values), lambda x: F.transform(F.split(x, r"\r\n|\r|\n"), lambda y: F.trim(y)))), lambda x: x != "")


def document_text(title: Column, contents: Column) -> Column:
    """Title line and body as one text."""
    return F.concat(F.trim(_text(title)), F.lit("\n"), F.trim(_text(contents)))


def config_sizes(c: Column) -> Column:
    """struct(searches, top_k) of a name such as s5_k3."""
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return F.struct(part(r"s(\d+)_k\d+").alias("searches"), part(r"s\d+_k(\d+)").alias("top_k"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.to_timestamp(end).cast("double") - F.to_timestamp(start).cast("double")


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, in Arrow batches: Spark has no such function."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return run(_text(a), _text(b))


def keyed_digest(c: Column, key: bytes, size: int = 16, most: int = 256) -> Column:
    """Hexadecimal BLAKE2b under a key of the first `most` characters, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import hashlib

        return s.map(lambda x: hashlib.blake2b(x[:most].encode(), key=key, digest_size=size).hexdigest())

    return run(_text(c))
