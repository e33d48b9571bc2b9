"""Scalar text functions as Column expressions; only the balanced-block scan needs Python (a pandas UDF)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# British spellings made American, in the order they are applied.
SPELLINGS = (("odelling", "odeling"), ("rganisation", "rganization"), ("ptimisation", "ptimization"), ("nalyse", "nalyze"), ("ehaviour", "ehavior"))

# Question words that are no keywords.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall must of in on at to for with by from up about into than "
    "what how why when where who which can tell me you i and or but not this that these those it its as if so my your we our they them their he she his her any all "
    "more also just get use used using give make know like"
).split()

NO_INFO = "<<NO_RELEVANT_INFO>>"
NOT_CITED = "Not in the graph. The LLM could not produce a citation-backed answer from the community evidence."
CITATION = r"\[\[([^\[\]\n]{1,80})\]\]"


def strip_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return strip_space(F.regexp_replace(c, r"(?U)\s+", " "))


def cell_text(c: Column) -> Column:
    """A CSV cell as text: null and NaN are empty, white space collapsed."""
    t = collapse_space(c.cast("string"))
    return F.when(c.isNull() | (F.lower(t) == "nan"), "").otherwise(t)


def _american(c: Column) -> Column:
    for british, american in SPELLINGS:
        c = F.replace(c, F.lit(british), F.lit(american))
    return c


def normal_name(name: Column) -> Column:
    """Key under which names are duplicates: no parentheses, American spelling, single blanks, lower case."""
    return F.lower(collapse_space(_american(F.regexp_replace(name, r"(?U)\s*\(.*?\)", ""))))


def stem(token: Column) -> Column:
    """Plural and -ing endings of a token cut; the first rule that fits is applied."""
    n = F.length(token)
    plural = (n > 3) & token.endswith("s") & ~token.rlike("(ss|us|is|os|as)$")
    return (
        F.when((n > 5) & token.endswith("ing"), F.substr(token, F.lit(1), n - 3))
        .when((n > 4) & token.endswith("ies"), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y")))
        .when(plural, F.substr(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def token_signature(name: Column) -> Column:
    """Stemmed ASCII tokens in order; empty for names without any."""
    low = F.lower(_american(F.regexp_replace(name, r"(?U)\s*\(.*?\)", "")))
    return F.array_join(F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), stem), " ")


def initials(name: Column) -> Column:
    """First letters of two or more tokens, if 2 to 8 of them; otherwise null."""
    tokens = F.regexp_extract_all(name, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    letters = F.lower(F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), ""))
    return F.when(F.size(tokens).between(2, 8), letters)


def is_acronym(name: Column) -> Column:
    capitals = F.length(F.regexp_replace(name, r"[^\p{Lu}]", ""))
    return ~F.contains(name, F.lit(" ")) & F.length(name).between(2, 8) & (capitals >= 2)


def keywords(question: Column) -> Column:
    """Distinct words of three or more ASCII letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS)))


def one_line(text: Column, cap: int = 180) -> Column:
    """First sentence of a text, at most ``cap`` characters."""
    first = F.element_at(F.split(strip_space(text), r"(?U)(?<=[.!?])\s+", 2), 1)
    return strip_space(F.substring(first, 1, cap))


def without_fence(text: Column) -> Column:
    """Without a code fence around it."""
    t = strip_space(text)
    return strip_space(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


_STRING_OR_BRACKET = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]', re.S)
_CLOSING = {"{": "}", "[": "]"}


def balanced_block(text: str | None) -> str | None:
    """First balanced ``{...}`` or ``[...]``, string literals honoured; None if it never closes."""
    begin = re.search(r"[{\[]", text or "")
    if begin is None:
        return None
    weight = {begin[0]: 1, _CLOSING[begin[0]]: -1}
    depth = 0
    for token in _STRING_OR_BRACKET.finditer(text, begin.start()):
        depth += weight.get(token[0], 0)
        if not depth:
            return text[begin.start() : token.end()]
    return None


@F.pandas_udf(StringType())
def json_block(text: pd.Series) -> pd.Series:
    return text.map(balanced_block)


def after_reasoning(text: Column) -> Column:
    """What follows the last ``</think>``, stripped."""
    return strip_space(F.substring_index(text, "</think>", -1))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def enforce_citations(text: Column) -> Column:
    """Lines that make claims keep only their cited sentences; other lines stay; nothing left gives a fixed answer."""

    def line(x: Column) -> Column:
        raw, s = x.raw, x.s
        structural = (F.length(s) < 50) | s.rlike(r"^(#|-|\*|>|\||```)") | s.endswith(":") | F.contains(F.lower(s), F.lit("not in the graph"))
        kept = F.array_join(F.filter(F.split(s, r"(?U)(?<=[.!?])\s+"), lambda c: c.rlike(CITATION)), " ")
        return F.when(structural, raw).otherwise(F.concat(F.regexp_extract(raw, r"(?U)^(\s*)", 1), F.nullif(kept, F.lit(""))))

    # Each line is stripped once: the pair of forms is built by a first pass, the rules read it in a second.
    pairs = F.transform(F.split(text, "\r\n|\r|\n"), lambda raw: F.struct(raw.alias("raw"), strip_space(raw).alias("s")))
    lines = F.filter(F.transform(pairs, line), lambda x: x.isNotNull())
    clean = strip_space(F.array_join(lines, "\n"))
    return F.when(text.isNull() | (text == ""), text).when(clean == "", NOT_CITED).otherwise(clean)


def informative(answer: Column) -> Column:
    """Is this an answer, neither blank nor marked as without information?"""
    return F.coalesce(~F.contains(answer, F.lit(NO_INFO)) & (strip_space(answer) != ""), F.lit(False))


def safe_filename(name: Column) -> Column:
    """A file name that any system accepts: forbidden runs become a blank, at most 120 characters."""
    clean = collapse_space(F.regexp_replace(name, r'[\\/:*?"<>|]+', " "))
    return F.substring(F.when(clean == "", "untitled").otherwise(clean), 1, 120)


def truncated(text: Column, context_window: int) -> Column:
    return F.substring(text, 1, context_window * 3)


def escaped_context(text: Column) -> Column:
    """Braces doubled, for use in a template."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def in_vocabulary(value: Column, vocabulary: list[str], other: str) -> Column:
    """Values outside a vocabulary become ``other``; an empty vocabulary allows all."""
    return F.when(value.isin(*vocabulary), value).otherwise(F.lit(other)) if vocabulary else value


def provider(base_url: Column) -> Column:
    """The kind of model service behind an address."""
    u = F.lower(base_url)
    has = lambda *parts: F.greatest(*[F.contains(u, F.lit(p)).cast("int") for p in (*parts, parts[0])]) == 1
    return (
        F.when(F.coalesce(base_url, F.lit("")) == "", "openai")
        .when(has("1234", "lmstudio"), "lmstudio")
        .when(has("11434", "ollama"), "ollama")
        .when(has("googleapis.com"), "gemini")
        .when(has("anthropic"), "anthropic")
        .otherwise("custom")
    )


def dot(a: Column, b: Column) -> Column:
    """Sum of products up to the shorter length; the cosine of unit vectors."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
