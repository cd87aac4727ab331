"""Rules on an answer, each a Column that is null or a severity; a registry names them.

Further rules join by :func:`rule`. A plan is a tuple of names; unknown ones are skipped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from plumbline.functions import stats as S
from plumbline.functions import text as T

Rule = Callable[[Column, Column], Column]
REGISTRY: dict[str, Rule] = {}
CHAT_PLAN = ("quality.nonsense_basic", "quality.repetition_basic", "correctness.definition_sanity")

# Thresholds, cues and patterns.
FILLERS = ("something", "things", "various", "etc", "and so on", "kind of", "sort of", "basically", "in general")
ASKS_DEFINITION = r"\b(what is|define|definition of|meaning of)\b"
CIRCULAR = r"\b([a-z][a-z0-9_\- ]{1,50})\b\s+(is|means|refers to|defined as|is called)\s+\b\1\b"
PLACEHOLDER = r"\b(\[\s*insert\s*\]|<\s*insert\s*>|todo|tbd)\b"
KNOWN_FACTS = {r"\bcapital of france\b": "paris", r"\bcapital of japan\b": "tokyo", r"\bwhat does http stand for\b": "hypertext transfer protocol"}
ABSURD = r"(?i)\bhappy penguin(s)?\b|\btype of cheese\b|\bbananas?\b"
UNSAFE = r"(?i)\bmicrowave\b|\bhack\b|\bexploit\b"


def rule(name: str) -> Callable[[Rule], Rule]:
    """Registers a rule (question, answer) -> severity or null."""

    def register(f: Rule) -> Rule:
        REGISTRY[name] = f
        return f

    return register


def flags(question: Column, answer: Column, plan: tuple[str, ...] = CHAT_PLAN) -> Column:
    """``name:severity`` of the plan's rules that speak up, in its order, each once."""
    found = [F.concat(F.lit(f"{name}:"), REGISTRY[name](question, answer)) for name in plan if name in REGISTRY]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def nonsense_signals(answer: Column) -> dict[str, Column]:
    """Share of letters, words, the longest run of a character (at least 6 or not), share of gibberish tokens."""
    t = F.trim(answer)
    tokens = F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0))

    def gibberish(token: Column) -> Column:
        low = F.lower(token)
        vowels = F.length(low) - F.length(F.translate(low, "aeiou", ""))
        return (vowels == 0) | (vowels.cast("double") / F.length(low) < 0.20) | low.rlike("[^aeiou]{6,}")

    share = lambda x: F.when(F.size(x) == 0, 1.0).otherwise(S.ratio(F.size(F.filter(x, gibberish)), F.size(x)))
    return {
        "alpha_ratio": S.ratio(F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(t)),
        "word_count": F.size(T.words(t)),
        "char_run": t.rlike(r"(?s)(.)\1{5,}"),
        "gibberish_ratio": T.let(tokens, share),
    }


@rule("quality.nonsense_basic")
def nonsense(question: Column, answer: Column) -> Column:
    """Strong if two of: few letters, under 3 words, a run of 6 equal characters, gibberish; weak if one."""
    s = nonsense_signals(answer)
    hits = (s["alpha_ratio"] < 0.55).cast("int") + (s["word_count"] < 3).cast("int") + s["char_run"].cast("int") + (s["gibberish_ratio"] >= 0.55).cast("int")
    return F.when(F.trim(answer) == "", None).otherwise(T.let(hits, lambda h: F.when(h >= 2, "strong").when(h == 1, "weak")))


def repetition_signals(answer: Column) -> dict[str, Column]:
    """Share of lines that repeat, number of trigrams that stand 3 times or more, tokens and the share of distinct ones."""
    lines = F.filter(F.transform(F.split(F.lower(answer), r"\r?\n+"), F.trim), lambda x: x != "")
    toks = T.tokens(answer)
    true = lambda b: b
    # In sorted order a line repeats if a neighbour is equal.
    beside = T.let(F.array_sort(lines), lambda o: F.size(F.filter(F.transform(o, lambda x, i: (x == F.get(o, i - 1)) | (x == F.get(o, i + 1))), true)))
    # A gram stands 3 times if it equals the one two further on; counted at its first place.
    first = lambda o, g, i: (g == F.get(o, i + 2)) & F.coalesce(g != F.get(o, i - 1), F.lit(True))
    thrice = T.let(F.array_sort(T.ngrams(toks, 3)), lambda o: F.size(F.filter(F.transform(o, lambda g, i: first(o, g, i)), true)))
    return {
        "duplicate_line_ratio": S.ratio(beside, F.size(lines)),
        "repeated_ngrams": thrice,
        "tokens": F.size(toks),
        "unique_ratio": F.size(F.array_distinct(toks)).cast("double") / F.greatest(F.lit(1), F.size(toks)),
    }


@rule("quality.repetition_basic")
def repetition(question: Column, answer: Column) -> Column:
    """Speaks up for repeated lines, trigrams or few distinct tokens; the strong test has no floor of tokens."""
    signals = F.struct(*[v.alias(k) for k, v in repetition_signals(answer).items()])

    def severity(s: Column) -> Column:
        hit = (s["duplicate_line_ratio"] >= 0.35) | (s["repeated_ngrams"] > 0) | ((s["tokens"] >= 8) & (s["unique_ratio"] <= 0.4))
        strong = (s["duplicate_line_ratio"] >= 0.35 * 1.5) | (s["repeated_ngrams"] >= 2) | (s["unique_ratio"] <= 0.4)
        return F.when(hit & strong, "strong").when(hit, "weak")

    return F.when(F.trim(answer) == "", None).otherwise(T.let(signals, severity))


@rule("correctness.definition_sanity")
def definition(question: Column, answer: Column) -> Column:
    """For questions that ask for a definition: circular ones are strong, so are two signs of an empty one."""
    a = T.squeezed(answer)
    circular = a.rlike(CIRCULAR)
    hits = (F.size(T.words(answer)) < 8).cast("int") + circular.cast("int") + (T.count_phrases(a, FILLERS) >= 2).cast("int") + a.rlike(PLACEHOLDER).cast("int")
    asked = T.squeezed(question).rlike(ASKS_DEFINITION) & (a != "")
    return F.when(~asked, None).when(circular | (hits >= 2), "strong").when(hits == 1, "weak")


def arithmetic_wrong(question: Column, answer: Column) -> Column:
    """Whether the answer's number is not the value of the question's ``a op b``; null if either is missing.

    One operator of + - * / %, with % of the divisor's sign; longer expressions are left to a
    provider of general arithmetic.
    """
    number = r"[-+]?\s*\d+(?:\.\d+)?"
    pattern = rf"({number})\s*([-+*/%])\s*({number})"
    part = lambda i: F.regexp_replace(F.regexp_extract(question, pattern, i), r"\s+", "")
    a, op, b = part(1).try_cast("double"), part(2), part(3).try_cast("double")
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)).when(op == "%", a - b * F.floor(F.try_divide(a, b)))
    anchored = F.regexp_extract(answer, r"(?:=\s*|(?:is|equals|are)\s+)([-+]?\d+(?:\.\d+)?)|([-+]?\d+(?:\.\d+)?)\s*[.!]?\s*$", 1)
    ending = F.regexp_extract(answer, r"(?:=\s*|(?:is|equals|are)\s+)([-+]?\d+(?:\.\d+)?)|([-+]?\d+(?:\.\d+)?)\s*[.!]?\s*$", 2)
    last = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1))
    said = F.coalesce(F.nullif(anchored, F.lit("")), F.nullif(ending, F.lit("")), last).try_cast("double")
    return F.abs(said - value) > 1e-9


EXPRESSION = re.compile(r"[-+]?\s*\d+(?:\.\d+)?(?:\s*[-+*/%]\s*[-+]?\s*\d+(?:\.\d+)?)+")
ANCHORED = re.compile(r"(?:=\s*|(?:is|equals|are)\s+)([-+]?\d+(?:\.\d+)?)|([-+]?\d+(?:\.\d+)?)\s*[.!]?\s*$")


def value_of(expression: str) -> float | None:
    """The value of a chain of numbers with signs and + - * / %, products before sums; null for a division by 0.

    A remainder has the sign of its divisor.
    """
    total, term, added, operator, sign, number_next = 0.0, 0.0, 1, "+", 1.0, True
    for part in re.findall(r"\d+(?:\.\d+)?|[-+*/%]", expression):
        if number_next and not part[0].isdigit():
            sign = -sign if part == "-" else sign
        elif number_next:
            number, sign, number_next = sign * float(part), 1.0, False
            if operator in "/%" and number == 0:
                return None
            if operator in "+-":
                total, term, added = total + added * term, number, 1 if operator == "+" else -1
            else:
                term = term * number if operator == "*" else term / number if operator == "/" else term - number * math.floor(term / number)
        else:
            operator, number_next = part, True
    return total + added * term


@F.pandas_udf(BooleanType())
def expression_wrong(question: pd.Series, answer: pd.Series) -> pd.Series:
    """:func:`arithmetic_wrong` for expressions of any length; null if the question has no expression or the answer no number."""

    def one(q: str | None, a: str | None) -> bool | None:
        found = EXPRESSION.search(q or "")
        value = value_of(found[0]) if found else None
        hit = ANCHORED.search(a or "")
        numbers = [x for x in (hit.groups() if hit else ()) if x] or re.findall(r"[-+]?\d+(?:\.\d+)?", a or "")[-1:]
        return None if value is None or not numbers else abs(float(numbers[0]) - value) > 1e-9

    return pd.Series([one(q, a) for q, a in zip(question, answer, strict=True)], dtype=object)


@rule("correctness.basic")
def basic_correctness(question: Column, answer: Column) -> Column:
    """Empty answers and wrong arithmetic are strong."""
    return F.when((F.trim(answer) == "") | F.coalesce(arithmetic_wrong(question, answer), F.lit(False)), "strong")


def detectors(question: Column, answer: Column) -> Column:
    """Flags of detectors that stand in no plan: known facts, absurd answers, unsafe advice."""
    low, facts = F.lower(F.trim(answer)), F.lit(None).cast("string")
    for pattern, fact in reversed(KNOWN_FACTS.items()):
        facts = F.when(question.rlike("(?i)" + pattern), F.when(~low.contains(fact), F.lit("correctness.known_fact_mismatch"))).otherwise(facts)
    q, a = (F.array_distinct(T.tokens(c, "[a-z]{3,}")) for c in (question, answer))
    absurd = F.when(low == "", F.lit("correctness.empty_answer")).when(answer.rlike(ABSURD) & (F.size(q) > 0) & (T.containment(q, a) < 0.15), F.lit("correctness.nonsense_detected"))
    return F.array_compact(F.array(facts, absurd, F.when(answer.rlike(UNSAFE), F.lit("correctness.unsafe_advice"))))
