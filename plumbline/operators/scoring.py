"""Deterministic rubric scores of answers to conversations.

Four dimensions from 1 to 5, their mean, a decision, flags and a confidence. The mean and
the decision's look at the dimensions come before rule flags lower dimensions, and are not
taken again after it; only strong flags change a decision afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import rules

# Words and phrases that decide scores.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "could", "do", "does", "did", "for", "from", "how", "i", "in", "is", "it", "me",
    "my", "of", "on", "or", "please", "should", "so", "that", "the", "their", "then", "this", "to", "try", "up", "we", "what", "when", "where", "why",
    "will", "with", "you", "your", "thanks", "thank",
)
SYNONYMS = {"restart": "reset", "reboot": "reset", "powercycle": "reset", "power-cycle": "reset", "wifi": "wireless", "wi-fi": "wireless"}
HEDGES = ("i think", "maybe", "not sure", "i don't know", "cannot be sure")
BLAME = (
    "if you had read", "if you had checked", "next time make sure", "next time, make sure", "you should have", "you didn't",
    "you failed to", "you must have entered", "you forgot to", "you neglected", "not our policy", "not our problem",
    "not my problem", "we are not responsible", "not responsible for", "outside of our control", "outside our control",
    "issue with your", "problem with your", "fault on your end", "on your end",
)
PUSHY = (
    "you need to upgrade", "you must switch", "you have to buy", "everyone is using", "all our best customers",
    "most people prefer", "everyone upgrades", "why wouldn't you", "it makes no sense", "why would you not", "trust me",
    "believe me", "i guarantee", "don't miss out", "act now", "before it's too late", "limited time", "hurry",
)
CONDESCENDING = (
    "maybe you're using it wrong", "are you sure you", "did you even try", "did you even read", "as you can clearly see",
    "it's actually quite simple", "it's really not that hard", "this is basic", "even a beginner",
    "standard practice dictates", "any user would know", "common sense",
)
TRIVIALIZERS = ("obviously", "simply", "basically")
DISMISSIVE = (
    "as i mentioned", "as i said", "like i said", "as previously stated", "as i just", "i already told you",
    "i just explained", "refer to the documentation", "check the website", "google it", "contact support",
    "contact billing", "call this number", "email support@", "email us at", "that's just how it is",
    "nothing else i can do", "there is nothing else", "cannot help with that", "can't help with that",
    "not something we can",
)
SOOTHING = ("i understand", "i'm sorry", "i apologize", "let me help", "let me look into", "let me check")
POLITE = (
    "i understand", "i'm sorry", "i apologize", "let me help", "happy to help", "glad to help", "i can help",
    "let me look into", "let me check", "thank you for", "thanks for your patience", "is there anything else",
    "don't hesitate to", "i appreciate", "great question",
)
EMPATHY = ("frustrating", "understand your concern", "sorry to hear", "i can see how", "that must be")
RUDE = (r"\byou'?re\s+trash\b", r"\bthat'?s?\s+trash\b", r"\bstupid\b", r"\bidiot\b", r"\bmoron\b", r"\bdumb\b", r"\bshut\s+up\b")
MATH_RUBRICS = ("math_basic",)
NUMERIC = r"^\s*[-+]?\d+(?:\.\d+)?\s*$"
DIMENSIONS = ("relevance", "clarity", "correctness", "tone")


def content_tokens(text: Column) -> Column:
    """Distinct tokens with synonyms replaced and stopwords left out."""
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    replaced = F.transform(T.tokens(text), lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_except(replaced, F.array(*map(F.lit, STOPWORDS)))


def relevance(question: Column, answer: Column) -> Column:
    """1, 3, 4 or 5 for 0, 1, 2 or more content tokens in both; 1 if either has none."""
    q, a = content_tokens(question), content_tokens(answer)
    shared = F.size(F.array_intersect(q, a))
    return F.when(shared == 0, 1).when(shared == 1, 3).when(shared == 2, 4).otherwise(5)


def tone(question: Column, answer: Column) -> Column:
    """From 1 (rude) to 5 (polite), by the first that holds of an ordered list of signs."""
    low = F.lower(F.regexp_replace(answer, r"^\s+|\s+$", ""))

    def graded(x: Column) -> Column:
        low, n, asked, polite, empathy = (x[c] for c in ("low", "n", "asked", "polite", "empathy"))
        starts = F.exists(F.split(low, r"[.!?]\s+"), lambda s: F.ltrim(s).rlike("^(" + "|".join(TRIVIALIZERS) + ")"))
        return (
            F.when(low == "", 1)
            .when(T.contains_any(low, (*BLAME, *PUSHY, *CONDESCENDING)), 1)
            .when(starts, 1)
            .when(T.contains_any(low, DISMISSIVE), 2)
            .when((n < 10) & (asked > 15) & ~T.contains_any(low, SOOTHING), 2)
            .when(low.rlike("|".join(RUDE)), 1)
            .when((empathy >= 1) & (polite >= 1) & (n > 30), 5)
            .when((polite >= 2) & (n > 20), 5)
            .when((polite >= 1) & (n > 20), 4)
            .when((empathy >= 1) | (polite >= 1), 4)
            .when(n > 25, 4)
            .otherwise(3)
        )

    def counted(t: Column) -> Column:
        asked = F.size(T.words(F.lower(question)))
        return F.struct(t.alias("low"), F.size(T.words(t)).alias("n"), asked.alias("asked"), T.count_phrases(t, POLITE).alias("polite"), T.count_phrases(t, EMPATHY).alias("empathy"))

    return T.let(T.let(low, counted), graded)


def correctness(answer: Column) -> tuple[Column, Column]:
    """(score, confidence) of a proxy that knows only emptiness and hedging."""
    low = F.lower(F.trim(answer))
    hedged = T.contains_any(low, HEDGES)
    return F.when(low == "", 1).when(hedged, 2).otherwise(4), F.when(low == "", 0.9).when(hedged, 0.65).otherwise(0.7)


def _strong(flags: Column, base: str) -> Column:
    return F.array_contains(flags, f"{base}:strong")


def score(cases: DataFrame, *, question: str = "question", answer: str = "answer", rubric: str | None = None) -> DataFrame:
    """``cases`` with decision, overall_score, relevance, clarity, correctness, tone, confidence and flags.

    ``rubric`` is a column of rubric ids; without it all cases are ``chat_quality``. An unknown
    rubric gives a fail with all ones, confidence 0.2 and the flag unknown_rubric. Null texts
    are empty.
    """
    q, a = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit(""))
    rid = F.col(rubric) if rubric else F.lit("chat_quality")
    math = rid.isin(*MATH_RUBRICS)
    numeric = F.when(a.rlike(NUMERIC), 5).otherwise(3)
    trimmed = F.trim(a)
    right, sure = correctness(a)
    clarity = F.when(trimmed == "", 1).when(math, numeric).when(F.length(trimmed) < 10, 3).otherwise(4)
    rows = cases.withColumns(
        {
            "_r": F.when(math, numeric).otherwise(relevance(q, a)),
            "_c": clarity,
            "_k": right,
            "_t": tone(q, a),
            "_rules": F.when(math, rules.flags(q, a, ("correctness.basic", "correctness.definition_sanity"))).otherwise(rules.flags(q, a)),
            "confidence": sure.cast("double"),
        }
    )
    each = [F.col(c) for c in ("_r", "_c", "_k", "_t")]
    overall = sum(each[1:], each[0]).cast("double") / 4
    own = F.array_compact(F.array(F.when(F.col("_r") <= 2, F.lit("low_relevance")), F.when(F.col("_t") <= 2, F.lit("rude_tone"))))
    flags = F.array_distinct(F.concat(own, F.col("_rules")))
    rows = rows.withColumns({"overall_score": overall, "flags": flags})
    nonsense, repeats = _strong(F.col("flags"), "quality.nonsense_basic") & ~math, _strong(F.col("flags"), "quality.repetition_basic") & ~math
    weak = F.exists("flags", lambda f: f.startswith("quality.nonsense_basic") | f.startswith("quality.repetition_basic")) & ~math
    wrong = F.exists("flags", lambda f: f.startswith("correctness.") & f.endswith(":strong"))
    low = F.least(*each) <= 1
    failed = (overall < 3.0) | low | wrong | nonsense | repeats
    cap = lambda c, *limits: F.least(F.col(c), *[F.when(cond, v).otherwise(5) for cond, v in limits])
    known = rid.isin("chat_quality", *MATH_RUBRICS)
    named = {
        "decision": F.when(known & ~failed, "pass").otherwise("fail"),
        "relevance": cap("_r", (nonsense | repeats, 2)),
        "clarity": cap("_c", (nonsense | repeats, 1), (weak, 2)),
        "correctness": cap("_k", (nonsense, 1)),
        "tone": F.col("_t"),
    }
    for d in DIMENSIONS:
        named[d] = F.when(known, named[d]).otherwise(1)
    named["overall_score"] = F.when(known, F.col("overall_score")).otherwise(1.0)
    named["confidence"] = F.when(known, F.col("confidence")).otherwise(0.2)
    named["flags"] = F.when(known, F.col("flags")).otherwise(F.array(F.lit("unknown_rubric")))
    keep = [c for c in cases.columns if c not in named]
    return rows.select(*keep, *[v.alias(k) for k, v in named.items()])
