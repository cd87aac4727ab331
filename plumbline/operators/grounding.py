"""Grounding of sentences in sources: lexical clearing, similarity gates, cascades, thresholds, spans, graphs."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from plumbline.functions import stats as S
from plumbline.functions import text as T
from plumbline.operators import properties


def lexical_match(sentence: Column, source: Column, source_sentences: Column, least: float = 0.80) -> Column:
    """How a sentence is cleared by its words: exact_substring, token_overlap (Jaccard over ``least``) or no_match."""
    tokens = lambda s: F.array_distinct(T.tokens(s, r"[\p{L}\p{N}_]+"))
    own = tokens(sentence)
    near = T.let(own, lambda o: (F.size(o) > 0) & F.exists(source_sentences, lambda s: F.coalesce(T.jaccard(o, tokens(s)), F.lit(0.0)) > least))
    return F.when(T.squeezed(source).contains(T.squeezed(sentence)), "exact_substring").when(near, "token_overlap").otherwise("no_match")


def match_type(sentence: Column, source: Column, source_sentences: Column, near: Column | None = None, least: float = 0.80) -> Column:
    """The kinds of :func:`lexical_match` with near_exact between them, where ``near`` says so, as of :func:`near_exact`.

    A sentence is cleared unless its kind is no_match.
    """
    kind = lexical_match(sentence, source, source_sentences, least)
    return kind if near is None else F.when((kind != "exact_substring") & near, "near_exact").otherwise(kind)


def cleared_sentences(sentences: DataFrame, sentence: str = "sentence", source: str = "source", source_sentences: str = "source_sentences") -> DataFrame:
    """``sentences`` with match: words are compared in the JVM, and only what they leave open goes to the ratio in Python."""
    kind = lexical_match(F.col(sentence), F.col(source), F.col(source_sentences))
    rows = sentences.withColumn("match", kind)
    done, left = rows.where("match = 'exact_substring'"), rows.where("match <> 'exact_substring'")
    near = near_exact(F.col(sentence), F.col(source_sentences))
    return done.unionByName(left.withColumn("match", F.when(near, "near_exact").otherwise(F.col("match"))))


@F.pandas_udf(BooleanType())
def near_exact(sentence: pd.Series, sources: pd.Series) -> pd.Series:
    """Whether a matching-blocks ratio of a sentence to one of its sources is over 0.85; hopeless lengths are skipped."""

    def one(a: str, b: str) -> bool:
        return 2 * min(len(a), len(b)) > 0.85 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() > 0.85

    clean = lambda s: " ".join(s.lower().split())
    return pd.Series([any(one(clean(s), clean(x)) for x in many) for s, many in zip(sentence, sources, strict=True)])


def grounding_ratio(response: Column, context: Column, embed: Callable[[Column], Column], threshold: float = 0.60) -> tuple[Column, Column]:
    """(ratio, least) of a response's sentences: the share whose best cosine with a context sentence is ``threshold`` or more, and the worst of those best.

    Every sentence is held against every one of its context. Without response sentences both are
    1.0; without context sentences both are the overlap of tokens. ``embed`` makes a sentence a vector.
    """
    vectors = lambda text: F.transform(T.sentences(text), lambda s: embed(s))
    highest = lambda x: F.transform(x["r"], lambda v: F.array_max(F.transform(x["c"], lambda w: S.cosine(v, w))))
    best = T.let(F.struct(vectors(F.coalesce(response, F.lit(""))).alias("r"), vectors(F.coalesce(context, F.lit(""))).alias("c")), lambda x: F.when(F.size(x["c"]) > 0, highest(x)).when(F.size(x["r"]) == 0, F.array().cast("array<double>")))
    shared = properties.token_overlap(F.coalesce(response, F.lit("")), F.coalesce(context, F.lit("")))

    def judged(b: Column) -> Column:
        grounded = S.ratio(F.size(F.filter(b, lambda v: v >= threshold)), F.size(b))
        empty = F.size(b) == 0
        return F.when(b.isNull(), F.struct(shared.alias("ratio"), shared.alias("least"))).when(empty, F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("least"))).otherwise(F.struct(grounded.alias("ratio"), F.array_min(b).alias("least")))

    found = T.let(best, judged)
    return found["ratio"], found["least"]


def gate(ratio: Column, least_similarity: Column, threshold: float = 0.80, least: float = 0.30) -> Column:
    """pass, ambiguous (just under a threshold) or fail, by share of grounded sentences and the least similarity."""
    low, weak = ratio < threshold, least_similarity < least
    near = (low & (ratio >= threshold - 0.10)) | (weak & (least_similarity >= least - 0.05))
    return F.when(low | weak, F.when(near, "ambiguous").otherwise("fail")).otherwise("pass")


def bands(score: Column, low: float = 0.30, high: float = 0.70) -> Column:
    """fail under ``low``, pass from ``high`` on, ambiguous between."""
    return F.when(score < low, "fail").when(score >= high, "pass").otherwise("ambiguous")


def sweep(cases: DataFrame, thresholds: list[float], score: str, expected: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn): a case is flagged where its score is under the threshold; ``expected`` is true for bad ones.

    The grid is small and fixed, so each case is repeated where it is and counted at once.
    """
    grid = F.explode(F.array(*map(F.lit, thresholds)))
    rows = cases.select(score, expected, grid.alias("threshold"))
    flagged, bad = F.col(score) < F.col("threshold"), F.col(expected)
    return rows.groupBy("threshold").agg(F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))


def sweep_two(cases: DataFrame, grid: list[tuple[float, float]], a: str, b: str, expected: str) -> DataFrame:
    """The same for pairs of thresholds: flagged where either score is under its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("ta"), F.lit(y).alias("tb")) for x, y in grid]))
    rows = cases.select(a, b, expected, pairs.alias("g")).select(a, b, expected, "g.*")
    flagged, bad = (F.col(a) < F.col("ta")) | (F.col(b) < F.col("tb")), F.col(expected)
    return rows.groupBy("ta", "tb").agg(F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))


def label_by_spans(sentences: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Sentences (key, pos, start, end) with the label of the first span (key, s, e, label) that overlaps them, or null.

    An interval join inside the key.
    """
    spans = spans.withColumnRenamed(key, "_k")
    j = sentences.join(spans, (F.col(key) == F.col("_k")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")), "left")
    return j.groupBy(key, "pos").agg(F.min_by("label", F.struct("s", "e", "label")).alias("label"))


def ensemble(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """One verdict of several graphs': flagged if one flags, else grounded if one grounds, else unknown; with counts."""
    v = F.col("verdict")
    flagged, grounded = F.count_if(v == "flagged"), F.count_if(v == "grounded")
    final = F.when(flagged > 0, "flagged").when(grounded > 0, "grounded").otherwise("unknown")
    return verdicts.groupBy(*key).agg(flagged.alias("flagged"), grounded.alias("grounded"), final.alias("verdict"))


def resolve_entity(mentions: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, mention, node): the node a mention means, by exact name, then alias, then substring, then a shared long word.

    Of (key, mention) and (key, node, ord, aliases); within a tier the first node wins.
    """
    m, n = F.lower("mention"), F.lower("node")
    alias = F.exists("aliases", lambda a: F.lower(a).contains(m) | m.contains(F.lower(a)))
    words = F.exists(F.filter(F.split(m, " "), lambda w: F.length(w) > 2), lambda w: n.contains(w))
    tier = F.when(m == n, 1).when(alias, 2).when(n.contains(m) | m.contains(n), 3).when(words, 4)
    return mentions.join(nodes, key).withColumn("_t", tier).where("_t is not null").groupBy(key, "mention").agg(F.min_by("node", F.struct("_t", "ord")).alias("node"))


#: Verbs that mean the same.
VERB_SYNONYMS = {"assault": "attack", "attack": "assault", "announce": "declare", "declare": "announce", "respond": "react", "react": "respond", "purchase": "buy", "buy": "purchase", "stab": "wound", "wound": "stab", "shut": "close", "close": "shut"}


def stem(verb: Column) -> Column:
    """Without the letters of "ed", "ing" and "s" at its end, as sets of letters."""
    return F.rtrim(F.rtrim(F.rtrim(verb, F.lit("ed")), F.lit("ing")), F.lit("s"))


def verb_match(a: Column, b: Column) -> Column:
    """Equal, one in the other, equal stems, or synonyms."""
    known = F.create_map(*[F.lit(x) for kv in VERB_SYNONYMS.items() for x in kv])
    synonym = F.coalesce(F.try_element_at(known, a), F.lit("\u0000"))
    return (a == b) | a.contains(b) | b.contains(a) | ((stem(a) != "") & (stem(a) == stem(b))) | b.contains(synonym) | (synonym.contains(b) & (synonym != "\u0000"))


def triplet_matches(response: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The best source triplet of each response triplet (key, ord, subject, predicate, object) and the kind of match."""
    norm = lambda c: F.filter(F.split(T.squeezed(c), " "), lambda w: w != "")
    overlap = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(norm(a), norm(b))), F.least(F.size(F.array_distinct(norm(a))), F.size(F.array_distinct(norm(b))))), F.lit(0.0))
    s = source.select(key, F.col("ord").alias("s_ord"), *[F.col(c).alias(f"s_{c}") for c in ("subject", "predicate", "object")])
    j = response.join(s, key, "left")
    straight = (overlap(F.col("subject"), F.col("s_subject")) + overlap(F.col("object"), F.col("s_object"))) / 2
    crossed = (overlap(F.col("subject"), F.col("s_object")) + overlap(F.col("object"), F.col("s_subject"))) / 2
    j = j.withColumn("score", F.coalesce(F.greatest(straight, crossed), F.lit(0.0))).withColumn("same", overlap(F.col("predicate"), F.col("s_predicate")) >= 0.5)
    best = j.groupBy(key, "ord").agg(F.max_by(F.struct("score", "same"), F.struct("score", -F.coalesce("s_ord", F.lit(0)))).alias("b"))
    kind = F.when(F.col("b.score") < 0.3, "no_match").when(F.col("b.score") < 0.5, "partial").when(F.col("b.same"), "exact").otherwise("predicate_mismatch")
    return best.select(key, "ord", F.col("b.score").alias("score"), kind.alias("match"))


def index_profile(rows: DataFrame, value: str, points: list[float]) -> DataFrame:
    """(p, value): the element at place int(n p) of the sorted values, without interpolation."""
    n = rows.count()
    places = {p: int(n * p) for p in points} if n else {}
    exact = [F.percentile(value, F.lit(i / max(1, n - 1))).alias(f"p{k}") for k, i in enumerate(places.values())]
    if not exact:
        return rows.sparkSession.createDataFrame([], "p double, value double")
    one = rows.agg(*exact)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{k}").alias("value")) for k, p in enumerate(places)])).alias("x")).select("x.*")


# Fixed values of the extended lexical rules.
NEGATIONS = ("not", "no", "never", "neither", "nor", "nobody", "nothing", "nowhere", "n't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't", "shouldn't", "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "hadn't")
QUALIFIERS = ("all", "every", "always", "never", "none", "only", "first", "largest", "best", "worst")
NUMBER = r"\d[\d,]*\.?\d*"
NAME = r"(?<=[^.] )[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)*"


def extended_rules(sentence: Column, source: Column, source_sentences: Column) -> dict[str, Column]:
    """Signs that a sentence is grounded (entities, numbers, coverage) or suspect (number, entity, negation, qualifier).

    Entities are capitalised words that do not begin a sentence; numbers are compared without
    separators. Each rule that looks at single source sentences asks for one that holds it all:
    two of the entities, a number with an entity, or six shared words with another negation.
    """
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    names = F.transform(F.regexp_extract_all(sentence, F.lit(NAME), F.lit(0)), F.lower)
    content = lambda t: F.array_distinct(T.tokens(t, "[a-z]{3,}"))
    low = F.lower(source)
    negated = lambda t: F.arrays_overlap(F.split(F.lower(t), r"\s+"), F.array(*map(F.lit, NEGATIONS)))
    holds = lambda s, n: F.size(F.filter(n, lambda e: F.lower(s).contains(e)))
    own = F.struct(names.alias("names"), numbers(sentence).alias("numbers"), content(sentence).alias("content"), numbers(source).alias("known"))

    def judged(o: Column) -> Column:
        all_names, all_numbers = F.forall(o["names"], lambda e: low.contains(e)), F.forall(o["numbers"], lambda n: F.array_contains(o["known"], n))
        together = F.exists(source_sentences, lambda s: holds(s, o["names"]) >= 2)
        backed = F.forall(o["numbers"], lambda n: F.exists(source_sentences, lambda s: F.array_contains(numbers(s), n) & ((F.size(o["names"]) == 0) | (holds(s, o["names"]) > 0))))
        covered = (F.size(o["content"]) >= 3) & (F.coalesce(T.containment(o["content"], content(source)), F.lit(0.0)) >= 0.95)
        flipped = F.exists(source_sentences, lambda s: (F.size(F.array_intersect(o["content"], content(s))) >= 6) & (negated(s) != negated(sentence)))
        strong = F.exists(F.array(*map(F.lit, QUALIFIERS)), lambda w: F.concat(F.lit(" "), F.lower(sentence), F.lit(" ")).contains(F.concat(F.lit(" "), w, F.lit(" "))) & ~F.concat(F.lit(" "), low, F.lit(" ")).contains(F.concat(F.lit(" "), w, F.lit(" "))))
        return F.struct(
            ((F.size(o["names"]) >= 2) & all_names & together).alias("entities_together"), ((F.size(o["numbers"]) > 0) & all_numbers & backed).alias("numbers_backed"), covered.alias("covered"),
            (~all_numbers).alias("number_unknown"), (~all_names).alias("entity_unknown"), flipped.alias("negation_flipped"), strong.alias("qualifier_stronger"),
        )

    found = T.let(own, judged)
    return {n: found[n] for n in ("entities_together", "numbers_backed", "covered", "number_unknown", "entity_unknown", "negation_flipped", "qualifier_stronger")}


#: Phrases of claims.
CLAIMS = (
    r"(?i)(?:according to|studies show|research indicates|data shows|statistics show)",
    r"(?i)(?:it is (?:known|proven|established) that)",
    r"(?i)(?:the (?:official|published|documented) (?:number|figure|rate|data))",
    r"\d{1,3}(?:\.\d+)?%",
)


def ungrounded_claims(response: Column, context: Column, around: int = 30, least: float = 0.3) -> Column:
    """Claims whose surroundings, ``around`` characters to both sides, share too few tokens with the context."""
    own, total = T.bare_tokens(context, 2), F.lit(0)
    for p in CLAIMS:
        # A match with what stands around it, by where it begins: the text before each match is what the split leaves.
        def windows(x: Column) -> Column:
            start = lambda i: F.aggregate(F.slice(x["gaps"], 1, i + 1), F.lit(0), lambda acc, g: acc + F.length(g)) + F.aggregate(F.slice(x["hits"], 1, i), F.lit(0), lambda acc, h: acc + F.length(h))
            return F.transform(x["hits"], lambda h, i: F.substring(x["text"], F.greatest(start(i) - around, F.lit(0)) + 1, F.least(start(i), F.lit(around)) + F.length(h) + around))

        found = T.let(F.struct(response.alias("text"), F.split(response, p, -1).alias("gaps"), F.regexp_extract_all(response, F.lit(p), F.lit(0)).alias("hits")), windows)
        total = total + F.size(F.filter(found, lambda w: F.size(F.array_intersect(T.bare_tokens(w, 2), own)) < F.size(T.bare_tokens(w, 2)) * least))
    return total
