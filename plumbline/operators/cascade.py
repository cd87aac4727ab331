"""The layers behind lexical clearing: entailment, counted facts, a model's verdict, and the driver over them.

Models are plug-ins, functions from DataFrame to DataFrame, that see only the rows no cheaper
layer has resolved. Stand-ins are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats as S
from plumbline.functions import text as T

#: A layer looks at unresolved rows and returns them with ``verdict``: clear, flagged or null (not resolved).
Layer = Callable[[DataFrame], DataFrame]


def driver(sentences: DataFrame, cleared: Column, layers: Sequence[tuple[str, Layer]], *, first: str = "L1", stop_after: str | None = None) -> DataFrame:
    """``sentences`` with resolved_by and supported: the first layer by words, then each layer on what is left.

    A row that a layer calls clear is done. A flagged one goes on and keeps the flag unless a later
    layer clears it. ``stop_after`` names the last layer that runs; what no layer resolves is unsupported.
    """
    state = sentences.withColumns({"resolved_by": F.when(cleared, first), "flagged_by": F.lit(None).cast("string")})
    for name, layer in layers if stop_after != first else []:
        done, left = state.where("resolved_by is not null"), state.where("resolved_by is null")
        seen = layer(left)
        seen = seen.withColumns({"resolved_by": F.when(F.col("verdict") == "clear", name), "flagged_by": F.when(F.col("verdict") == "flagged", name).otherwise(F.col("flagged_by"))})
        state = done.unionByName(seen.drop("verdict"))
        if name == stop_after:
            break
    resolved = F.coalesce("resolved_by", F.concat("flagged_by", F.lit("_flagged")), F.lit("unresolved"))
    return state.select("*", F.col("resolved_by").isNotNull().alias("supported")).withColumn("resolved_by", resolved).drop("flagged_by")


def risk(resolved: DataFrame, key: list[str]) -> DataFrame:
    """By case: sentences, unsupported, ratio of supported ones, and risk, 0.0 if all are supported, else 0.5 and half the unsupported share."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("supported"))
    out = F.when(bad == 0, 0.0).otherwise(0.5 + 0.5 * S.ratio(bad, n))
    return resolved.groupBy(*key).agg(n.alias("sentences"), bad.alias("unsupported"), S.ratio(n - bad, n).alias("ratio"), out.alias("risk"))


def entailment(score: Callable[[Column, Column], Column], sentence: str, premises: str, similarity: Callable[[Column, Column], Column], *, most: int = 3, least: float = 0.7) -> Layer:
    """A layer that clears a sentence if one of its ``most`` most similar premises entails it with over ``least``.

    ``score`` and ``similarity`` are Columns of two texts, of a model or of a stand-in; ties go to the earlier premise.
    """

    def layer(rows: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.transform(premises, lambda p, i: F.struct((-similarity(F.col(sentence), p)).alias("far"), i.alias("at"), p.alias("premise"))))
        top = F.slice(ranked, 1, most)
        best = F.array_max(F.transform(top, lambda x: score(F.col(sentence), x["premise"])))
        return rows.withColumn("verdict", F.when(best > least, "clear"))

    return layer


def containment_score(sentence: Column, premise: Column) -> Column:
    """Share of a sentence's words that a premise has, a stand-in for a model of entailment."""
    words = lambda t: F.array_distinct(T.tokens(t, r"[\p{L}\p{N}_]+"))
    return F.coalesce(T.containment(words(sentence), words(premise)), F.lit(0.0))


#: What a model that counts facts calls them.
STATUSES = ("supported", "not_found", "contradicted", "shifted", "inferred")


def fact_counts(reply: Column, *, enough: float = 0.80) -> dict[str, Column]:
    """Of a model's JSON reply: the counts of facts by status, total, ratio of supported ones (3 digits), auto_clear, verdict and error.

    The reply may stand in a code fence, and a comma before a closing bracket is passed over. The total
    is the sum of the counts unless all are 0. A verdict that is neither GROUNDED nor HALLUCINATED
    follows the ratio. What is no JSON object is an error, which clears nothing.
    """
    text = F.regexp_replace(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")
    # An object with none of the names is sound JSON, so soundness is asked apart.
    sound = F.try_parse_json(text).isNotNull() & (text != "")
    x = F.from_json(F.when(sound, text).otherwise("{}"), ", ".join(f"{n} int" for n in (*STATUSES, "total")) + ", verdict string")
    counts = {n: F.coalesce(x[n], F.lit(0)) for n in STATUSES}
    summed = sum(counts.values(), F.lit(0))
    total = F.when(summed > 0, summed).otherwise(F.coalesce(x["total"], F.lit(0)))
    ratio = F.when(total > 0, F.round(F.try_divide(counts["supported"].cast("double"), total), 3)).otherwise(0.0)
    clear = sound & (ratio >= enough)
    said = F.upper(x["verdict"])
    verdict = F.when(~sound, None).when(said.isin("GROUNDED", "HALLUCINATED"), said).when(clear, "GROUNDED").otherwise("HALLUCINATED")
    return counts | {"total": total, "ratio": ratio, "auto_clear": clear, "verdict": verdict, "error": ~sound}


def model_verdict(reply: Column, error: Column, has_key: bool = True) -> Column:
    """Whether a model's words count a sentence as supported: an error does, no key and unclear words do not."""
    if not has_key:
        return F.lit(False)
    low = F.lower(F.coalesce(reply, F.lit("")))
    said = F.when(low.rlike(r"\b(?:unsupported|not supported|contradicted)\b"), False).when(low.rlike(r"\bsupported\b"), True).otherwise(False)
    return F.when(F.coalesce(error, F.lit(False)), True).otherwise(said)


def _best(texts: Column, sentences: Column, similarity: Callable[[Column, Column], Column]) -> Column:
    """The highest similarity of each text to one of the sentences, null if there are none."""
    return F.transform(texts, lambda w: F.array_max(F.transform(sentences, lambda s: similarity(w, s))))


def similarities(response: Column, context: Column, embed: Callable[[Column], Column]) -> Column:
    """The best cosine of each response sentence with a context sentence; null without context sentences."""
    vectors = lambda text: F.transform(T.sentences(text), lambda s: embed(s))
    both = F.struct(vectors(response).alias("r"), vectors(context).alias("c"))
    return T.let(both, lambda x: F.when(F.size(x["c"]) > 0, F.transform(x["r"], lambda v: F.array_max(F.transform(x["c"], lambda w: S.cosine(v, w))))))


def attribution(response: Column, context: Column, patterns: Sequence[str], similarity: Callable[[Column, Column], Column], *, around: int = 100, supported: float = 0.6, contradicted: float = 0.3) -> dict[str, Column]:
    """checked, supported, contradicted, neutral citations and a decision: fail if one is contradicted or more than half are neutral.

    A citation with ``around`` characters to both sides is held against every sentence of the context.
    Without context sentences all are neutral, and that fails; without citations it passes.
    """
    windows = F.array().cast("array<string>")
    for p in patterns:
        found = T.let(
            F.struct(response.alias("text"), F.split(response, p, -1).alias("gaps"), F.regexp_extract_all(response, F.lit(p), F.lit(0)).alias("hits")),
            lambda x: F.transform(x["hits"], lambda h, i: F.trim(F.substring(x["text"], F.greatest(_start(x, i) - around, F.lit(0)) + 1, F.least(_start(x, i), F.lit(around)) + F.length(h) + around))),
        )
        windows = F.concat(windows, F.filter(found, lambda w: w != ""))

    def counted(s: Column) -> Column:
        n = F.size(s)
        yes, no = F.size(F.filter(s, lambda v: F.coalesce(v >= supported, F.lit(False)))), F.size(F.filter(s, lambda v: F.coalesce(v <= contradicted, F.lit(False))))
        fails = (no > 0) | (2 * (n - yes - no) > n)
        return F.struct(n.alias("checked"), yes.alias("supported"), no.alias("contradicted"), (n - yes - no).alias("neutral"), F.when(fails, "fail").otherwise("pass").alias("decision"))

    out = T.let(_best(windows, T.sentences(context), similarity), counted)
    return {c: out[c] for c in ("checked", "supported", "contradicted", "neutral", "decision")}


def fabrication(response: Column, context: Column, similarity: Callable[[Column, Column], Column], *, least: float = 0.3) -> dict[str, Column]:
    """checked sentences of a response, suspects (whose best context sentence is under ``least``), mean_best and a decision.

    Without context sentences all are suspects; without response sentences there are none, and the mean is 1.0.
    """

    def counted(s: Column) -> Column:
        best = F.transform(s, lambda v: F.coalesce(v, F.lit(0.0)))
        suspects = F.size(F.filter(s, lambda v: F.coalesce(v < least, F.lit(True))))
        mean = F.when(F.size(s) == 0, 1.0).otherwise(S.ratio(F.aggregate(best, F.lit(0.0), lambda a, v: a + v), F.size(s)))
        return F.struct(F.size(s).alias("checked"), suspects.alias("suspects"), F.round(mean, 4).alias("mean_best"), F.when(suspects > 0, "fail").otherwise("pass").alias("decision"))

    out = T.let(_best(T.sentences(response), T.sentences(context), similarity), counted)
    return {c: out[c] for c in ("checked", "suspects", "mean_best", "decision")}


def _start(x: Column, i: Column) -> Column:
    """Where the i-th hit begins, by the lengths of what stands before it."""
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda acc, g: acc + F.length(g))
    return total(F.slice(x["gaps"], 1, i + 1)) + total(F.slice(x["hits"], 1, i))


def extracted(sources: DataFrame, key: str, passes: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, pass, facts) of distinct sources: each pass is a provider that adds ``facts`` (an array of texts) to the rows.

    A source that repeats is asked about once. ``verify`` sees all facts at the end and drops the unsound ones.
    """
    once, out = sources.dropDuplicates([key]), None
    for name, provider in passes:
        found = provider(once).select(key, F.lit(name).alias("pass"), F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))
        out = found if out is None else out.unionByName(found)
    return verify(out) if verify else out


def normalized_facts(table: Column, fields: Sequence[str]) -> Column:
    """A fact table's JSON with bare strings of these fields as objects {"text": ...}; what is neither is dropped.

    The result is a map from field to an array of (text, negated).
    """

    def one(field: str) -> Column:
        items = F.from_json(F.get_json_object(table, f"$.{field}"), "array<string>")
        parsed = lambda i: F.from_json(i, "text string, negated boolean")
        row = lambda i: F.when(i.startswith("{"), F.struct(parsed(i)["text"].alias("text"), F.coalesce(parsed(i)["negated"], F.lit(False)).alias("negated"))).otherwise(F.struct(i.alias("text"), F.lit(False).alias("negated")))
        sound = F.filter(F.transform(items, row), lambda x: F.coalesce(F.trim(x["text"]) != "", F.lit(False)))
        return F.coalesce(sound, F.array().cast("array<struct<text:string,negated:boolean>>"))

    return F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(one, fields)))


#: The grids of the sweeps.
SIMILARITIES = tuple(x / 100 for x in range(20, 81, 5))
RATIOS = tuple(x / 10 for x in range(1, 8))
THREE = {
    "similarities": tuple(x / 100 for x in range(15, 61, 5)),
    "ratios": tuple(x / 10 for x in range(3, 10)),
    "least": tuple(x / 100 for x in range(10, 51, 5)),
}


def sweep_points() -> list[tuple]:
    """(strategy, similarity, ratio, least) of ratio_only, min_sim_only and dual."""
    s, r, m = THREE["similarities"], THREE["ratios"], THREE["least"]
    return [("ratio_only", a, b, None) for a in s for b in r] + [("min_sim_only", None, None, c) for c in m] + [("dual", a, b, c) for a in s for b in r for c in m]


def swept(cases: DataFrame, points: Sequence[tuple], similarities: str, expected: str) -> DataFrame:
    """(strategy, similarity, ratio, least, tp, fp, fn, tn, precision, recall, f1, fire_rate) of all points in one pass.

    A case has the best similarity of each of its sentences. It is flagged where the share of those of
    at least ``similarity`` is under ``ratio``, or the smallest is under ``least``; a null looks away.
    ``expected`` is true for bad cases. Shares are made once for each similarity, and counts are partial sums.
    """
    levels = sorted({p[1] for p in points if p[1] is not None})
    share = lambda level: S.ratio(F.size(F.filter(similarities, lambda v: v >= level)), F.size(F.col(similarities)))
    made = cases.select(F.array(*[share(x) for x in levels]).alias("shares"), F.array_min(similarities).alias("smallest"), F.col(expected).alias("bad"))
    grid = [F.struct(F.lit(s).alias("strategy"), F.lit(a).cast("double").alias("similarity"), F.lit(levels.index(a) if a is not None else None).cast("int").alias("at"), F.lit(b).cast("double").alias("ratio"), F.lit(c).cast("double").alias("least")) for s, a, b, c in points]
    rows = made.select("*", F.explode(F.array(*grid)).alias("g")).select("shares", "smallest", "bad", "g.*")
    flagged = F.coalesce(F.get("shares", F.col("at")) < F.col("ratio"), F.lit(False)) | F.coalesce(F.col("smallest") < F.col("least"), F.lit(False))
    bad = F.col("bad")
    key = ["strategy", "similarity", "ratio", "least"]
    counts = rows.groupBy(*key).agg(F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn)
    return counts.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(S.f1(precision, recall), 4), "fire_rate": F.round(S.ratio(tp + fp, tp + fp + fn + tn), 4)})


def best_points(sweep: DataFrame) -> DataFrame:
    """The point of each strategy with the highest F1; ties go to the smaller thresholds."""
    low = lambda c: -F.coalesce(c, F.lit(-1.0))
    order = F.struct("f1", low("similarity"), low("ratio"), low("least"))
    return sweep.groupBy("strategy").agg(F.max_by(F.struct("similarity", "ratio", "least", "f1", "fire_rate"), order).alias("p")).select("strategy", "p.*")
