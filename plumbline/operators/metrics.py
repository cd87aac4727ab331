"""Metrics of runs: confusion, agreement, slices, hit rates, calibration, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats as S


def label(c: Column) -> Column:
    """"pass" or "fail" as they stand; anything else is null."""
    return F.when(c.isin("pass", "fail"), c)


def confusion(rows: DataFrame, human: str, judge: str, by: tuple[str, ...] = (), positive: str = "fail") -> DataFrame:
    """tp, fp, fn, tn by groups; rows where either label is neither pass nor fail are left out."""
    h, j = label(F.col(human)), label(F.col(judge))
    is_h, is_j = h == positive, j == positive
    count = lambda c: F.count_if(c)
    return rows.groupBy(*by).agg(count(is_h & is_j).alias("tp"), count(~is_h & is_j).alias("fp"), count(is_h & ~is_j).alias("fn"), count(~is_h & ~is_j).alias("tn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    p, r = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", S.f1(F.col("precision"), F.col("recall")))


def bundle(rows: DataFrame, human: str = "human_decision", judge: str = "judge_decision") -> DataFrame:
    """One row: n_total, n_scored, accuracy, kappa, and precision, recall and f1 of both labels."""
    h, j = label(F.col(human)), label(F.col(judge))
    cell = lambda a, b: F.count_if((h == a) & (j == b))
    c = rows.agg(F.count(F.lit(1)).alias("n_total"), cell("pass", "pass").alias("pp"), cell("pass", "fail").alias("pf"), cell("fail", "pass").alias("fp"), cell("fail", "fail").alias("ff"))
    pp, pf, fp, ff = (F.col(x) for x in ("pp", "pf", "fp", "ff"))
    n = pp + pf + fp + ff
    c = c.withColumns({"n_scored": n, "accuracy": F.try_divide((pp + ff).cast("double"), n.cast("double")), "cohen_kappa": S.kappa(pp, pf, fp, ff)})
    c = c.withColumns({"precision_fail": S.ratio(ff, ff + pf), "recall_fail": S.ratio(ff, ff + fp), "precision_pass": S.ratio(pp, pp + fp), "recall_pass": S.ratio(pp, pp + pf)})
    c = c.withColumns({f"f1_{x}": S.f1(F.col(f"precision_{x}"), F.col(f"recall_{x}")) for x in ("fail", "pass")})
    return c.drop("pp", "pf", "fp", "ff")


def by_slice(rows: DataFrame, human: str, judge: str, slices: tuple[str, ...]) -> DataFrame:
    """Confusion and rates overall and by each slice column alone: (slice, value, tp, ...). Missing predictions count as pass."""
    rows = rows.select(human, F.coalesce(F.col(judge), F.lit("pass")).alias(judge), *slices)
    pairs = [F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]]
    each = rows.withColumn("_s", F.explode(F.array(*pairs))).select("_s.*", human, judge)
    return with_rates(confusion(each, human, judge, ("slice", "value")))


def hit_rates(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """(rule, hits, rate): flags by the id before the colon, each flag counted, over all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    hits = rows.select(F.explode(flags).alias("flag")).groupBy(F.split_part("flag", F.lit(":"), F.lit(1)).alias("rule")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(F.broadcast(total)).select("rule", "hits", S.ratio(F.col("hits"), F.col("n")).alias("rate"))


def fire_rates(rows: DataFrame, properties: list[str]) -> DataFrame:
    """(property, passed, failed, total) of columns that hold pass or fail."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"`{p}`").alias("decision")) for p in properties]))
    long = rows.select(pairs.alias("x")).select("x.*")
    return long.groupBy("property").agg(F.count_if(F.col("decision") == "pass").alias("passed"), F.count_if(F.col("decision") == "fail").alias("failed"), F.count(F.lit(1)).alias("total"))


def calibration(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(dimension, n, within_one, exact, mean_delta) of human and judge scores by dimension."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(h).cast("int").alias("h"), F.col(j).cast("int").alias("j")) for d, (h, j) in pairs.items()]))
    long = rows.select(each.alias("x")).select("x.*").where("h is not null and j is not null")
    d = F.col("j") - F.col("h")
    return long.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), S.ratio(F.count_if(F.abs(d) <= 1), F.count(F.lit(1))).alias("within_one"), S.ratio(F.count_if(d == 0), F.count(F.lit(1))).alias("exact"), S.ratio(F.sum(d), F.count(F.lit(1))).alias("mean_delta"))


def agreement(rows: DataFrame, human: str, judge: str, by: tuple[str, ...]) -> DataFrame:
    """exact, within 1 and 2, higher, lower, equal, and tier (ready from 70 % within 1, partly from 50 %)."""
    d = F.col(judge) - F.col(human)
    n, one = F.count(F.lit(1)), F.count_if(F.abs(d) <= 1)
    tier = F.when(S.ratio(100 * one, n) >= 70, "validated").when(S.ratio(100 * one, n) >= 50, "developing").otherwise("experimental")
    return rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).groupBy(*by).agg(
        n.alias("n"), F.count_if(d == 0).alias("exact"), one.alias("within_1"), F.count_if(F.abs(d) <= 2).alias("within_2"),
        F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"), tier.alias("tier"),
    )


def bias_direction(agreements: DataFrame) -> DataFrame:
    """lenient where higher > 1.5 lower, strict the other way round, else balanced; insufficient below 3."""
    hi, lo = F.col("higher"), F.col("lower")
    return agreements.withColumn("bias", F.when(F.col("n") < 3, "insufficient").when(hi > 1.5 * lo, "lenient").when(lo > 1.5 * hi, "strict").otherwise("balanced"))


def funnel(rows: DataFrame, order: dict[str, int], layer: str = "layer", cleared: str = "cleared", wrong: str = "violation") -> DataFrame:
    """By layer in order: cleared, violations, their running sums, precision (1.0 without violations) and recall over all rows."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    ordinal = F.coalesce(*[F.when(F.col(layer) == k, v) for k, v in order.items()])
    by = rows.withColumn("ord", ordinal).where("ord is not null").groupBy(layer, "ord").agg(F.count_if(F.col(cleared)).alias("cleared"), F.count_if(F.col(cleared) & F.col(wrong)).alias("violations"))
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumns({"cum_cleared": F.sum("cleared").over(w), "cum_violations": F.sum("violations").over(w)}).crossJoin(F.broadcast(n))
    precision = F.when(F.col("cum_violations") == 0, 1.0).otherwise(S.ratio(F.col("cum_cleared") - F.col("cum_violations"), F.greatest(F.lit(1), F.col("cum_cleared"))))
    return by.select(layer, "cleared", "violations", "cum_cleared", "cum_violations", precision.alias("cum_precision"), S.ratio(F.col("cum_cleared"), F.greatest(F.lit(1), F.col("total"))).alias("cum_recall"))


def last_by(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by a sequence number, whichever way rows are dealt."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), seq).alias("_r")).select("_r.*")


def monotone(bins: DataFrame, order: str, value: str) -> DataFrame:
    """One row (bins, monotonic, decision): whether no bin's value is under that of the one before it; bins are few."""
    before = F.lag(value).over(Window.orderBy(order))
    rows = bins.withColumn("_ok", F.coalesce(F.col(value) >= before, F.lit(True)))
    ok = F.coalesce(F.bool_and("_ok"), F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("bins"), ok.alias("monotonic"), F.when(ok, "pass").otherwise("fail").alias("decision"))
