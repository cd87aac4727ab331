"""Comparing two runs, and the policies that hold the difference to account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import last_by


def pair(base: DataFrame, candidate: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Full outer join of two runs, the last row of each key: key, base and cand as structs, null where missing."""
    side = lambda df, name: last_by(df, key, seq).select(*key, F.struct(*df.columns).alias(name))
    return side(base, "base").join(side(candidate, "cand"), key, "full_outer")


def presence(pairs: DataFrame) -> DataFrame:
    """One row: keys only in the base, only in the candidate, in both."""
    return pairs.agg(F.count_if(F.col("cand").isNull()).alias("missing"), F.count_if(F.col("base").isNull()).alias("new"), F.count_if(F.col("base").isNotNull() & F.col("cand").isNotNull()).alias("common"))


def flips(pairs: DataFrame, key: list[str], decision: str = "decision") -> DataFrame:
    """Keys whose decision changed, with both."""
    b, c = F.col(f"base.{decision}"), F.col(f"cand.{decision}")
    return pairs.where(F.col("base").isNotNull() & F.col("cand").isNotNull() & ~b.eqNullSafe(c)).select(*key, b.alias("base_decision"), c.alias("cand_decision"))


def score_deltas(pairs: DataFrame, key: list[str], dimensions: tuple[str, ...]) -> DataFrame:
    """(key, dimension, delta) where a score of both runs changed."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(f"cand.{d}") - F.col(f"base.{d}")).alias("delta")) for d in dimensions]))
    return pairs.where(F.col("base").isNotNull() & F.col("cand").isNotNull()).select(*key, each.alias("x")).select(*key, "x.*").where("delta <> 0")


def flag_changes(pairs: DataFrame, key: list[str], flags: str = "flags") -> DataFrame:
    """(key, added, removed) where the sets of flags differ; null flags are none."""
    none = F.array().cast("array<string>")
    b, c = F.coalesce(F.col(f"base.{flags}"), none), F.coalesce(F.col(f"cand.{flags}"), none)
    rows = pairs.where(F.col("base").isNotNull() & F.col("cand").isNotNull())
    rows = rows.select(*key, F.array_sort(F.array_except(c, b)).alias("added"), F.array_sort(F.array_except(b, c)).alias("removed"))
    return rows.where((F.size("added") > 0) | (F.size("removed") > 0))


def long_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One wide row as (metric, value)."""
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


def metric_diff(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, base, cand, delta, status) of two long tables."""
    j = base.withColumnRenamed("value", "base").withColumn("_b", F.lit(True)).join(candidate.withColumnRenamed("value", "cand").withColumn("_c", F.lit(True)), "metric", "full_outer")
    status = F.when(F.col("_c").isNull(), "only_in_baseline").when(F.col("_b").isNull(), "only_in_candidate").otherwise("both")
    return j.select("metric", "base", "cand", (F.col("cand") - F.col("base")).alias("delta"), status.alias("status"))


def violations(diff: DataFrame, max_drop: dict[str, float]) -> DataFrame:
    """(metric, kind): drops over the tolerance, and metrics of the policy that one side lacks."""
    policy = diff.sparkSession.createDataFrame(sorted(max_drop.items()), "metric string, tolerance double")
    j = F.broadcast(policy).join(diff, "metric", "left")
    one = (F.col("base").isNull() != F.col("cand").isNull()) & F.col("status").isNotNull()
    kind = F.when(one, "missing").when(F.col("base") - F.col("cand") > F.col("tolerance"), "drop")
    return j.select("metric", kind.alias("kind")).where("kind is not null")
