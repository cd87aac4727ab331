"""Append-only logs: event queries, rollups by capability, queues, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import stats as S


def query_events(events: DataFrame, *, kind: str | None = None, since: Column | None = None, until: Column | None = None, key: str | None = None, value: str | None = None) -> DataFrame:
    """Events of a type, in a closed range of time, whose related ids have a key, with a value; what is None is not asked."""
    if kind is not None:
        events = events.where(F.col("type") == kind)
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if key is not None:
        events = events.where(F.map_contains_key("related", F.lit(key)))
    if value is not None:
        events = events.where(F.try_element_at("related", F.lit(key)) == value)
    return events


def capability_rollup(rows: DataFrame, by: str, ok: Column, duration: Column) -> DataFrame:
    """n, success rate, mean and 95th percentile of durations by capability."""
    n = F.count(F.lit(1))
    return rows.groupBy(by).agg(n.alias("n"), S.ratio(F.count_if(ok), n).alias("success_rate"), S.ratio(F.sum(duration), n).alias("mean_ms"), S.pct(duration, 0.95).alias("p95_ms"))


def subcapability_rollup(rows: DataFrame, by: list[str], status: str = "status", success: str = "success") -> DataFrame:
    """started, completed, skipped, and successes among the completed over those started; other statuses are ignored."""
    s = F.col(status)
    started, won = F.count_if(s == "started"), F.count_if((s == "completed") & F.col(success))
    return rows.groupBy(*by).agg(started.alias("fired"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "skipped").alias("skipped"), S.ratio(won, started).alias("success_rate"))


def engagement(rows: DataFrame, key: str, known: list[str]) -> DataFrame:
    """Counts by a key, 0 for known ones without rows; unknown ones are left out."""
    ids = rows.sparkSession.createDataFrame([(k,) for k in known], f"{key} string")
    return F.broadcast(ids).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def outcomes(rows: DataFrame, error: Column, failed: Column) -> DataFrame:
    """Cases by outcome, where an error comes before a failure."""
    return rows.groupBy(F.when(error, "error").when(failed, "failure").otherwise("success").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Each key's last state of an append-only log."""
    return rows.groupBy(key).agg(*[F.max_by(c, seq).alias(c) for c in columns])


def queue_stats(states: DataFrame, state: str = "state", human: str = "human", judge: str = "judge") -> DataFrame:
    """One row: pending, claimed, resolved, and agreement over the resolved, null without any."""
    s = F.col(state)
    done = F.count_if(s == "resolved")
    agreed = F.count_if((s == "resolved") & (F.col(human) == F.col(judge)))
    return states.agg(*[F.count_if(s == x).alias(x) for x in ("pending", "claimed", "resolved")], F.try_divide(agreed.cast("double"), done.cast("double")).alias("agreement"))


def governance_drift(running: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(key, problem): running without being in the manifest, or in the manifest without running."""
    a = running.select(key).distinct().join(manifest, key, "left_anti").select(key, F.lit("ungoverned").alias("problem"))
    return a.union(manifest.select(key).distinct().join(running, key, "left_anti").select(key, F.lit("stale").alias("problem")))


def aging(rows: DataFrame, reviewed: Column, today: Column, limit: int) -> DataFrame:
    """Adds days since review, and stale over the limit (or never reviewed)."""
    days = F.date_diff(today, reviewed)
    return rows.withColumn("days", days).withColumn("stale", F.coalesce(F.col("days") > limit, F.lit(True)))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def integrity(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """One row: rows, blank keys, keys that repeat, and nulls or blanks of each required column."""
    blank = lambda c: F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[blank(c).alias(f"blank_{c}") for c in required])
    return counts.crossJoin(F.broadcast(duplicates(rows, key).agg(F.count(F.lit(1)).alias("repeated_keys"))))
