"""Drift of metrics over runs: points against a baseline, trends over the last runs, causes and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(runs: DataFrame, n: int, by: list[str], at: str, tie: str) -> DataFrame:
    """The last ``n`` rows of each group by time, ties by another column."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def trend(runs: DataFrame, window: int, tolerance: float, metric: str = "metric", value: str = "value", at: str = "run_id") -> DataFrame:
    """(metric, oldest, newest, delta, ok) over the last ``max(2, window)`` runs; metrics with one run have no row."""
    last = newest(runs, max(2, window), [metric], at, value)
    ends = last.groupBy(metric).agg(F.min_by(value, at).alias("oldest"), F.max_by(value, at).alias("newest"), F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    delta = F.col("newest") - F.col("oldest")
    return ends.select(metric, "oldest", "newest", delta.alias("delta"), (delta >= -tolerance).alias("ok"))


def point(candidate: DataFrame, baseline: DataFrame, policy: DataFrame) -> DataFrame:
    """(metric, check, ok) for a policy (metric, least, tolerance): presence in both, a least value, a greatest drop."""
    j = policy.join(candidate.withColumnRenamed("value", "cand"), "metric", "left").join(baseline.withColumnRenamed("value", "base"), "metric", "left")
    both = F.col("cand").isNotNull() & F.col("base").isNotNull()
    checks = F.array(
        F.struct(F.lit("present").alias("check"), both.alias("ok")),
        F.struct(F.lit("least").alias("check"), F.when(both & F.col("least").isNotNull(), F.col("cand") >= F.col("least")).alias("ok")),
        F.struct(F.lit("drop").alias("check"), F.when(both & F.col("tolerance").isNotNull(), F.col("cand") - F.col("base") >= -F.col("tolerance")).alias("ok")),
    )
    return j.select("metric", F.explode(checks).alias("x")).select("metric", "x.*").where("ok is not null")


#: Alerts that share a block of numbered events.
BLOCK = 256


def correlate(alerts: DataFrame, events: DataFrame, hours: int, most: int) -> DataFrame:
    """Of (alert_id, alert_ts) and (event_id, ts, type): the ``most`` events within ``hours`` of each alert, nearest first.

    Of a moment's events the first ``most`` count. They are numbered in the order of time, by counts up to a bucket and a
    window inside it, and an alert is where it stands among them: what can be nearest to it has numbers from
    ``3 * most - 2`` below to ``most`` above. Events are gathered in blocks of numbers with such margins, so an alert
    meets one block, of which it takes a slice. Events are shuffled three times, results only where alerts share an id.
    Adds micros (signed) and rank.
    """
    width, back = hours * 3_600_000_000, 3 * most - 2
    few = events.withColumn("_at", F.unix_micros("ts")).where("_at is not null").drop("ts")
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("_at").orderBy("event_id"))).where(F.col("_n") <= most).drop("_n")
    rest, own = [c for c in few.columns if c not in ("_at", "event_id")], [c for c in alerts.columns if c != "alert_ts"]
    several = F.count(F.lit(1)).over(Window.partitionBy("alert_id")) > 1
    asked = alerts.withColumn("_at", F.unix_micros("alert_ts")).where("_at is not null").withColumn("_several", several)
    # Events as columns, which take less room in a shuffle than structs; alerts as one, null for events, so that both uses below share a shuffle.
    rows = few.select("_at", "event_id", *[F.col(c).alias(f"_event_{c}") for c in rest])
    rows = rows.unionByName(asked.select("_at", F.struct("_several", *own).alias("_alert")), allowMissingColumns=True)
    # A bucket that can't be null lets no join add a filter, which would keep uses from sharing the events' shuffle.
    rows = rows.withColumn("_b", F.coalesce(F.floor(F.col("_at") / max(1, width // 144)), F.lit(0)))
    before = rows.groupBy("_b").agg(F.count_if(F.col("_alert").isNull()).alias("_here"))
    before = before.select("_b", (F.sum("_here").over(Window.orderBy("_b")) - F.col("_here")).alias("_before"))
    order = Window.partitionBy("_b").orderBy("_at", F.col("_alert").isNotNull(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.count_if(F.col("_alert").isNull()).over(order)).join(before, "_b").withColumn("_number", F.col("_before") + F.col("_in"))
    block = lambda n: F.floor(n / BLOCK)
    blocks = F.sequence(F.greatest(F.lit(0), block(F.col("_number") - most)), block(F.col("_number") + back))
    event = F.struct("_at", "event_id", *[F.col(f"_event_{c}").alias(c) for c in rest]).alias("_event")
    blocks = rows.where("_alert is null").select(F.explode(blocks).alias("_block"), event).groupBy("_block").agg(F.sort_array(F.collect_list("_event")).alias("_events"))
    wanted = rows.where("_alert is not null").select(block(F.col("_number")).alias("_block"), "_number", F.col("_at").alias("_alert_at"), "_alert")
    least = F.greatest(F.lit(1), F.col("_number") - back)
    first = least - F.greatest(F.lit(1), F.col("_block") * BLOCK - back) + 1
    met = F.slice("_events", first.cast("int"), (F.col("_number") + most + 1 - least).cast("int"))
    micros = lambda e: e["_at"] - F.col("_alert_at")
    met = F.transform(met, lambda e: F.struct(F.abs(micros(e)).alias("_apart"), e["event_id"].alias("_id"), micros(e).alias("micros"), e.alias("_event")))
    met = F.slice(F.sort_array(F.filter(met, lambda e: e["_apart"] <= width)), 1, most)
    near = wanted.join(blocks, "_block").select("_alert_at", "_alert", F.posexplode(met).alias("_rank", "_met"))
    columns = [F.timestamp_micros("_alert_at").alias(c) if c == "alert_ts" else F.col("_alert")[c].alias(c) for c in alerts.columns]
    columns += [(F.timestamp_micros("_met._event._at") if c == "ts" else F.col("_met._event")[c]).alias(c) for c in events.columns]
    near = near.select(*columns, F.col("_met.micros").alias("micros"), (F.col("_rank") + 1).alias("rank"), "_alert._several")
    # Ranks of alerts that share an id go on from one to the other, so these are ranked together.
    w = Window.partitionBy("alert_id").orderBy(F.abs("micros"), "event_id")
    shared = near.where("_several").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return near.where("not _several").unionByName(shared).drop("_several")


def causation(micros: Column) -> tuple[Column, Column]:
    """(position, confidence) of an event against an alert: before if earlier, and high under 2 h, medium under 12 h."""
    hours = F.abs(micros)
    return F.when(micros < 0, "before").otherwise("after"), F.when(hours < 2 * 3_600_000_000, "high").when(hours < 12 * 3_600_000_000, "medium").otherwise("low")


def response(message: Column, actions: dict[str, str]) -> Column:
    """The action of the first policy metric that a message names; log without one; unknown actions warn."""
    found = F.lit("log")
    for metric, action in reversed(actions.items()):
        found = F.when(message.contains(metric), action if action in ("block", "warn", "log") else "warn").otherwise(found)
    return found


def heartbeat(events: DataFrame, now: Column, hours: float, kind: str = "eval_run") -> DataFrame:
    """One row: the last event of a kind, and whether it is at most ``hours`` before ``now``; none is not."""
    last = events.where(F.col("type") == kind).agg(F.max("ts").alias("last"))
    return last.select("last", F.coalesce(F.unix_micros(now) - F.unix_micros("last") <= int(hours * 3_600_000_000), F.lit(False)).alias("ok"))


#: The states of an issue, and where each may go.
TRANSITIONS = {"detected": ("triaged", "resolved"), "triaged": ("responding", "resolved"), "responding": ("resolved", "triaged"), "resolved": ()}


def invalid_transitions(history: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """Steps of an append-only history that the states don't allow: (key, seq, from, to). The first must be detected."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = history.select(key, seq, F.lag(state).over(w).alias("from"), F.col(state).alias("to"))
    allowed = (F.col("from").isNull() & (F.col("to") == "detected"))
    for a, after in TRANSITIONS.items():
        if after:
            allowed = allowed | ((F.col("from") == a) & F.col("to").isin(*after))
    return rows.where(~F.coalesce(allowed, F.lit(False)))
