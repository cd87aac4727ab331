"""Event logs as streams: windows, pairing of starts and ends, correlation, issue states, alerts.

Functions take and give streaming DataFrames (batch ones work too, where the plan allows it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.drift import TRANSITIONS


def tumbling(events: DataFrame, width: str, by: list[str], value: Column, late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) of windows that follow one another."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """(start, by, n) of windows that overlap."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """(start, by, n) of runs of events that lie less than ``gap`` apart."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by)
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def paired(starts: DataFrame, ends: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Starts (key, ts) with the end of their key that follows within a time, null where none did; an interval join of two streams."""
    a = starts.withWatermark("ts", late).select(key, F.col("ts").alias("start_ts"))
    b = ends.withWatermark("ts", late).select(F.col(key).alias("_k"), F.col("ts").alias("end_ts"))
    on = (F.col(key) == F.col("_k")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    return a.join(b, on, "leftOuter").drop("_k")


def correlated(alerts: DataFrame, changes: DataFrame, hours: int, bucket: Column | None = None) -> DataFrame:
    """Alerts (alert_id, ts) and changes (event_id, ts) at most ``hours`` apart, as both streams come."""
    late = f"{hours} hours"
    a = alerts.withWatermark("ts", late).select("alert_id", F.col("ts").alias("alert_ts"))
    b = changes.withWatermark("ts", late).select("event_id", F.col("ts").alias("change_ts"))
    near = F.col("change_ts").between(F.col("alert_ts") - F.expr(f"interval {hours} hours"), F.col("alert_ts") + F.expr(f"interval {hours} hours"))
    return a.join(b, near)


def issue_states(history: DataFrame, key: str) -> DataFrame:
    """Every step (key, seq, state) of an issue's history with accepted: whether the states so far allow it.

    A refused step does not change the state. Steps of a key must come in order of seq from
    batch to batch; within a batch they are sorted.
    """

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, to in zip(rows["seq"], rows["state"], strict=True):
            ok = to == "detected" if now is None else to in TRANSITIONS[now]
            now = to if ok else now
            out.append((k[0], seq, to, ok))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=[key, "seq", "state", "accepted"])

    kind = dict(history.dtypes)[key]
    return history.select(key, "seq", "state").groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, seq long, state string, accepted boolean", "now string", "append", GroupStateTimeout.NoTimeout)


def alert_sink(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that hands on batches that have rows, with their number; writing by that number makes it once."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(batch, number)

    return each


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a bounded stream gives, by way of a memory table: for tests and small logs."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
