"""Events to subscribers as streams, the progress of a run, and a lost heartbeat."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], None]


def publish(events: DataFrame, log: str) -> None:
    """Adds events (event_type, ...) to the log that subscribers read; an append is whole or not there."""
    events.write.mode("append").parquet(log)


def subscribe(spark: SparkSession, log: str, schema: str, pattern: str, handler: Handler, checkpoint: str, *, errors: list[str] | None = None, **trigger) -> StreamingQuery:
    """A stream of the log's events whose type is ``pattern``, or begins with it up to a ``*``, to a handler of batches.

    Each subscriber has its own checkpoint, so one does not wait for another and none misses events
    that came while it was down. A handler that raises loses its batch, is noted in ``errors``, and goes on.
    """
    kind = F.col("event_type")
    wanted = F.lit(True) if pattern == "*" else kind.startswith(pattern[:-1]) if pattern.endswith("*") else kind == pattern

    def each(batch: DataFrame, number: int) -> None:
        try:
            handler(batch, number)
        except Exception as e:
            if errors is not None:
                errors.append(f"{pattern}: {e}")

    stream = spark.readStream.schema(schema).parquet(log).where(wanted)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(query: StreamingQuery) -> Mapping[str, float]:
    """Rows seen so far, and rows a second of the last batch, 0.0 before the first."""
    seen = query.recentProgress
    last = seen[-1] if seen else {}
    return {"rows": sum(p["numInputRows"] for p in seen), "rows_per_second": float(last.get("processedRowsPerSecond") or 0.0)}


def silent(beats: DataFrame, key: str, ts: str, at: str, every_s: int, missed: int = 3) -> DataFrame:
    """(key, last, beats, status) of keys by their last beat before ``at``: alive, late after one interval, lost after ``missed``.

    It serves a table and, with a watermark on ``ts``, a stream in update mode alike.
    """
    last = F.max(ts)
    age = F.unix_timestamp(F.lit(at).cast("timestamp")) - F.unix_timestamp(last)
    status = F.when(age > every_s * missed, "lost").when(age > every_s, "late").otherwise("alive")
    return beats.groupBy(key).agg(last.alias("last"), F.count(F.lit(1)).alias("beats"), status.alias("status"))
