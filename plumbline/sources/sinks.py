"""DataFrames into files: append-only logs, runs that are whole once their manifest is there, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log that is never changed; Spark's committer makes each append all or nothing."""
    rows.write.mode("append").parquet(path)


def write_run(folder: str, facts: DataFrame, metrics: DataFrame, manifest: DataFrame) -> None:
    """Facts, then metrics, then the manifest, whose presence says that the rest is whole."""
    facts.write.mode("errorifexists").parquet(f"{folder}/judgments")
    metrics.write.mode("errorifexists").parquet(f"{folder}/metrics")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")


def publish_snapshot(rows: DataFrame, root: str, suite: str, rubric: str, snapshot: str, at: str, overwrite: bool = False) -> None:
    """A baseline's rows, then a row in the log of pointers; an existing snapshot is an error unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{root}/snapshots/suite={suite}/rubric={rubric}/id={snapshot}")
    pointer = rows.sparkSession.createDataFrame([(suite, rubric, snapshot, at)], "suite string, rubric string, snapshot string, at string")
    append(pointer, f"{root}/latest")


def latest_snapshot(pointers: DataFrame) -> DataFrame:
    """(suite, rubric, snapshot) that each pair points to last."""
    return pointers.groupBy("suite", "rubric").agg(F.max_by("snapshot", F.struct("at", "snapshot")).alias("snapshot"))


def alerts(rows: DataFrame) -> DataFrame:
    """Alerts (ts, type, title, ...) with an id, the first 12 hex digits of a SHA-256 of those three."""
    return rows.withColumn("alert_id", F.substring(F.sha2(F.concat(F.col("ts").cast("string"), "type", "title"), 256), 1, 12))
