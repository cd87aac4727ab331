"""Tables in their roles: cases from conversations and documents, runs and events; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): assistant turns right after a user's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("answer"), F.lag("role").over(w).alias("_r"), F.lag("text").over(w).alias("question"))
    return rows.where("role = 'assistant' and _r = 'user'").select("conv_id", "turn", "question", "answer")


PAIRS = """pairs AS (SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn, role, text AS answer, lag(role) OVER w AS r, lag(text) OVER w AS question
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user')"""


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, question, answer): a document's first line asks, the whole text answers."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"), F.col("text").alias("answer"))


DOCUMENT_CASES = "cases AS (SELECT doc_id, source, lang, split_part(text, chr(10), 1) AS question, text AS answer FROM documents)"


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, human_decision): pass where good and not toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("fail").alias("human_decision"))


HUMAN = "human AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' ELSE 'fail' END AS human_decision FROM labels)"


def governance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the roles of a governance log: (event_id, ts, type, actor, related, k, value)."""
    kinds = {"error": "drift_alert", "purchase": "baseline_promotion", "signup": "dataset_registration", "click": "rule_change", "view": "eval_run"}
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(names, F.col("event_type")).alias("type"), F.col("user_id").alias("actor"), k.alias("k"), "value")
    return rows.withColumn("related", F.create_map(F.lit("user"), F.col("actor").cast("string"), F.lit("k"), F.col("k").cast("string")))


GOVERNANCE = """gov AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'drift_alert' WHEN 'purchase' THEN 'baseline_promotion'
  WHEN 'signup' THEN 'dataset_registration' WHEN 'click' THEN 'rule_change' WHEN 'view' THEN 'eval_run' END AS type,
  user_id AS actor, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)"""


def apart(sql: str) -> str:
    """SQL in which every mark is doubled, for patterns that name the marks around a word (RE2 has no look-around)."""
    return rf"regexp_replace(' ' || {sql} || ' ', '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"


def words_pattern(alternatives: str) -> str:
    """A whole-word pattern for :func:`apart` text."""
    return rf"(?i)[^\p{{L}}\p{{N}}_](?:{alternatives})[^\p{{L}}\p{{N}}_]"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def ratio(a: str, b: str) -> str:
    """SQL of a quotient of doubles, 0.0 where b is 0."""
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    """SQL of precision, recall and f1."""
    p, r = ratio(tp, f"({tp} + {fp})"), ratio(tp, f"({tp} + {fn})")
    return f"{p} AS precision, {r} AS recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0) AS f1"
