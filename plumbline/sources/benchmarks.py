"""Benchmark files as cases: (case_id, query, response, context, expected, split), expected is pass or fail.

Adapters are functions of DataFrames; :data:`ADAPTERS` names them. A row may give several cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("case_id", "query", "response", "context", "expected")


def _expected(bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass")


def annotated_responses(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Responses with span labels, joined to their sources: fail with any span; unusable qualities and sourceless ones are left out."""
    usable = responses.where(~F.coalesce(F.col("quality"), F.lit("good")).isin("incorrect_refusal", "truncated"))
    j = usable.join(sources.select("source_id", F.col("prompt").alias("query"), F.col("source_info").cast("string").alias("context"), "task_type"), "source_id")
    kinds = F.array_sort(F.array_distinct(F.transform("labels", lambda x: x["label_type"])))
    return j.select(F.col("id").alias("case_id"), "query", "response", "context", _expected(F.size("labels") > 0).alias("expected"), "split", "task_type", "model", kinds.alias("label_types"))


def right_and_wrong(rows: DataFrame, key: str, query: str, context: str, right: str, wrong: str) -> DataFrame:
    """Two cases of each row: the right answer passes, the made-up one fails."""
    case = lambda kind, c, e: F.struct(F.concat_ws("_", F.col(key).cast("string"), F.lit(kind)).alias("case_id"), F.col(query).alias("query"), F.col(c).alias("response"), F.col(context).alias("context"), F.lit(e).alias("expected"))
    return rows.select(F.explode(F.array(case("right", right, "pass"), case("hallucinated", wrong, "fail"))).alias("x")).select("x.*")


def claims(rows: DataFrame) -> DataFrame:
    """Claims with a verdict and nested evidence (title in the third place): supported ones pass."""
    titles = F.array_distinct(F.transform(F.flatten("evidence"), lambda e: F.get(e, 2)))
    return rows.select(F.col("id").cast("string").alias("case_id"), F.lit("Is this claim true?").alias("query"), F.col("claim").alias("response"), F.array_join(F.array_compact(titles), " ").alias("context"), _expected(F.col("label") != "SUPPORTS").alias("expected"))


def comments(rows: DataFrame, threshold: float = 0.5, least: int = 10) -> DataFrame:
    """Comments with a toxicity from a CSV, as text: fail from the threshold on; shorter ones than ``least`` are left out."""
    value = F.col("toxicity").try_cast("double")
    return rows.where(F.length("comment_text") >= least).select(F.col("id").cast("string").alias("case_id"), F.lit("").alias("query"), F.col("comment_text").alias("response"), F.lit("").alias("context"), _expected(value >= threshold).alias("expected"))


def statements(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Statements of which the first label column that is there counts."""
    have = [F.col(c).try_cast("double") for c in ("prompt_label", "label", "toxicity_human", "toxicity_ai") if c in rows.columns]
    label = F.coalesce(*have) if have else F.lit(None).cast("double")
    return rows.select(F.col("id").cast("string").alias("case_id"), F.lit("").alias("query"), F.col("text").alias("response"), F.lit("").alias("context"), _expected(label >= threshold).alias("expected"))


def constraints(rows: DataFrame) -> DataFrame:
    """Prompts with instruction ids "family:kind"; adds the families."""
    families = F.array_distinct(F.transform("instruction_id_list", lambda i: F.split_part(i, F.lit(":"), F.lit(1))))
    return rows.select(F.col("key").cast("string").alias("case_id"), F.col("prompt").alias("query"), F.coalesce("response", F.lit("")).alias("response"), F.lit("").alias("context"), F.lit("pass").alias("expected"), families.alias("families"))


def dialogues(rows: DataFrame) -> DataFrame:
    """Dialogues as one case for each turn: roles alternate, a turn tagged as made up fails."""
    x = rows.select("dialog_id", F.posexplode("utterances").alias("turn", "u"))
    bad = F.array_contains("u.tags", "Hallucination")
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return x.select(F.concat_ws("_", F.col("dialog_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.col("u.history").alias("query"), F.col("u.response").alias("response"), F.col("u.knowledge").alias("context"), _expected(bad).alias("expected"), role.alias("role"))


def labelled(rows: DataFrame) -> DataFrame:
    """Cases with a map property -> label: one fail fails the response."""
    bad = F.exists(F.map_values("labels"), lambda v: v == "fail")
    return rows.select("case_id", "query", "response", F.col("source_context").alias("context"), _expected(bad).alias("expected"), "labels")


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"annotated": annotated_responses, "paired": right_and_wrong, "claims": claims, "comments": comments, "statements": statements, "constraints": constraints, "dialogues": dialogues, "labelled": labelled}


def register(name: str, adapter: Callable[..., DataFrame]) -> None:
    """Adds an adapter; a name is given once."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is there already")
    ADAPTERS[name] = adapter


def inject(docs: DataFrame, text: str, failures: dict[int, str], by: str, modulus: int) -> DataFrame:
    """Texts with a failure's sentence added where ``by`` modulo ``modulus`` is its key, and its name as injection."""
    r = F.pmod(F.col(by), F.lit(modulus))
    added, name = F.lit(""), F.lit("clean")
    for k, v in failures.items():
        kind, _, sentence = v.partition(":")
        added, name = F.when(r == k, F.lit(sentence)).otherwise(added), F.when(r == k, kind).otherwise(name)
    return docs.withColumns({text: F.concat(F.col(text), added), "injection": name})


def questions_from(docs: DataFrame, text: str, least: int = 20, words: int = 5) -> DataFrame:
    """Sentences of at least so many characters and words as question and answer pairs."""
    from plumbline.functions.text import sentences

    x = docs.withColumn("_s", sentences(F.col(text), least)).select(*[c for c in docs.columns if c != text], F.posexplode("_s").alias("pos", "answer"))
    x = x.where(F.size(F.split("answer", r"\s+")) >= words)
    return x.withColumn("question", F.concat(F.lit("What is said of "), F.split_part("answer", F.lit(" "), F.lit(1)), F.lit("?")))
