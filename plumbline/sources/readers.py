"""Files into DataFrames. How a bad line is met is the reader's choice, as it differs by use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "array<struct<role:string,content:string>>"
CASES = f"case_id string, conversation {MESSAGE}, candidate_answer string, rubric_id string, human_decision string, human_scores map<string,int>, rationale string"
JUDGMENTS = "case_index int, rubric_id string, case_id string, human_decision string, human_scores map<string,int>, judge_decision string, judge_scores map<string,int>, judge_flags array<string>"
EVENTS = "schema_version string, event_type string, timestamp string, source string, actor string, related_ids map<string,string>, payload string, content_hash string"


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which a malformed one fails the job; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the malformed ones and those that are no objects."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cleaned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines after control characters but tabs and line ends are taken out; a malformed one fails the job."""
    text = F.regexp_replace("value", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    rows = spark.read.text(path).select(text.alias("value")).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def validated(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows of sound lines, and (line, code, field) for every one that is not; nothing stops the job.

    Lines are numbered by their place in their file, which is read as a whole, as a manifest's datasets are.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    full = T._parse_datatype_string(schema)
    parsed = lines.select((F.col("line") + 1).alias("line"), F.from_json("text", full.add("_corrupt", "string") if "_corrupt" not in full.fieldNames() else full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    rows = parsed.select("line", "x.*")
    broken = rows.where("_corrupt is not null").select("line", F.lit("MALFORMED").alias("code"), F.lit(None).cast("string").alias("field"))
    sound = rows.where("_corrupt is null").drop("_corrupt")
    absent = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), F.lit(c)) for c in required])))
    missing = sound.select("line", F.lit("MISSING").alias("code"), absent.alias("field"))
    return sound, broken.union(missing)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, content) of the .txt and .md files of a folder; the file's stem is its id."""
    rows = spark.read.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.(txt|md)$", "").alias("doc_id"), F.col("value").alias("content"))


def knowledge_base(rows: DataFrame, key: str, content: str, least: int = 20) -> DataFrame:
    """(key, contents): the distinct texts of at least ``least`` characters of each key."""
    once = rows.where(F.length(content) >= least).select(key, content).distinct()
    return once.groupBy(key).agg(F.sort_array(F.collect_list(content)).alias("contents"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, as "sha256:" and hex."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def check_manifest(rows: DataFrame, manifest: dict, key: str = "case_id") -> list[str]:
    """Problems of a dataset against its manifest: a wrong number of rows, blank or repeated keys."""
    blank = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    n, blanks = rows.agg(F.count(F.lit(1)), F.count_if(blank)).first()
    repeated = rows.groupBy(key).count().where("count > 1").count()
    wanted = manifest.get("row_count")
    return [p for p, bad in ((f"{n} rows, not {wanted}", wanted is not None and n != wanted), (f"{blanks} blank keys", blanks), (f"{repeated} keys repeat", repeated)) if bad]


def check_schema_version(found: str | None, wanted: str) -> None:
    """Raises unless the versions are equal."""
    if found != wanted:
        raise ValueError(f"schema version {found!r} is not {wanted!r}")
