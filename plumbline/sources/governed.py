"""Datasets and settings that are looked at before they are used: batches, registrations, versions, settings, exports.

What is here is small and read on the driver; the rows that it names are read by Spark.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import readers

BATCH = "position int, case_id string, response string, source string, metadata map<string,string>"


class InputError(ValueError):
    """A file that does not keep its contract; the message begins with its path."""


class CollisionError(InputError):
    """A name that stands for other content than before."""


def loaded(path: str | Path) -> Mapping:
    """A JSON or YAML file's object; YAML needs a parser that may be absent."""
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise InputError(f"{path}: {e}") from e
    kind = path.suffix.lower()
    try:
        if kind == ".json":
            data = json.loads(text)
        elif kind in (".yaml", ".yml"):
            import yaml

            data = yaml.safe_load(text)
        else:
            raise InputError(f"{path}: {kind!r} is not .yaml, .yml or .json")
    except InputError:
        raise
    except ImportError as e:
        raise InputError(f"{path}: no YAML parser is installed") from e
    except Exception as e:
        raise InputError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise InputError(f"{path}: " + ("the file is empty" if data is None else "not an object"))
    return data


def batch_cases(spark: SparkSession, path: str | Path) -> DataFrame:
    """The cases of a batch file of schema version 1, with their position; a wrong field raises :class:`InputError`."""
    data = loaded(path)
    if data.get("schema_version", 1) != 1:
        raise InputError(f"{path}: schema_version {data['schema_version']!r} is not 1")
    if not isinstance(data.get("cases"), list):
        raise InputError(f"{path}: cases is not a list")
    rows = []
    for i, case in enumerate(data["cases"]):
        if not isinstance(case, dict):
            raise InputError(f"{path}: cases[{i}] is not an object")
        for name, needed in (("case_id", True), ("response", True), ("source", False)):
            value = case.get(name)
            if not isinstance(value, str) and (needed or value is not None):
                raise InputError(f"{path}: cases[{i}].{name} is not a text")
        metadata = case.get("metadata")
        if metadata is not None and not isinstance(metadata, dict):
            raise InputError(f"{path}: cases[{i}].metadata is not an object")
        flat = None if metadata is None else {k: v if isinstance(v, str) else json.dumps(v) for k, v in metadata.items()}
        rows.append((i, case["case_id"], case["response"], case.get("source"), flat))
    return spark.createDataFrame(rows, BATCH)


def sha256(path: str | Path) -> str:
    """A file's hash as "sha256:" and hex, read in parts."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return f"sha256:{digest.hexdigest()}"


def register_benchmark(path: str | Path, now: datetime.datetime | None = None) -> dict:
    """Registers a benchmark's definition: its id, version and hash go into a file beside it.

    The second time it returns what is there; other content, or another id or version, raises :class:`CollisionError`.
    """
    path = Path(path)
    definition = loaded(path)
    for name in ("benchmark_id", "version"):
        if not isinstance(definition.get(name), str):
            raise InputError(f"{path}: {name} is not a text")
    own = {"benchmark_id": definition["benchmark_id"], "benchmark_version": definition["version"], "benchmark_content_hash": sha256(path)}
    beside = path.with_name(f"{definition['benchmark_id']}_registration.json")
    if beside.is_file():
        recorded = json.loads(beside.read_text(encoding="utf-8"))
        other = [k for k, v in own.items() if recorded.get(k) != v]
        if other:
            raise CollisionError(f"{path}: {', '.join(other)} differ from {beside}")
        return recorded
    at = (now or datetime.datetime.now(datetime.UTC)).isoformat()
    record = own | {"benchmark_registration_timestamp": at, "source_file": path.name}
    beside.write_text(json_text(record), encoding="utf-8")
    return record


def resolved_dataset(spark: SparkSession, root: str | Path, dataset_id: str, version: str, schema: str = readers.CASES) -> tuple[DataFrame, Mapping]:
    """Rows and manifest of ``root``/dataset_id, if the manifest has this id and version and its hash is the data file's; else it raises."""
    folder = Path(root) / dataset_id
    found = [p for p in (folder / "dataset.json", folder / "dataset.yaml") if p.is_file()]
    if not found:
        raise InputError(f"{folder}: no manifest")
    manifest = loaded(found[0])
    for name, wanted in (("dataset_id", dataset_id), ("version", version)):
        if manifest.get(name) != wanted:
            raise InputError(f"{found[0]}: {name} {manifest.get(name)!r} is not {wanted!r}")
    data = folder / manifest.get("data_file", "data.jsonl")
    if manifest.get("sha256") and sha256(data) != manifest["sha256"]:
        raise CollisionError(f"{data}: hash differs from the manifest's")
    return readers.strict(spark, str(data), schema), manifest


def settings(path: str | Path, known: Mapping[str, type | tuple[type, ...]], defaults: Mapping | None = None) -> dict:
    """A settings file over ``defaults``; a key that is not known, or a value of another type, raises."""
    data = loaded(path)
    for k, v in data.items():
        if k not in known:
            raise InputError(f"{path}: unknown key {k!r}")
        if not isinstance(v, known[k]) or (isinstance(v, bool) and known[k] in (int, float)):
            raise InputError(f"{path}: {k} has the wrong type")
    return {**(defaults or {}), **data}


def json_text(value) -> str:
    """JSON with sorted keys and two spaces, ending in a line end."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def export_dataset(rows: DataFrame, folder: str | Path, dataset_id: str, version: str) -> dict:
    """Rows as JSON lines and their manifest with a hash of their content that does not depend on their order.

    The manifest is written last. Spark writes the rows, so they may be many; the hash is the SHA-256 of
    the number of rows and the sums of two 64-bit hashes of each row's JSON.
    """
    folder = Path(folder)
    line = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "value").cast("decimal(38,0)"))
    n, a, b = line.agg(F.count(F.lit(1)), part("a"), part("b")).first()
    line.write.mode("errorifexists").text(str(folder / "data"))
    manifest = {"dataset_id": dataset_id, "version": version, "row_count": n, "content_hash": "sha256:" + hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()}
    (folder / "dataset.json").write_text(json_text(manifest), encoding="utf-8")
    return manifest


def append_with_retry(append: Callable[[], None], tries: int = 3, wait_s: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether ``append`` went through in ``tries`` tries, with waits that double; a log is no reason to stop a run."""
    for i in range(tries):
        try:
            append()
            return True
        except Exception:
            if i + 1 < tries:
                sleep(wait_s * 2**i)
    return False


def evaluation_manifest(evaluated: DataFrame, platform_version: str) -> DataFrame:
    """One nested row for each evaluation of a chain: its id, version, records, outputs' hashes, and "unavailable" for what upstream did not give."""
    hashes = F.transform_values("outputs", lambda _, v: F.concat(F.lit("sha256:"), F.sha2(v, 256)))
    status = F.when(F.col("complete"), "complete").when(F.exists("integrity", lambda r: r["status"] == "success"), "partial").otherwise("failed")
    named = lambda step: F.coalesce(F.try_element_at(hashes, F.lit(step)), F.lit("unavailable"))
    return evaluated.select(
        "case_id", F.lit(platform_version).alias("platform_version"), status.alias("status"), F.col("integrity"), hashes.alias("output_hashes"),
        named("CAP-1").alias("dataset_hash"), named("CAP-2").alias("rules_hash"), named("CAP-7").alias("verdict_hash"),
    )


def report_text(title: str, rows: DataFrame, order: Sequence[Column], most: int = 25) -> str:
    """A report's text: a title, the first ``most`` rows in this order as a table, and how many there are."""
    n, shown = rows.count(), rows.orderBy(*order).limit(most).collect()
    width = {c: max([len(c)] + [len(str(r[c])) for r in shown]) for c in rows.columns}
    line = lambda values: "  ".join(str(v).ljust(width[c]) for c, v in zip(rows.columns, values, strict=True)).rstrip()
    body = [title, line(rows.columns), *[line([r[c] for c in rows.columns]) for r in shown]]
    return "\n".join([*body, f"{len(shown)} of {n} rows"]) + "\n"
