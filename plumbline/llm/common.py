"""What the operators share: checkpoints, reading tables, word caches."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``.

    Where none is set and Spark runs in one local process, as in tests, a temporary folder
    serves; on a cluster without that setting it raises, as a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that its lineage ends in files that survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written to the shared folder and read again, for steps that build on one another in a loop.

    Unlike a checkpoint, a table's size is that of its files: a checkpoint keeps the estimate of the plan
    it cuts, which squares with every join of a loop until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, **options: str) -> DataFrame:
        """``df`` as a table, written with these options."""
        path = f"{self.root}/{len(self.names)}"
        df.write.options(**options).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.names[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing uses any more; what is not a table of this set is passed over."""
        for table in tables:
            _, path = self.names.get(id(table), (None, None))
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
                self.names[id(table)] = table, None

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Deletes all tables of this set but those."""
        self.drop(*[table for table, path in list(self.names.values()) if path and not any(table is k for k in kept)])


_REMEMBERED: list[Callable] = []


def remembered(make: Callable) -> Callable:
    """``make`` with its results kept by the worker process until :func:`forget`."""
    kept = functools.cache(make)
    _REMEMBERED.append(kept)
    return kept


def forget(*but: Callable) -> None:
    """Drops what this process remembers for other work than ``but``, and gives the memory back; workers outlive stages."""
    others = [f for f in _REMEMBERED if f not in but and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


class WordCache(dict):
    """A dictionary from word to ``make(word)`` that holds at most twice ``limit`` words.

    When ``limit`` words are there they become the old ones, and the old ones go; an old word
    that is asked for stays. So common words stay, and what a worker process keeps is bounded.
    """

    def __init__(self, make, limit: int = 60_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
