"""Models as plug-ins: embeddings, judges, signatures. Stand-ins without a model are deterministic."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions import text as T


def hashed_embedding(text: Column, dimension: int = 384) -> Column:
    """A bag of words hashed into ``dimension`` counts: a stand-in for an embedding model.

    Slots are put in order, so a count is the distance of two places, and no slot is looked for in all words.
    """
    slots = F.array_sort(F.transform(T.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int")))
    empty = F.array_repeat(F.lit(0.0), dimension)

    def counts(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(x != F.get(s, i + 1), F.lit(True)), F.struct(x.alias("slot"), (i + 1).alias("end")))), lambda x: x.isNotNull())
        runs = T.let(ends, lambda e: F.map_from_entries(F.transform(e, lambda x, i: F.struct(x["slot"], (x["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(0))).cast("double")))))
        return T.let(runs, lambda m: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))

    return T.let(slots, lambda s: F.when(F.size(s) > 0, counts(s)).otherwise(empty))


#: Letters that :func:`letter_profile` counts.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def letter_profile(text: Column) -> Column:
    """How often a text has each letter from a to z: the cheapest stand-in for an embedding, which SQL can make, too."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in ALPHABET])


def signed(row_json: Column, key: str) -> Column:
    """HMAC-SHA-256 of a JSON text, in hex."""

    @F.pandas_udf(StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest())

    return sign(row_json)


def escalate(rows: DataFrame, doubtful: Column, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that are clear as they are, and the doubtful ones after a second, dearer judge has seen those alone."""
    doubt = F.coalesce(doubtful, F.lit(False))
    return rows.where(~doubt).unionByName(second(rows.where(doubt)))


def sanitized(scores: Column, confidence: Column, dimensions: tuple[str, ...]) -> tuple[Column, Column]:
    """Scores of a model clamped to 1..5 (3 where absent), and its confidence to 0..1 (0.5 where absent)."""
    one = lambda d: F.least(F.greatest(F.coalesce(F.try_element_at(scores, F.lit(d)), F.lit(3)), F.lit(1)), F.lit(5))
    return F.map_from_arrays(F.array(*map(F.lit, dimensions)), F.array(*map(one, dimensions))), F.least(F.greatest(F.coalesce(confidence, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
