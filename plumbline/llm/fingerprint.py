"""Operator 4: document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes: each byte adds a fixed random number to the
hash shifted by one bit, so 32 bytes decide its value, which is computed for all places at
once by doubling. A chunk ends where bits of the hash are 0: more bits are asked for below
the normal size and fewer above (normalised chunking), between a least and a greatest size.
Boundaries depend on near content alone, so an edit changes the chunks around it and no
others. The fingerprint lists the digest and length of each distinct chunk; likeness is the
length of shared chunks over that of the shorter fingerprint, a measure of containment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A random number for each byte value, from a fixed seed.
GEAR = np.random.default_rng(0x9EA2).integers(0, 2**32, 256, np.uint32)
SEED = 4


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash after every byte; earlier bytes than 32 ago have been shifted out."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift) if len(h) > shift else 0
    return h


def chunks(data: bytes, least: int = 24, normal: int = 64, most: int = 256, bits: tuple[int, int] = (7, 5)) -> list[bytes]:
    """The chunks of a text in turn; none for the empty one."""
    h = gear_hashes(data)
    # High bits have seen the most bytes.
    loose = np.flatnonzero(h >> np.uint32(32 - bits[1]) == 0)
    ends, strict = (loose + 1).tolist(), (h[loose] >> np.uint32(32 - bits[0]) == 0).tolist()
    out, start, size, n, i = [], 0, len(data), len(ends), 0
    while start < size:
        if size - start <= least:
            end = size
        else:
            i, stop, end = bisect_left(ends, start + least, i), min(start + most, size), 0
            while i < n and (at := ends[i]) < start + normal:
                if strict[i]:
                    end = at
                    break
                i += 1
            end = end or (min(ends[i], stop) if i < n else stop)
        out.append(data[start:end])
        start = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    """64-bit digest -> length of each distinct chunk."""
    return {xxhash.xxh64_intdigest(c, SEED): len(c) for c in chunks(text.encode("utf-8", "surrogatepass"))}


def to_string(found: dict[int, int]) -> str:
    """``digest:length`` in hex, by ascending digest; empty for an empty text."""
    return ",".join([f"{d:016x}:{found[d]:x}" for d in sorted(found)])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of shared chunks over the shorter fingerprint's; two empty ones are alike, an empty and another not."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 4_000, most_ranges: int = 20_000) -> DataFrame:
    """(part, tail, doc_id, text): documents dealt to ranges of doc_id, where ``tail`` marks a copy of the next range's first.

    In each part, sorted by tail and doc_id, every document is followed by the next one in
    the table, and the last range by the first document of all. Only range bounds, at most
    ``most_ranges``, come to the driver; a range is sorted and read as a stream, so it may
    be of any size. A text moves once (a range's first, twice). Equal ids stand in one
    range, by the digest of their texts. Null ids come first.
    """
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = min(most_ranges, max(1, -(-rows.count() // rows_per_range)))
    quantiles = rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.array(sorted({int(b) for b in quantiles}), np.int64)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype("int32"))

    rows = rows.withColumn("part", part_of("k"))
    found = {r.part: r.k for r in rows.groupBy("part").agg(F.min("k").alias("k")).collect()}
    order = sorted(found)
    ahead = {found[p]: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("int")
    def ended_by(k: pd.Series) -> pd.Series:
        """The range whose last document is followed by this id, or null."""
        return k.map(ahead).astype("Int32")

    rows = rows.withColumn("ends", ended_by("k"))
    own = F.struct("part", F.lit(False).alias("tail"))
    both = F.when(F.col("ends").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("ends").alias("part"), F.lit(True).alias("tail"))))
    rows = rows.select("k", "doc_id", "text", F.explode(both).alias("to")).select("to.part", "to.tail", "k", "doc_id", "text")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "tail", "k", F.md5("text")).drop("k")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all whole texts and of their edited texts, and their likeness to those and to the next document's.

    The next document is that of the next doc_id, after the last the first; a single
    document is its own next. Returns doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and n_chunks. A null text is
    empty. Rows with equal ids follow one another by the digest of their texts, null ids
    stand before all others; an empty table gives no rows; other columns are not read.
    """

    def row(doc, text: str, found: dict, after: tuple[str, dict]) -> tuple:
        changed = edited(text, after[0])
        new = fingerprint(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), sha, to_string(found), to_string(new), likeness(found, new), likeness(found, after[1]), len(found)

    def frame(done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(done, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.assign(doc_id=pd.array([x[0] for x in done], "Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, ended, done = None, None, False, []
        for pdf in batches:
            for now, tail, doc, text in zip(pdf["part"], pdf["tail"], pdf["doc_id"], pdf["text"], strict=True):
                if now != part:
                    part, last, ended = now, None, False
                if ended:
                    continue  # of several first documents of the next range only one follows
                found = fingerprint(text)
                if last is not None:
                    done.append(row(*last, (text, found)))
                last, ended = (None if pd.isna(doc) else int(doc), text, found), tail
                if len(done) >= 512:
                    yield frame(done)
                    done = []
        if done:
            yield frame(done)

    return with_next(docs, id_col, text_col).select("part", "tail", "doc_id", "text").mapInPandas(run, SCHEMA)
