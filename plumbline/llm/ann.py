"""Operator 1: approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors, the exact neighbour graph is built and divided into
parts of nearly equal size that cut few edges. A small classifier learns, from a vector's
direction, in which parts its neighbours are. It then gives every row of the table to its
most probable part, and sends every query to as many probable parts as it took on the
sample to find the wanted share of the true neighbours; all rows there are ranked by their
exact inner product in double precision.

A part is divided into blocks of at most about ``block_rows`` rows by a hash of the id, so
a part that holds a third of all rows, such as the copies of one vector, is many blocks.
Rows and queries of a block meet in one shuffle; a task holds one block's matrix and reads
the queries as a stream. Only the numbers of rows of the parts come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """A hidden layer and a softmax over parts; ``probes`` parts are searched for a query."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int
    recall: float

    @property
    def parts(self) -> int:
        return self.out.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_directions(x) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias


def _directions(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large and very small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products with each query row, its own left out."""
    out = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 512):
        rows = queries[at : at + 512]
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, draw: np.random.Generator, slack: float = 1.1, passes: int = 6) -> np.ndarray:
    """A part for each node of a neighbour graph, none over ``slack`` times the mean size, with few edges between parts.

    Starts from balanced clusters of the vectors, then moves nodes, one after another, to the
    part that holds most of their neighbours and has room, until a pass moves almost none.
    """
    n, cap = len(x), math.ceil(slack * len(x) / parts)
    unit, part = _directions(x), np.full(len(x), -1)
    centres = unit[draw.choice(n, parts, replace=False)]
    for _ in range(8):
        near = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = sums[moved] / np.linalg.norm(sums[moved], axis=1, keepdims=True)
    likeness, sizes = unit @ centres.T, np.zeros(parts, np.int64)
    for i in np.argsort(-likeness.max(axis=1), kind="stable"):
        free = np.where(sizes < cap, likeness[i], -np.inf)
        part[i] = int(np.argmax(free))
        sizes[part[i]] += 1
    a = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    order = np.argsort(a, kind="stable")
    b, ends = b[order], np.cumsum(np.bincount(a, minlength=n))
    for _ in range(passes):
        moves = 0
        for i in draw.permutation(n):
            votes = np.bincount(part[b[ends[i - 1] if i else 0 : ends[i]]], minlength=parts)
            votes[(sizes >= cap) & (np.arange(parts) != part[i])] = -1
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i], moves = best, moves + 1
        if moves < n / 200:
            break
    return part


def fit(x: np.ndarray, parts: int, *, k: int = 20, width: int = 128, epochs: int = 12, wanted: float = 0.96, seed: int = 11) -> Router:
    """A router fitted on sample vectors ``x``, whose ``probes`` reach a recall of ``wanted`` among them."""
    draw, n = np.random.default_rng(seed), len(x)
    parts, k = max(1, min(parts, n // 4)), min(k, n - 1)
    d = x.shape[1]
    hidden, bias = draw.normal(0, math.sqrt(2), (d, width)), np.zeros(width)
    out, out_bias = draw.normal(0, math.sqrt(1 / width), (width, parts)), np.zeros(parts)
    router = Router(hidden, bias, out, out_bias, parts, 1.0)
    if parts == 1:
        return router
    graph = neighbours(x, np.arange(n), min(10, n - 1))
    part = balanced_parts(x, graph, parts, draw)
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n)[:, None], part[np.concatenate([graph, np.arange(n)[:, None]], axis=1)]), 1 / (graph.shape[1] + 1))
    params, unit, step = [hidden, bias, out, out_bias], _directions(x), 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(epochs):
        for rows in np.array_split(draw.permutation(n), max(1, n // 256)):
            h = np.maximum(unit[rows] @ hidden + bias, 0)
            z = h @ out + out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ out.T) * (h > 0)
            step += 1
            for q, m, s, gradient in zip(params, first, second, [unit[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], strict=True):
                m += 0.1 * (gradient - m)
                s += 0.001 * (gradient * gradient - s)
                q -= 0.004 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    # How many parts it takes: true neighbours of some of the sample, looked up where the index has them.
    asked = draw.choice(n, min(n, 1000), replace=False)
    logits = router.logits(x)
    home, ranks = np.argmax(logits, axis=1), np.argsort(np.argsort(-logits[asked], axis=1, kind="stable"), axis=1, kind="stable")
    needed = ranks[np.arange(len(asked))[:, None], home[neighbours(x, asked, k)]]
    recalls = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(np.argmax(recalls >= wanted)) + 1
    router.recall = float(recalls[router.probes - 1])
    return router


def best_of(query: np.ndarray, own: int, ids: np.ndarray, matrix: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` best rows of a block for a query, best first, ties to smaller ids.

    ``scores`` are products whose last bits may depend on their place in a matrix. All rows
    that could be among the best are multiplied again, component after component, so that
    equal vectors get equal scores. ``ids`` must ascend; equal ids count once, with the best score.
    """
    edge = scores[np.argpartition(-scores, min(k, len(scores) - 1))[: k + 1]].min() if len(scores) > k else -np.inf
    at = np.flatnonzero(scores >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.arange(len(scores))
    at = at[ids[at] != own]
    exact = np.cumsum(matrix[at] * query, axis=1)[:, -1]
    order = np.lexsort((ids[at], -exact))
    at, exact = at[order], exact[order]
    if len(at) > 1 and len(set(ids[at].tolist())) < len(at):
        first = np.sort(np.unique(ids[at], return_index=True)[1])
        at, exact = at[first], exact[first]
    return ids[at[:k]], exact[:k]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where("vec_id is not null and v is not null").where(~bad).where(F.exists("v", lambda e: e != 0))


def search(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    sample: int = 20_000,
    block_rows: int = 4096,
    parts: int | None = None,
    wanted: float = 0.96,
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score, the inner product of the original
    vectors in double precision, added component by component; ties go to the smaller id.
    All rows are indexed; the router is fitted on at most ``sample`` of them. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do null ids and
    vectors of another dimension than most of the sample's. Rows that share an id count once, with
    their better score; queries that share one are the one of the least vector. With ``k``
    candidates or fewer all that were found are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = picked["v"].map(len)
    dimension = int(size.mode().min())
    x = np.stack(picked["v"][size == dimension].to_numpy())
    rows = rows.where(F.size("v") == dimension)
    n = rows.count() if len(picked) == sample else len(x)
    router = spark.sparkContext.broadcast(fit(x, parts or int(min(256, max(4, math.sqrt(n) / 4))), k=k, wanted=wanted))
    probes = router.value.probes

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                logits = router.value.logits(np.stack(pdf["v"].to_numpy()))
                asks = pdf["vec_id"] % every == 0
                order = np.argsort(-logits, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "part": logits.argmax(axis=1), "probe": [o if a else None for o, a in zip(order, asks, strict=True)]})

    indexed = cut(rows.mapInPandas(assign, "vec_id long, v array<double>, part int, probe array<int>"))
    held = {r.part: r.n for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*[F.lit(y) for p, c in sorted(held.items()) for y in (p, -(-c // block_rows))])
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("part"))).cast("int")
    data = indexed.select("part", block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = indexed.where("probe is not null").groupBy("vec_id").agg(F.min(F.struct("v", "probe")).alias("q")).select("vec_id", "q.*")
    asked = asked.select("vec_id", "v", F.explode("probe").alias("part")).where(F.col("part").isin(*held))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("part")) - 1)))
    both = data.unionByName(asked.select("part", "block", F.lit(1).alias("kind"), "vec_id", "v"))
    total = sum(-(-c // block_rows) for c in held.values())
    dealt = both.repartition(max(total, 1), "part", "block").sortWithinPartitions("part", "block", "kind", "vec_id")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, held_rows, matrix = None, [], [], None
        for pdf in batches:
            for now, group in pdf.groupby(["part", "block", "kind"], sort=False):
                if now[:2] != key:
                    key, ids, held_rows, matrix = now[:2], [], [], None
                v = np.stack(group["v"].to_numpy())
                if now[2] == 0:
                    ids.append(group["vec_id"].to_numpy())
                    held_rows.append(v)
                    continue
                if matrix is None:
                    matrix, all_ids = np.concatenate(held_rows), np.concatenate(ids)
                own, out = group["vec_id"].to_numpy(), []
                for at in range(0, len(v), 256):
                    for q, i, s in zip(v[at : at + 256], own[at : at + 256], v[at : at + 256] @ matrix.T, strict=True):
                        out.append((i, *best_of(q, i, all_ids, matrix, s, k)))
                yield pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    found = dealt.mapInPandas(rank, FOUND)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, every: int = 20, k: int = 20) -> dict[int, list[int]]:
    """query_id -> its true nearest ids, to measure recall on what fits in memory."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    return {int(i): best_of(x[r], i, ids, x, x @ x[r], k)[0].tolist() for r, i in enumerate(ids) if i % every == 0}
