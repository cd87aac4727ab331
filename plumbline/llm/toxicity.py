"""Operator 2: toxicity by a factorization machine over hashed terms.

A document is the set of its words and their stems, each hashed into one of ``bins`` bins. Bins are
screened by a chi-squared test against the labels, and a second-order factorization
machine is fitted on those that pass: a weight for each bin, and a short vector for each,
whose inner products weigh pairs. So an insult next to the mention of a group can count for
more than the two alone. The counts for the screening are grouped aggregates over the
labelled documents; the fit itself runs on the driver, on bin numbers of a sample of at most ``sample``
labelled rows. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordCache, remembered

TERM = re.compile(r"\w+")
#: A word counts with its first so many characters, too: inflected and compound forms share those.
STEMS = (4, 6)


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text is divisible by ``folds``; such rows teach nothing. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


@remembered
def terms_of(bins: int) -> WordCache:
    """word -> bins of the word and of its stems, remembered by the worker process."""

    def make(word: str) -> tuple[int, ...]:
        terms = [word, *(word[:n] + "-" for n in STEMS if n < len(word))]
        return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) % bins for t in terms)

    return WordCache(make)


def bins_of(text: str | None, bins: int) -> list[int]:
    """The distinct bins of the lower-cased words of a whole text and of their stems."""
    cache = terms_of(bins)
    return list(set().union(*[cache[w] for w in set(TERM.findall((text or "").lower()))]))


@dataclass
class FactorizationMachine:
    """Logistic second-order machine over presence features; ``at`` are the bins of its features, sorted."""

    at: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    bins: int

    def logits(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of documents whose feature numbers follow one another in ``flat``."""
        return _forward(flat, lengths, self.bias, self.weights, self.vectors)[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of label 1."""
        lists = [np.array(bins_of(t, self.bins), np.int64) for t in texts]
        lengths = np.array([len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        place = np.searchsorted(self.at, flat)
        known = place < len(self.at)
        known[known] = self.at[place[known]] == flat[known]
        owner = np.repeat(np.arange(len(lists)), lengths)[known]
        return 1 / (1 + np.exp(-self.logits(place[known], np.bincount(owner, minlength=len(lists)))))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; 0 for runs of length 0."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[ends - lengths]


def _forward(flat, lengths, bias, weights, vectors):
    v = vectors[flat]
    whole = _sums(v, lengths)
    pairs = 0.5 * ((whole**2).sum(1) - _sums((v**2).sum(1), lengths))
    return bias + _sums(weights[flat], lengths) + pairs, whole


def fit_machine(lists: list[np.ndarray], labels: np.ndarray, features: int, *, rank: int = 6, epochs: int = 30, batch: int = 256, rate: float = 0.02, l2: float = 5e-5, l2_pairs: float = 5e-4, seed: int = 7):
    """(bias, weights, vectors) by Adam on the logistic loss; deterministic for the order of its rows."""
    draw = np.random.default_rng(seed)
    mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    params = [np.array([np.log(mean / (1 - mean))]), np.zeros(features), draw.normal(0, 0.01, (features, rank))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs if len(lists) and features else 0):
        order = draw.permutation(len(lists))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            lengths = np.array([len(lists[i]) for i in rows])
            flat = np.concatenate([lists[i] for i in rows]).astype(np.int64)
            z, whole = _forward(flat, lengths, params[0][0], params[1], params[2])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(g, lengths)
            pair = each[:, None] * (np.repeat(whole, lengths, axis=0) - params[2][flat])
            grads = [np.array([g.sum()]), np.bincount(flat, each, features) + l2 * params[1], l2_pairs * params[2]]
            np.add.at(grads[2], flat, pair)
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, m, s, d in zip(params, first, second, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def sample_labels(labels: DataFrame, label_col: str, id_col: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (doc_id, label) with known labels 0 or 1, by a hash of the id; held-out ones never.

    An id with several labels counts with the largest. The bound on its rows is what allows a broadcast.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = 20_000,
    bins: int = 1 << 20,
    features: int = 1024,
    least: int = 5,
) -> FactorizationMachine:
    """A machine fitted on at most ``sample`` labelled documents that are not held out.

    Only text and label are looked at. Without labels of both kinds it has no features and
    scores every document with the share of ones (0.5 if there are none).
    """
    chosen = sample_labels(labels, label_col, id_col, sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "bins": [sorted(bins_of(t, bins)) for t in pdf["text"]]})

    def selected(at: np.ndarray):
        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sets = [np.intersect1d(np.array(bins_of(t, bins), np.int64), at, assume_unique=True) for t in pdf["text"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "features": [np.searchsorted(at, s).astype("<u2").tobytes() for s in sets]})

        return pick

    by = texts.mapInPandas(hashed, "label int, bins array<int>").select("label", F.explode_outer("bins").alias("bin"))
    counts = by.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
    rows, ones = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = ones / rows if rows else 0.5
    at = np.zeros(0, np.int64)
    if 0 < ones < rows:
        expected = F.col("n") * share
        chi = F.pow(F.col("ones") - expected, 2) / (expected * (1 - share) * (1 - F.col("n") / rows + 1e-9))
        found = counts.where((F.col("n") >= least) & (chi > 6.63)).orderBy(F.desc(chi), "bin").limit(features).select("bin").collect()
        at = np.array(sorted(r.bin for r in found), np.int64)
    train = texts.select("doc_id", "label", "text").mapInPandas(selected(at), "doc_id long, label int, features binary").toPandas().sort_values(["doc_id", "features"])
    lists = [np.frombuffer(f, "<u2") for f in train["features"]]
    bias, weights, vectors = fit_machine(lists, train["label"].to_numpy(np.float64), len(at))
    return FactorizationMachine(at, bias, weights, vectors, bins)


def score(docs: DataFrame, machine: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts get the score of no terms.

    Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                pdf = whole.iloc[start : start + 512]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": held.value.score(list(pdf["text"]))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, machine: FactorizationMachine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged; null and empty texts score as those of no terms."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        parts = [held.value.score(list(texts.iloc[at : at + 512])) for at in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(scored(F.col(text_col)) < threshold)
