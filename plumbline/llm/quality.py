"""Operator 10: document quality by hierarchical empirical Bayes.

A logistic classifier gives each document a log-odds of being good from its text alone.
Hosts, and paths in hosts, get posteriors of their own: the share of good documents among
a group's, shrunk toward the level above by a Beta prior whose strength is estimated from
how much the groups differ (method of moments). A sparse path thus stands close to its
host, a sparse host close to the global mean. A document's score adds to its own log-odds
what its path's posterior says beyond the global mean, each group being counted without the
document itself, so that no document vouches for itself.

The groups are grouped aggregates with partial sums, so a host with a third of all rows is
no more work for one task than any other; only sums, counts and one row for each group move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut
from plumbline.llm.toxicity import held_out, sample_labels

#: What the classifier looks at, in this order.
SIGNALS = ("length", "words", "word_length", "letters", "upper", "digits", "marks", "spaces", "distinct_words", "distinct_lines", "line_length", "top_word", "word_ends_odd", "shouts", "bars", "repeats")
_WORD, _ODD_END, _SHOUT = re.compile(r"\S+"), re.compile(r"[^\w\s.,;:!?)\"'\]-](?=\s|$)"), re.compile(r"[!?]{2,}")
_MARKS = re.compile(r"[^\w\s]")


def signals(text: str | None) -> list[float]:
    """Shape of a whole text; all 0 for null, empty and blank ones."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(SIGNALS)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    size, letters = len(text), len(_MARKS.sub("", text)) - text.count(" ")
    upper, digits = sum(map(str.isupper, words)), sum(map(str.isdigit, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    twos = set(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        size / n / 10,
        letters / size,
        upper / n,
        digits / n,
        len(_MARKS.findall(text)) / size,
        text.count(" ") / size,
        len(distinct) / n**0.8,
        len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))) / 5,
        max(counts.values()) / n,
        len(_ODD_END.findall(text)) / n,
        len(_SHOUT.findall(text)) / n,
        text.count("|") / n,
        len(twos) / max(1, n - 1),
    ]


@dataclass
class Classifier:
    """Logistic regression on standardised signals, their squares and pairwise products."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return _expand((rows - self.mean) / self.scale) @ self.weights


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j] / 4], axis=1)


def fit_classifier(rows: np.ndarray, labels: np.ndarray, *, l2: float = 1.0, steps: int = 30) -> Classifier:
    """Newton's method on the penalised logistic loss; with one kind of label, its share alone."""
    share = float((labels.sum() + 1) / (len(labels) + 2))
    mean = rows.mean(0) if len(rows) else np.zeros(len(SIGNALS))
    scale = rows.std(0) + 1e-6 if len(rows) else np.ones(len(SIGNALS))
    fitted = Classifier(mean, scale, np.zeros(_expand(np.zeros((1, len(SIGNALS)))).shape[1]), share)
    fitted.weights[0] = np.log(share / (1 - share))
    if not 0 < labels.sum() < len(labels):
        return fitted
    x, w = _expand((rows - mean) / scale), fitted.weights
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-6
    loss = lambda v: np.logaddexp(0, x @ v).sum() - labels @ (x @ v) + 0.5 * (penalty * v * v).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-5:
            break
    return fitted


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Classifier:
    """The text classifier, from the signals of at most ``sample`` labelled documents that are not held out."""
    chosen = sample_labels(labels, label_col, id_col, sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [signals(t) for t in pdf["text"]]})

    train = texts.mapInPandas(look, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id")
    rows = np.array(train["x"].tolist(), np.float64).reshape(-1, len(SIGNALS))
    order = np.lexsort((*rows.T, train["doc_id"].to_numpy()))
    return fit_classifier(rows[order], train["label"].to_numpy(np.float64)[order])


def site(url: Column) -> tuple[Column, Column]:
    """(host, path) of addresses: the host in lower case without "www.", and the first part of the path, empty where there is none.

    An address that is none, or null, has no host.
    """
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.split_part(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"), F.lit(2))
    return host, F.when(host.isNotNull(), path)


def strength(groups: DataFrame, share: Column, n: Column, whole: Column) -> Column:
    """Pseudo-documents of the prior over groups, an aggregate: from 1 to 1000.

    The spread of group means about the level above, less what their sizes explain, is the
    spread of the groups themselves; the prior's strength is ``m (1 - m) / spread - 1``.
    """
    noise = whole * (1 - whole) / n
    spread = F.sum(n * (F.pow(share - whole, 2) - noise)) / F.sum(n)
    between = F.avg(whole * (1 - whole))
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.when(spread > 0, between / spread - 1).otherwise(F.lit(1000.0))))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def score(
    docs: DataFrame,
    classifier: Classifier,
    host: Column,
    path: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    site_weight: float = 0.5,
) -> DataFrame:
    """doc_id, held_out, host, path, n_host, n_path, evidence, host_posterior, path_posterior, score and keep.

    ``host`` and ``path`` are columns of ``docs``; null ones are groups of their own.
    ``evidence`` is the classifier's probability; ``site_weight`` is how much of the path's
    log-odds beyond the global mean is added to it. ``keep`` is score >= ``threshold``. Null,
    empty and blank texts have evidence 0 and are not counted in their groups. Repeated rows
    are scored each; an empty table gives no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                x = np.array([signals(t) for t in pdf["text"]], np.float64).reshape(-1, len(SIGNALS))
                p = 1 / (1 + np.exp(-np.clip(held.value.logits(x), -30, 30)))
                p[x[:, 1] == 0] = 0.0
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "host": pdf["host"], "path": pdf["path"], "evidence": p})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = cut(rows.mapInPandas(run, "doc_id long, held_out boolean, host string, path string, evidence double"))
    # Sums of integers do not depend on the order in which tasks end.
    milli = F.round(F.col("evidence") * 1_000_000).cast("long")
    counted = (F.col("evidence") > 0).cast("long")
    paths = scored.groupBy("host", "path").agg(F.sum(milli).alias("s"), F.sum(counted).alias("n"))
    paths = paths.withColumnsRenamed({"s": "path_s", "n": "n_path"})
    hosts = paths.groupBy("host").agg(F.sum("path_s").alias("host_s"), F.sum("n_path").alias("n_host"))
    top = hosts.agg(F.sum("host_s").alias("all_s"), F.sum("n_host").alias("n_all")).select("n_all", (F.col("all_s") / 1e6 / F.greatest("n_all", F.lit(1))).alias("mean"))
    mean = top.first()["mean"]
    m = F.lit(min(max(mean if mean is not None else 0.5, 1e-4), 1 - 1e-4))
    host_mean, path_mean = F.col("host_s") / 1e6 / F.col("n_host"), F.col("path_s") / 1e6 / F.col("n_path")
    by_host = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h.host_s", "h.n_host")
    k_host = hosts.where("n_host > 0").agg(F.coalesce(strength(hosts, host_mean, F.col("n_host"), m), F.lit(1000.0)).alias("k")).first()["k"]
    inner = by_host.where("n_path > 0")
    k_path = inner.agg(F.coalesce(strength(inner, path_mean, F.col("n_path"), F.least(F.greatest(host_mean, F.lit(1e-4)), F.lit(1 - 1e-4))), F.lit(1000.0)).alias("k")).first()["k"]
    joined = scored.alias("d").join(by_host.alias("p"), F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path"))).select("d.*", "p.path_s", "p.n_path", "p.host_s", "p.n_host")
    own = F.when(counted > 0, milli).otherwise(0)
    joined = joined.withColumn("host_posterior", ((F.col("host_s") - own) / 1e6 + k_host * m) / (F.col("n_host") - counted + k_host))
    joined = joined.withColumn("path_posterior", ((F.col("path_s") - own) / 1e6 + k_path * F.col("host_posterior")) / (F.col("n_path") - counted + k_path))
    logit = _logit(F.col("evidence")) + site_weight * (_logit(F.col("path_posterior")) - _logit(m))
    out = joined.withColumn("score", F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-logit))).otherwise(0.0)).withColumn("keep", F.col("score") >= threshold)
    return out.select("doc_id", "held_out", "host", "path", "n_host", "n_path", "evidence", "host_posterior", "path_posterior", "score", "keep")
