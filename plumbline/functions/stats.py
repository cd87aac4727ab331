"""Statistics as Columns, defined where their denominators are 0, as aggregates or over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0.0 where both are 0."""
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def kappa(pp: Column, pf: Column, fp: Column, ff: Column) -> Column:
    """Cohen's kappa of two pass/fail raters; null without rows or where chance agreement is 1."""
    n = (pp + pf + fp + ff).cast("double")
    seen = F.try_divide((pp + ff).cast("double"), n)
    chance = F.try_divide(((pp + pf) * (pp + fp) + (fp + ff) * (pf + ff)).cast("double"), n * n)
    return F.try_divide(seen - chance, 1 - chance)


def pearson(x: Column, y: Column) -> Column:
    """Population correlation as an aggregate, from exact sums of integers; 0.0 where one does not vary, null without rows."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("double")
    sx, sy, sxy = F.sum(x).cast("double"), F.sum(y).cast("double"), F.sum(x * y).cast("double")
    sxx, syy = F.sum(x * x).cast("double"), F.sum(y * y).cast("double")
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300)))).when(n > 0, 0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0.0 where one has norm 0."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.try_divide(dot(a, b), norms)).otherwise(0.0)


def pct(x: Column, p: float) -> Column:
    """Percentile with linear interpolation as an aggregate; 0.0 of nothing."""
    return F.coalesce(F.percentile(x, F.lit(p)), F.lit(0.0))
