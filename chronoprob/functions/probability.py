"""Column functions on class-probability arrays (``array<double>``, one entry for each class)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for the row: inside a lambda, an outer expression would
    be computed again for each entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalized(p: Column, floor: float = 0.0) -> Column:
    """Rows that sum to one, after raising entries to ``floor``."""
    raised = F.transform(p, lambda x: F.greatest(x, F.lit(floor))) if floor else p
    return bound(raised, lambda a: bound(total(a), lambda t: F.transform(a, lambda x: x / t)))


def is_distribution(p: Column, tolerance: float = 1e-3) -> Column:
    """True where all entries are finite, none is negative and the sum is one within ``tolerance``."""
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce(finite & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def predicted_index(p: Column) -> Column:
    """Place of the largest entry, from 0; the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    """Largest minus second largest entry."""
    s = F.sort_array(p, asc=False)
    return F.element_at(s, 1) - F.element_at(s, 2)


def entropy(p: Column, relative: bool = False, eps: float = EPS) -> Column:
    """Shannon entropy in nats; ``relative`` divides by the logarithm of the number of classes."""
    h = -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(F.greatest(x, F.lit(eps))))
    return h / F.log(F.size(p).cast("double")) if relative else h


def true_probability(p: Column, label: Column) -> Column:
    return F.element_at(p, label.cast("int") + 1)


def log_loss(p: Column, label: Column, eps: float = EPS) -> Column:
    return -F.log(F.least(F.lit(1.0), F.greatest(true_probability(p, label), F.lit(eps))))


def brier(p: Column, label: Column) -> Column:
    hot = F.transform(p, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), F.lit(2.0)))
    return total(hot)


def rank_of(p: Column, label: Column) -> Column:
    """Rank of the true class from 1; of equal entries the lower class comes first."""
    ahead = lambda own: F.filter(p, lambda x, i: (x > own) | ((x == own) & (i < label)))
    return bound(true_probability(p, label), lambda own: F.size(ahead(own)) + 1)


def ranking(p: Column) -> Column:
    """Classes by falling probability, lower class first among equals: array of (score, class)."""
    pairs = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(pairs, lambda x: F.struct((-x["s"]).alias("score"), x["i"].cast("int").alias("class")))


def softmax(scores: Column) -> Column:
    return normalized(bound(scores, lambda a: bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))))


def tempered(p: Column, temperature: Column | float, eps: float = EPS) -> Column:
    """softmax(log p / temperature)."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return softmax(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(eps))) / t))


def reweighted(p: Column, target: Column, source: Column, eps: float = 1e-12) -> Column:
    """p times target prior over source prior, normalized."""
    ratio = F.zip_with(target, source, lambda t, s: F.greatest(t, F.lit(eps)) / F.greatest(s, F.lit(eps)))
    return normalized(F.zip_with(p, ratio, lambda x, r: x * r))


def binary_from_score(score: Column) -> Column:
    """(1 - s, s) with the logistic function of a score clipped to +-50."""
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), score))))
    return F.array(F.lit(1.0) - s, s)


def debiased(p: Column, bias: Column, eps: float = EPS) -> Column:
    """softmax(log p - bias)."""
    return softmax(F.zip_with(p, bias, lambda x, b: F.log(F.greatest(x, F.lit(eps))) - b))


def calibration_bin(conf: Column, n_bins: int = 10) -> Column:
    """Bin of a confidence: the number of inner edges i * (1 / n) at or below it; the last bin is closed."""
    out = F.lit(0)
    for i in range(1, n_bins):
        out = out + F.when(conf >= F.lit(i * (1.0 / n_bins)), 1).otherwise(0)
    return out


def hierarchical(press: Column, parts: Column) -> Column:
    """Null class first: (1 - P(press), P(press) P(part | press))."""
    return F.concat(F.array(F.lit(1.0) - press), F.transform(parts, lambda x: x * press))
