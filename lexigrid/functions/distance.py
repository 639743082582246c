"""Distances between dense vectors: as Columns for given pairs, as numpy kernels for blocks.

Columns stay in the JVM and suit a join's rows.  Kernels take two matrices of
row vectors and give all distances between them.  The Boolean metrics see a
component as true if it isn't 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import NotAllowedValue

#: Bytes of the largest intermediate array of a kernel.
KERNEL_BYTES = 32 << 20


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda x, y: x * y))


def norm(u: Column) -> Column:
    return F.sqrt(total(F.transform(u, lambda x: x * x)))


def doubles(u: Column) -> Column:
    return u.cast("array<double>")


def cosine_similarity(u: Column, v: Column) -> Column:
    """0 if a vector is all zeros."""
    n = norm(u) * norm(v)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(u, v) / n)


def non_negative_cosine_similarity(u: Column, v: Column) -> Column:
    return (cosine_similarity(u, v) + 1) / 2


def angle(u: Column, v: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(u, v))))


def _sum_of(f: Callable) -> Callable:
    return lambda u, v: total(F.zip_with(u, v, f))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _centered(u: Column) -> Column:
    m = total(u) / F.size(u)
    return F.transform(u, lambda x: x - m)


def _tables(u: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    count = lambda f: total(F.zip_with(u, v, lambda x, y: F.when(f(x != 0, y != 0), 1.0).otherwise(0.0)))
    return count(lambda a, b: a & b), count(lambda a, b: a & ~b), count(lambda a, b: ~a & b), count(lambda a, b: ~a & ~b)


def _boolean(f: Callable) -> Callable:
    return lambda u, v: f(*_tables(u, v), F.size(u), _safe)


def _np_safe(num, den):
    return np.divide(num, den, out=np.zeros(np.broadcast(num, den).shape), where=np.asarray(den) != 0)


#: Boolean metrics from the counts of true-true, true-false, false-true, false-false and all components.
_BOOLEAN = {
    "dice": lambda tt, tf, ft, ff, n, over: over(tf + ft, 2 * tt + tf + ft),
    "jaccard": lambda tt, tf, ft, ff, n, over: over(tf + ft, tt + tf + ft),
    "kulsinski": lambda tt, tf, ft, ff, n, over: over(tf + ft - tt + n, tf + ft + n),
    "matching": lambda tt, tf, ft, ff, n, over: over(tf + ft, tt + tf + ft + ff),
    "rogerstanimoto": lambda tt, tf, ft, ff, n, over: over(2 * (tf + ft), tt + ff + 2 * (tf + ft)),
    "russellrao": lambda tt, tf, ft, ff, n, over: over(tf + ft + ff, tt + tf + ft + ff),
    "sokalmichener": lambda tt, tf, ft, ff, n, over: over(2 * (tf + ft), tt + ff + 2 * (tf + ft)),
    "sokalsneath": lambda tt, tf, ft, ff, n, over: over(2 * (tf + ft), tt + 2 * (tf + ft)),
    "yule": lambda tt, tf, ft, ff, n, over: over(2 * tf * ft, tt * ff + tf * ft),
}


def column(metric: str, p: float = 2.0, variance: list[float] | None = None, inverse: np.ndarray | None = None) -> Callable[[Column, Column], Column]:
    """A function of two array<double> Columns.  ``p`` is for minkowski, ``variance`` for seuclidean, ``inverse`` (of the covariance) for mahalanobis."""
    square = _sum_of(lambda x, y: (x - y) * (x - y))
    city = _sum_of(lambda x, y: F.abs(x - y))
    if metric in _BOOLEAN:
        return _boolean(_BOOLEAN[metric])
    if metric == "minkowski":
        return lambda u, v: F.pow(_sum_of(lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))(u, v), F.lit(1.0 / p))
    if metric == "seuclidean":
        var = F.array(*[F.lit(float(x)) for x in variance])
        return lambda u, v: F.sqrt(total(F.zip_with(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), var, lambda d, s: d / s)))
    if metric == "mahalanobis":
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in inverse])

        def mahalanobis(u: Column, v: Column) -> Column:
            d = F.zip_with(u, v, lambda x, y: x - y)
            return F.sqrt(dot(d, F.transform(rows, lambda r: dot(r, d))))

        return mahalanobis
    found = {
        "cosine": lambda u, v: 1 - cosine_similarity(u, v),
        "correlation": lambda u, v: 1 - cosine_similarity(_centered(u), _centered(v)),
        "euclidean": lambda u, v: F.sqrt(square(u, v)),
        "l2": lambda u, v: F.sqrt(square(u, v)),
        "sqeuclidean": square,
        "cityblock": city,
        "manhattan": city,
        "l1": city,
        "chebyshev": lambda u, v: F.array_max(F.zip_with(u, v, lambda x, y: F.abs(x - y))),
        "canberra": _sum_of(lambda x, y: _safe(F.abs(x - y), F.abs(x) + F.abs(y))),
        "braycurtis": lambda u, v: _safe(city(u, v), _sum_of(lambda x, y: F.abs(x + y))(u, v)),
        "hamming": lambda u, v: _sum_of(lambda x, y: F.when(x != y, 1.0).otherwise(0.0))(u, v) / F.size(u),
        "angle": angle,
    }.get(metric)
    if found is None:
        raise NotAllowedValue(f"unknown metric {metric}")
    return found


METRICS = (
    *_BOOLEAN,
    *"cosine correlation euclidean l2 sqeuclidean cityblock manhattan l1 chebyshev canberra braycurtis hamming angle minkowski seuclidean mahalanobis".split(),
)


def unit(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(axis=1, keepdims=True))
    return np.divide(a, n, out=np.zeros_like(a), where=n != 0)


def _by_rows(f: Callable) -> Callable:
    """``f`` of (rows, 1, dims) and (1, rows, dims), over as many rows of the first matrix at a time as fit."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, KERNEL_BYTES // max(1, 8 * b.size))
        return np.concatenate([f(a[i : i + step, None, :], b[None, :, :]) for i in range(0, len(a), step)] or [np.zeros((0, len(b)))])

    return run


def kernel(metric: str, p: float = 2.0, variance=None, inverse=None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two matrices that gives the distances between their rows."""
    if metric in _BOOLEAN:

        def boolean(a, b):
            x, y = (a != 0).astype(float), (b != 0).astype(float)
            tt = x @ y.T
            tf, ft = x.sum(axis=1)[:, None] - tt, y.sum(axis=1)[None, :] - tt
            return _BOOLEAN[metric](tt, tf, ft, a.shape[1] - tt - tf - ft, float(a.shape[1]), _np_safe)

        return boolean
    city = lambda x, y: np.abs(x - y).sum(axis=2)
    found = {
        "cosine": lambda a, b: 1 - unit(a) @ unit(b).T,
        "angle": lambda a, b: np.arccos(np.clip(unit(a) @ unit(b).T, -1, 1)),
        "correlation": lambda a, b: 1 - unit(a - a.mean(axis=1, keepdims=True)) @ unit(b - b.mean(axis=1, keepdims=True)).T,
        # Differences, not the expanded square: that loses all digits of near rows.
        "euclidean": _by_rows(lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=2))),
        "l2": _by_rows(lambda x, y: np.sqrt(((x - y) ** 2).sum(axis=2))),
        "sqeuclidean": _by_rows(lambda x, y: ((x - y) ** 2).sum(axis=2)),
        "cityblock": _by_rows(city),
        "manhattan": _by_rows(city),
        "l1": _by_rows(city),
        "chebyshev": _by_rows(lambda x, y: np.abs(x - y).max(axis=2)),
        "canberra": _by_rows(lambda x, y: _np_safe(np.abs(x - y), np.abs(x) + np.abs(y)).sum(axis=2)),
        "braycurtis": _by_rows(lambda x, y: _np_safe(np.abs(x - y).sum(axis=2), np.abs(x + y).sum(axis=2))),
        "hamming": _by_rows(lambda x, y: (x != y).mean(axis=2)),
        "minkowski": _by_rows(lambda x, y: (np.abs(x - y) ** p).sum(axis=2) ** (1 / p)),
        "seuclidean": _by_rows(lambda x, y: np.sqrt(((x - y) ** 2 / np.asarray(variance, float)).sum(axis=2))),
        "mahalanobis": _by_rows(lambda x, y: np.sqrt(np.einsum("ijk,kl,ijl->ij", x - y, np.asarray(inverse, float), x - y))),
    }.get(metric)
    if found is None:
        raise NotAllowedValue(f"unknown metric {metric}")
    return found
