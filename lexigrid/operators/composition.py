"""Phrase vectors from the vectors of two words.

Fitting reads ``(u, v, p)`` rows: the vectors of both words of a bigram and of
the bigram itself.  The scalar models have closed forms over sums that Spark
aggregates; the matrix models are partial least squares on the bigrams' rows,
whose count is bounded by a parameter-free quantity, the listed bigrams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import dot
from ..functions.errors import IncompatibleValue
from .vectors import matrix


def bigram_rows(vectors: DataFrame, bigrams: DataFrame | None = None) -> DataFrame:
    """``(first, second, u, v, p)`` of bigrams (``first second`` words) that have vectors, as do both of their words.

    ``bigrams`` is ``(word)``; by default all words of ``vectors`` with a space.
    """
    both = (vectors if bigrams is None else vectors.join(bigrams.select("word"), "word", "left_semi")).where(F.col("word").rlike("^[^ ]+ [^ ]+$"))
    parts = both.select(F.split("word", " ")[0].alias("first"), F.split("word", " ")[1].alias("second"), F.col("vec").alias("p"))
    u, v = vectors.select(F.col("word").alias("first"), F.col("vec").alias("u")), vectors.select(F.col("word").alias("second"), F.col("vec").alias("v"))
    return parts.join(u, "first").join(v, "second").select("first", "second", "u", "v", "p")


@dataclass(frozen=True)
class Additive:
    """alpha u + beta v."""

    alpha: float = 1.0
    beta: float = 1.0

    def __call__(self, u: Column, v: Column) -> Column:
        return F.zip_with(u, v, lambda x, y: F.lit(self.alpha) * x + F.lit(self.beta) * y)

    @staticmethod
    def sums(rows: DataFrame) -> DataFrame:
        """One row with the sums of the normal equations."""
        uu, vv, uv, up, vp = (F.sum(dot(F.col(a), F.col(b))).alias(a + b) for a, b in ("uu", "vv", "uv", "up", "vp"))
        return rows.agg(uu, vv, uv, up, vp)

    @classmethod
    def solved(cls, rows: DataFrame) -> DataFrame:
        """``(alpha, beta)`` of least squares as a row."""
        det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
        return cls.sums(rows).select(((F.col("up") * F.col("vv") - F.col("vp") * F.col("uv")) / det).alias("alpha"), ((F.col("vp") * F.col("uu") - F.col("up") * F.col("uv")) / det).alias("beta"))

    @classmethod
    def fit(cls, rows: DataFrame) -> Additive:
        s = cls.sums(rows).first()
        if s.uu is None:
            raise IncompatibleValue("no bigram to fit on")
        a, b = np.linalg.lstsq(np.array([[s.uu, s.uv], [s.uv, s.vv]]), np.array([s.up, s.vp]), rcond=None)[0]
        return cls(float(a), float(b))


@dataclass(frozen=True)
class Multiplicative:
    """The product of u and v by components."""

    def __call__(self, u: Column, v: Column) -> Column:
        return F.zip_with(u, v, lambda x, y: x * y)


@dataclass(frozen=True)
class Dilation:
    """(lambda - 1) (u.v) u + (u.u) v."""

    factor: float = 0.5

    def __call__(self, u: Column, v: Column) -> Column:
        uv, uu = dot(u, v), dot(u, u)
        return F.zip_with(u, v, lambda x, y: F.lit(self.factor - 1) * uv * x + uu * y)

    @staticmethod
    def solved(rows: DataFrame) -> DataFrame:
        """``(factor)`` of least squares as a row; null if no first word is linked to its second."""
        u, v, p = F.col("u"), F.col("v"), F.col("p")
        uu, uv = dot(u, u), dot(u, v)
        num = uv * (dot(p, u) - uu * uv)
        return rows.agg((1 + F.try_divide(F.sum(num), F.sum(uv * uv * uu))).alias("factor"))

    @classmethod
    def fit(cls, rows: DataFrame) -> Dilation:
        got = cls.solved(rows).first()[0]
        if got is None:
            raise IncompatibleValue("no bigram to fit on")
        return cls(float(got))


def partial_least_squares(x: np.ndarray, y: np.ndarray, components: int, rounds: int = 500, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercept of a PLS2 regression by NIPALS; both sides are centered, not scaled."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    a, b = x - mx, y - my
    ws, ps, qs = [], [], []
    for _ in range(min(components, x.shape[1], max(1, len(x) - 1))):
        if not (b * b).sum() > 1e-20 or not (a * a).sum() > 1e-20:
            break
        t_y = b[:, (b * b).sum(axis=0).argmax()]
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            old, w = w, a.T @ t_y
            w = w / (np.linalg.norm(w) or 1.0)
            t = a @ w
            q = b.T @ t / (t @ t or 1.0)
            t_y = b @ q / (q @ q or 1.0)
            if np.linalg.norm(w - old) < tolerance:
                break
        t = a @ w
        if not t @ t > 1e-20:
            break
        p, q = a.T @ t / (t @ t), b.T @ t / (t @ t)
        a, b = a - np.outer(t, p), b - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    if not ws:
        return np.zeros((x.shape[1], y.shape[1])), my
    w, p, q = (np.array(z).T for z in (ws, ps, qs))
    coef = w @ np.linalg.pinv(p.T @ w) @ q.T
    return coef, my - mx @ coef


def _applied(rows: DataFrame, coef: np.ndarray, intercept: np.ndarray, columns: tuple[str, ...]) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("u", "v", "p")]
    shared = rows.sparkSession.sparkContext.broadcast((coef, intercept))  # dims x dims: the model's size

    def run(batches):
        m, c = shared.value
        for b in batches:
            x = np.hstack([matrix(b.column(b.schema.get_field_index(n))) for n in columns]) if b.num_rows else np.zeros((0, len(m)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array((x @ m + c).tolist(), pa.list_(pa.float64()))], [*keep, "vec"])

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)
    return rows.mapInArrow(run, f"{kinds}, vec array<double>")


@dataclass(frozen=True)
class FullAdditive:
    """A u + B v, both matrices from one regression."""

    coef: np.ndarray
    intercept: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame) -> FullAdditive:
        got = rows.select("u", "v", "p").toArrow()
        if not got.num_rows:
            raise IncompatibleValue("no bigram to fit on")
        u, v, p = (matrix(got.column(c)) for c in "uvp")
        return cls(*partial_least_squares(np.hstack([u, v]), p, 2 * u.shape[1]))

    @property
    def a(self) -> np.ndarray:
        return self.coef[: len(self.coef) // 2].T

    @property
    def b(self) -> np.ndarray:
        return self.coef[len(self.coef) // 2 :].T

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (..., u, v) with ``vec`` instead of u and v."""
        return _applied(rows, self.coef, self.intercept, ("u", "v"))


@dataclass(frozen=True)
class Lexical:
    """U v, where the matrix stands for the first word."""

    word: str
    coef: np.ndarray
    intercept: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, word: str, components: int | None = None) -> Lexical:
        got = rows.where(F.col("first") == word).select("v", "p").toArrow()
        if not got.num_rows:
            raise IncompatibleValue(f"no bigram begins with {word}")
        v, p = matrix(got.column("v")), matrix(got.column("p"))
        n = components or len(v) // 4 or min(len(v), v.shape[1])
        return cls(word, *partial_least_squares(v, p, n))

    @property
    def u(self) -> np.ndarray:
        return self.coef.T

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (..., v) with ``vec`` instead of v."""
        return _applied(rows, self.coef, self.intercept, ("v",))


def compose(pairs: DataFrame, vectors: DataFrame, model) -> DataFrame:
    """``pairs`` (first, second) with ``vec`` by a model; pairs with a word that has no vector are left out."""
    u, v = vectors.select(F.col("word").alias("first"), F.col("vec").alias("u")), vectors.select(F.col("word").alias("second"), F.col("vec").alias("v"))
    at = pairs.join(u, "first").join(v, "second")
    if hasattr(model, "predict"):
        return model.predict(at)
    return at.select(*pairs.columns, model(F.col("u"), F.col("v")).alias("vec"))
