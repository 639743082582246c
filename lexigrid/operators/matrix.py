"""Algebra of sparse matrices ``(word, ctx, value)`` and dense rows ``(word, vec)``."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import IncompatibleValue, NotAllowedValue
from ..plans.store import materialize


def normalize(cells: DataFrame, norm: str = "l2", by: str = "word") -> DataFrame:
    """Cells over their row's norm (``by`` = word) or column's (ctx): l1, l2 or max; rows of norm 0 stay."""
    v = F.col("value")
    size = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "max": F.max(F.abs(v))}.get(norm)
    if size is None:
        raise NotAllowedValue(f"unknown norm {norm}")
    sums = cells.groupBy(by).agg(size.alias("size"))
    return cells.join(sums, by).select("word", "ctx", F.when(F.col("size") == 0, v).otherwise(v / F.col("size")).alias("value"))


def center(rows: DataFrame, axis: int | None = 0) -> DataFrame:
    """Dense rows less the mean of each column (0), of each row (1), or of all."""
    if axis == 1:
        mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / F.size("vec")
        return rows.withColumn("m", mean).select("word", F.transform("vec", lambda x: x - F.col("m")).alias("vec"))
    at = rows.select(F.posexplode("vec").alias("k", "x"))
    if axis is None:
        return rows.crossJoin(F.broadcast(at.agg(F.avg("x").alias("m")))).select("word", F.transform("vec", lambda x: x - F.col("m")).alias("vec"))
    means = at.groupBy("k").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p.x).alias("m"))
    return rows.crossJoin(F.broadcast(means)).select("word", F.zip_with("vec", "m", lambda x, m: x - m).alias("vec"))


def each(cells: DataFrame, f) -> DataFrame:
    """A Column function of every stored value, such as sqrt or log."""
    return cells.withColumn("value", f(F.col("value")))


def multiply_rows(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Each row times its factor ``(word, factor)``; rows without one vanish."""
    return cells.join(factors, "word").select("word", "ctx", (F.col("value") * F.col("factor")).alias("value"))


def replace_negative_or_zeros_by(cells: DataFrame, x: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("value") <= 0, F.lit(float(x))).otherwise(F.col("value")))


def nnz_per_row(cells: DataFrame) -> DataFrame:
    return cells.where("value <> 0").groupBy("word").agg(F.count(F.lit(1)).alias("nnz"))


def all_positive(cells: DataFrame) -> bool:
    """No stored value is negative."""
    return cells.where("value < 0").isEmpty()


def add(*parts: DataFrame) -> DataFrame:
    """The sum of matrices over all their words and contexts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("word", "ctx").agg(F.sum("value").alias("value"))


def as_dense(cells: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(word, vec)`` with the contexts in the order of their vocabulary; absent cells are 0."""
    n = contexts.count()
    at = cells.join(contexts.select(F.col("word").alias("ctx"), "idx"), "ctx").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx"), "value"))).alias("m"))
    return at.select("word", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def labelled(cells: DataFrame, value: str = "value") -> DataFrame:
    """One row a word and one column a context, for display."""
    return cells.groupBy("word").pivot("ctx").sum(value)


def allclose(a: DataFrame, b: DataFrame, tolerance: float = 1e-8) -> bool:
    both = a.select("word", "ctx", F.col("value").alias("x")).join(b.select("word", "ctx", F.col("value").alias("y")), ["word", "ctx"], "full")
    return both.where(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) > tolerance).isEmpty()


def rows_of(cells: DataFrame, words: DataFrame) -> DataFrame:
    return cells.join(words.select("word"), "word", "left_semi")


def svd(cells: DataFrame, dimensions: int, weight: float = 1.0, add_context_vectors: bool = False, symmetric: bool = False) -> DataFrame:
    """``(word, vec)``: U times the singular values to the power ``weight``.

    Computed in the JVM by the distributed row matrix of MLlib.  Components
    come with falling singular values; the entry of largest magnitude of each
    right vector is positive.  ``add_context_vectors`` adds the vectors of a
    context to those of the word of the same name: V times the singular values
    to the power 1 - ``weight``, or ``weight`` if ``symmetric``.
    """
    from pyspark.mllib.linalg import Vectors, VectorUDT
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.sql.types import LongType, StructField, StructType

    if not 0 <= weight <= 1:
        warnings.warn("the weight is usually between 0 and 1", stacklevel=2)
    words = [r[0] for r in cells.select("word").distinct().orderBy("word").collect()]
    ctxs = [r[0] for r in cells.select("ctx").distinct().orderBy("ctx").collect()]
    if dimensions < 1 or dimensions > min(len(words), len(ctxs)):
        raise IncompatibleValue(f"{dimensions} dimensions of a {len(words)} x {len(ctxs)} matrix")
    spark = cells.sparkSession
    wi = spark.createDataFrame(list(zip(words, range(len(words)))), "word string, i long")
    ci = spark.createDataFrame(list(zip(ctxs, range(len(ctxs)))), "ctx string, j int")
    packed = cells.join(wi, "word").join(ci, "ctx").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("r"))
    width = len(ctxs)
    kind = StructType([StructField("index", LongType()), StructField("vector", VectorUDT())])
    made = spark.createDataFrame(packed.rdd.map(lambda r: (r.i, Vectors.sparse(width, [x.j for x in r.r], [x.value for x in r.r]))), kind)
    # Each step of the solver reads the rows: they are written as vectors once, so that it stays in the JVM, and held where there is room.
    rows = materialize(made, "rows").persist()
    got = IndexedRowMatrix(rows, len(words), width).computeSVD(dimensions, computeU=True)
    s = got.s.toArray()
    v = got.V.toArray()
    k = len(s)
    sign = [1.0 if v[abs(v[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    good = [x > 1e-9 * max(1e-300, s[0]) for x in s]
    scale = [float(s[j] ** weight * sign[j]) if good[j] else 0.0 for j in range(k)]
    pad = dimensions - k

    def row(r):
        return int(r.index), [float(x) * c if c else 0.0 for x, c in zip(r.vector.toArray(), scale)] + [0.0] * pad

    left = materialize(spark.createDataFrame(got.U.rows.map(row), "i long, vec array<double>").join(wi, "i").select("word", "vec"), "vectors")
    rows.unpersist()
    if not add_context_vectors:
        return left
    power = weight if symmetric else 1 - weight
    right = spark.createDataFrame([(c, [float(v[j, d] * sign[d] * s[d] ** power) if good[d] else 0.0 for d in range(k)] + [0.0] * pad) for j, c in enumerate(ctxs)], "word string, c array<double>")
    return left.join(right, "word", "left").select("word", F.when(F.col("c").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "c", lambda a, b: a + b)).alias("vec"))


def pca(cells: DataFrame, dimensions: int) -> DataFrame:
    """Truncated SVD of the matrix as it is, not centered: U times the singular values."""
    return svd(cells, dimensions, 1.0)
