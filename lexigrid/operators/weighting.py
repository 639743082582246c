"""Weightings of count cells ``(word, ctx, n)`` to ``(word, ctx, value)``.

Sums by row and column are aggregated first (one row a word or context) and
joined back; whether a side is broadcast is up to the sizes that Spark measures at run time.  Cells that a
weighting makes 0 are left out where absent cells are 0.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import NotAllowedValue


def _total(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells.agg(F.sum("n").cast("double").alias("total")))


def joint(cells: DataFrame) -> DataFrame:
    """n / sum of all n."""
    return cells.crossJoin(_total(cells)).select("word", "ctx", (F.col("n") / F.col("total")).alias("value"))


def conditional(cells: DataFrame) -> DataFrame:
    """n / sum of the word's n."""
    rows = cells.groupBy("word").agg(F.sum("n").cast("double").alias("row"))
    return cells.join(rows, "word").select("word", "ctx", (F.col("n") / F.col("row")).alias("value"))


def ratio(cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """P(ctx | word) / P(ctx), context counts raised to ``alpha``."""
    if alpha <= 0:
        raise NotAllowedValue(f"alpha is positive: {alpha}")
    rows = cells.groupBy("word").agg(F.sum("n").cast("double").alias("row"))
    cols = cells.groupBy("ctx").agg(F.pow(F.sum("n").cast("double"), F.lit(float(alpha))).alias("col"))
    all_ = F.broadcast(cols.agg(F.sum("col").alias("cols")))
    at = cells.where("n <> 0").join(rows, "word").join(cols, "ctx").crossJoin(all_)
    return at.select("word", "ctx", ((F.col("n") / F.col("row")) / (F.col("col") / F.col("cols"))).alias("value"))


def pmi(cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The logarithm of ``ratio``; cells without a count stay absent."""
    return ratio(cells, alpha).withColumn("value", F.log("value"))


def shifted_ppmi(cells: DataFrame, alpha: float = 1.0, shift: float = 1.0) -> DataFrame:
    """max(pmi - log(shift), 0)."""
    if shift < 1:
        raise NotAllowedValue(f"the shift is at least 1: {shift}")
    return pmi(cells, alpha).withColumn("value", F.col("value") - F.lit(log(shift))).where("value > 0")


def ppmi(cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """max(pmi, 0)."""
    return shifted_ppmi(cells, alpha, 1.0)


def tfidf(cells: DataFrame, n_contexts: int | None = None) -> DataFrame:
    """P(ctx | word) * log(contexts / contexts of the word).

    ``n_contexts`` counts all columns, also those without a cell; by default
    the contexts found.
    """
    rows = cells.groupBy("word").agg(F.sum("n").cast("double").alias("row"), F.count(F.lit(1)).alias("nnz"))
    if n_contexts is None:
        width = F.broadcast(cells.select("ctx").distinct().agg(F.count(F.lit(1)).alias("width")))
        at = cells.join(rows, "word").crossJoin(width)
    else:
        at = cells.join(rows, "word").withColumn("width", F.lit(n_contexts))
    return at.select("word", "ctx", (F.col("n") / F.col("row") * F.log(F.col("width") / F.col("nnz"))).alias("value"))


def create_representation(cells: DataFrame, weighting=None, reduction=None) -> DataFrame:
    """Cells after a weighting and a reduction; either may be any DataFrame -> DataFrame callable."""
    for f in (weighting, reduction):
        if f is not None and not callable(f):
            raise NotAllowedValue("a weighting or reduction is a callable")
    out = weighting(cells) if weighting else cells.select("word", "ctx", F.col("n").cast("double").alias("value"))
    return reduction(out) if reduction else out
