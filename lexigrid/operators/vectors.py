"""Queries over dense vectors ``(word, vec)``: neighbours, distances, histograms, isotropy.

Comparisons of all rows with all rows run on a grid of blocks: both sides are
dealt into blocks of ``BLOCK`` rows, every pair of blocks meets in one task as
two matrices, a strip of ``CELLS`` distances at a time, and only the nearest of
each block leave it.  A task's memory is bounded by the block at any size of
the table; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..functions import distance as D
from ..functions.errors import OutOfVocabulary

#: Rows are sent to as many tasks as the other side has blocks, so blocks are large; a strip's arrays have 8 bytes a cell.
BLOCK, CELLS = 16384, 1 << 22


def keyed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """A table's vectors as ``(word, vec)``, components as doubles; rows with a null id or vector are left out."""
    return rows.select(F.col(id_col).alias("word"), D.doubles(F.col(vec_col)).alias("vec")).where("word is not null and vec is not null")


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Row vectors of equal length as a matrix."""
    a = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(a.flatten(), float).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def _dealt(rows: DataFrame, own: str, other: str, blocks: int, others: int) -> DataFrame:
    """``rows``, each in its own block and once for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64(rows.columns[0]), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def grid(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK, once: bool = False) -> DataFrame:
    """``run`` on every pair of blocks, by strips of the left one's rows; the sides' first columns deal their rows.

    ``once``: both sides are the same rows, and two blocks meet in one order only.
    """
    n, m = (max(1, -(-x.count() // block)) for x in (left, right))
    # Columns of both sides may be the same ones of one table; the right one's get names, so identities, of their own.
    a, b = _dealt(left, "_l", "_r", n, m), _dealt(right.toDF(*[f"_{c}" for c in right.columns]), "_r", "_l", m, n)
    if once:
        a, b = a.where("_l <= _r"), b.where("_l <= _r")
    names = [*right.columns, "_r", "_l"]

    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def one(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return nothing
        y, step = y.rename_columns(names), max(1, CELLS // y.num_rows)
        return pa.concat_tables([run(x.slice(i, step), y) for i in range(0, x.num_rows, step)])

    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInArrow(one, schema)


def nearest(dist: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest of each row; of equal ones, to 12 digits, those with the lowest id.  ``skip`` marks cells to leave out."""
    d = dist if skip is None else np.where(skip, np.inf, dist)
    # What rounds to the same digits as the k-th is within the margin.
    rows, cols = _as_near(d, k, 2e-12)
    return _first(rows, cols, d[rows, cols], ids, k)


def _as_near(d: np.ndarray, k: int, margin) -> tuple[np.ndarray, np.ndarray]:
    """The finite cells of each row that are at most by ``margin`` above the row's k-th smallest: only these need sorting."""
    ok = np.isfinite(d)
    if 0 < k < d.shape[1]:
        ok &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + margin
    return np.nonzero(ok)


def _first(rows: np.ndarray, cols: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k cells of each row by distance, to 12 digits, and id; ``rows`` rise."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    order = np.lexsort((rank[cols], np.round(d, 12), rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _same(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Which cells have equal keys, without comparing all of them."""
    places: dict = {}
    for j, x in enumerate(b.to_pylist()):
        places.setdefault(x, []).append(j)
    out = np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(a.to_pylist()):
        out[i, places.get(x, [])] = True
    return out


def _near_euclidean(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, skip: np.ndarray | None, root: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k nearest: the expanded square, which loses digits, only tells which cells' differences are needed."""
    xx, yy = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
    about = xx + yy - 2 * (x @ y.T)
    if skip is not None:
        about[skip] = np.inf
    size = xx + yy.max()
    rows, cols = _as_near(about, k, 1e-14 * (64 + 4 * x.shape[1]) * size + 8e-12 * (1 + np.sqrt(size)))
    d = np.concatenate([((x[rows[i : i + 65536]] - y[cols[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
    d = np.sqrt(d) if root else d
    width = len(ids)
    cell = rows * width + cols
    rows, cols = _first(rows, cols, d, ids, k)
    return rows, cols, d[np.searchsorted(cell, rows * width + cols)]


def closest(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = True, **options) -> DataFrame:
    """``(query, word, distance, rank)``: the k nearest rows of each query row, ranks from 1; exact.

    ``queries`` and ``vectors`` are ``(word, vec)``.  A query doesn't find the
    row of its own id unless ``exclude_self`` is off.  Equal distances are
    ranked by id.
    """
    f = D.kernel(metric, **options)
    kind, found = queries.schema["word"].dataType.simpleString(), vectors.schema["word"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        q, w = x.column("word"), y.column("word")
        u, v, ws = matrix(x.column("vec")), matrix(y.column("vec")), np.array(w.to_pylist(), object)
        skip = _same(q, w) if exclude_self else None
        if metric in ("euclidean", "l2", "sqeuclidean"):
            rows, cols, near = _near_euclidean(u, v, ws, k, skip, metric != "sqeuclidean")
        else:
            d = f(u, v)
            rows, cols = nearest(d, ws, k, skip)
            near = d[rows, cols]
        return pa.table({"query": q.take(pa.array(rows)), "word": w.take(pa.array(cols)), "distance": pa.array(near)})

    near = grid(queries.select("word", "vec"), vectors.select("word", "vec"), run, f"query {kind}, word {found}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 12), "word"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def vectors_of(spark, named: dict | Sequence) -> DataFrame:
    """``(word, vec)`` from a dict of words, or from vectors that get their number as a name."""
    items = named.items() if isinstance(named, dict) else ((str(i), v) for i, v in enumerate(named))
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in items], "word string, vec array<double>")


def pairwise(left: DataFrame, right: DataFrame, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cosine", **options) -> DataFrame:
    """``(a, b, distance)`` of all rows of one side with all of the other; a callable takes two matrices."""
    f = metric if callable(metric) else D.kernel(metric, **options)
    ka, kb = left.schema["word"].dataType.simpleString(), right.schema["word"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = x.column("word"), y.column("word")
        d = f(matrix(x.column("vec")), matrix(y.column("vec")))
        at = pa.array(np.repeat(np.arange(len(a)), len(b))), pa.array(np.tile(np.arange(len(b)), len(a)))
        return pa.table({"a": a.take(at[0]), "b": b.take(at[1]), "distance": pa.array(d.ravel())})

    return grid(left.select("word", "vec"), right.select("word", "vec"), run, f"a {ka}, b {kb}, distance double", 1024)


def pair_totals(left: DataFrame, right: DataFrame, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cosine", **options) -> DataFrame:
    """``(a, total, n)``: the sum of each left row's distances to all right rows, and their number; no pair leaves its task.

    City-block distances are added up component by component, from the sorted
    components and their running sums.
    """
    f = metric if callable(metric) else D.kernel(metric, **options)
    kind = left.schema["word"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        u, v = matrix(x.column("vec")), matrix(y.column("vec"))
        total = _city_totals(u, v) if metric in ("cityblock", "manhattan", "l1") else f(u, v).sum(axis=1)
        return pa.table({"a": x.column("word"), "total": pa.array(total), "n": pa.array(np.full(len(u), len(v)))})

    return grid(left.select("word", "vec"), right.select("word", "vec"), run, f"a {kind}, total double, n long").groupBy("a").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _city_totals(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(u))
    for x, y in zip(u.T, v.T):
        y = np.sort(y)
        sums = np.append(0.0, np.cumsum(y))
        below = np.searchsorted(y, x)
        total += x * (2 * below - len(y)) + sums[-1] - 2 * sums[below]
    return total


def distances(pairs: DataFrame, vectors: DataFrame, metric: str | Callable[[Column, Column], Column] = "cosine", **options) -> DataFrame:
    """``pairs`` (a, b, ...) with ``distance``; a pair with a word that has no vector gets null."""
    f = metric if callable(metric) else D.column(metric, **options)
    u, v = vectors.select(F.col("word").alias("a"), F.col("vec").alias("_u")), vectors.select(F.col("word").alias("b"), F.col("vec").alias("_v"))
    return pairs.join(u, "a", "left").join(v, "b", "left").select(*pairs.columns, f(F.col("_u"), F.col("_v")).alias("distance"))


def distance(vectors: DataFrame, a, b, metric: str = "cosine", **options) -> float:
    """The distance of two words; a word without a vector is an error."""
    have = {r.word: r.vec for r in vectors.where(F.col("word").isin([a, b])).collect()}
    for w in (a, b):
        if w not in have:
            raise OutOfVocabulary(w)
    return float(D.kernel(metric, **options)(np.array([have[a]], float), np.array([have[b]], float))[0, 0])


def column_statistics(vectors: DataFrame) -> tuple[list[float], np.ndarray]:
    """Variance of each component and the inverse covariance (both with n - 1), for seuclidean and mahalanobis.

    Tasks add up matrices of dims x dims; the driver adds one for each task.
    """

    def run(batches):
        n, s, q = 0, None, None
        for b in batches:
            a = matrix(b.column(0))
            if len(a):
                n, s, q = n + len(a), a.sum(axis=0) + (0 if s is None else s), a.T @ a + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    parts = vectors.select("vec").mapInArrow(run, "n long, s array<double>, q array<double>").collect()
    n, s = sum(r.n for r in parts), np.sum([r.s for r in parts], axis=0)
    q = np.sum([r.q for r in parts], axis=0).reshape(len(s), len(s))
    cov = (q - np.outer(s, s) / n) / (n - 1)
    return np.diag(cov).tolist(), np.linalg.pinv(cov)


def angles(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """``(word, angle)`` between each row and one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("word", D.angle(F.col("vec"), q).alias("angle"))


def histogram(values: DataFrame, edges: Sequence[float], value: str = "distance") -> DataFrame:
    """``(bin, low, high, n)`` for each bin: half-open, the last one closed; values outside are dropped, empty bins have 0."""
    x, last = F.col(value), len(edges) - 2
    # The bin is where a value falls in the list of edges; tasks count before the shuffle.
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1
    found = values.where(x.between(float(edges[0]), float(edges[-1]))).groupBy(F.least(at, F.lit(last)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = values.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bin int, low double, high double")
    return bins.join(found, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def word_histogram(vectors: DataFrame, word, edges: Sequence[float], metric: str = "angle") -> DataFrame:
    """Distances of one word to all others, by bins."""
    row = vectors.where(F.col("word") == word).select("vec").first()
    if row is None:
        raise OutOfVocabulary(word)
    q = F.array(*[F.lit(float(x)) for x in row.vec])
    return histogram(vectors.where(F.col("word") != word).select(D.column(metric)(F.col("vec"), q).alias("distance")), edges)


def word_histograms(vectors: DataFrame, edges: Sequence[float], metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "angle", block: int = BLOCK, words: DataFrame | None = None) -> DataFrame:
    """``(word, bin, n)``: the distances of each word, or each of ``words``, to all others, by bins that aren't empty; the bins are ``histogram``'s."""
    f, cuts = metric if callable(metric) else D.kernel(metric), np.array(edges, float)
    kind = vectors.schema["word"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        a = x.column("word")
        d = f(matrix(x.column("vec")), matrix(y.column("vec")))
        ok = ~_same(a, y.column("word")) & (d >= cuts[0]) & (d <= cuts[-1])
        bins = np.minimum(np.searchsorted(cuts, d, "right") - 1, len(cuts) - 2)
        counts = np.bincount((np.arange(len(a))[:, None] * (len(cuts) - 1) + bins)[ok], minlength=len(a) * (len(cuts) - 1))
        at = np.flatnonzero(counts)
        return pa.table({"word": x.column("word").take(pa.array(at // (len(cuts) - 1))), "bin": pa.array((at % (len(cuts) - 1)).astype(np.int32)), "n": pa.array(counts[at])})

    return grid((vectors if words is None else words).select("word", "vec"), vectors.select("word", "vec"), run, f"word {kind}, bin int, n long", block).groupBy("word", "bin").agg(F.sum("n").alias("n"))


def pair_histogram(vectors: DataFrame, edges: Sequence[float], metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "angle", block: int = BLOCK) -> DataFrame:
    """Distances of all pairs of different words, each pair once, by bins.

    Every pair of blocks counts its own bins; no pair leaves its task.  Angles
    are the same in both directions, so two blocks meet once, and their bins
    are read off the cosines (``_angle_counts``).
    """
    f, cuts, last = metric if callable(metric) else D.kernel(metric), np.array(edges, float), len(edges) - 2
    once = metric == "angle"

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = (t.column("word").to_numpy() for t in (x, y))
        u, v = matrix(x.column("vec")), matrix(y.column("vec"))
        # Equal words are in one block, so that only a block with itself needs its words compared.
        alone = x.column("_l")[0] == x.column("_r")[0] if once else True
        chosen = a[:, None] < b[None, :] if alone else None
        if once:
            counts = _angle_counts(u, v, cuts, chosen)
        else:
            counts = np.histogram(f(u, v)[chosen], cuts)[0]
        return pa.table({"bin": pa.array(np.arange(last + 1), pa.int32()), "n": pa.array(counts)})

    slim = vectors.select("word", "vec")
    found = grid(slim, slim, run, "bin int, n long", block, once).groupBy("bin").agg(F.sum("n").alias("n"))
    bins = vectors.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bin int, low double, high double")
    return bins.join(found, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


#: Cosines are counted in this many steps.
STEPS = 1 << 15


def _angle_counts(u: np.ndarray, v: np.ndarray, cuts: np.ndarray, chosen: np.ndarray | None) -> np.ndarray:
    """The angles between rows by bins, of all or of the chosen cells: those of ``np.histogram``.

    Cosines are counted by step; a step lies within one bin, but for those at
    an edge, near 1 and near -1, whose cells' angles are computed.
    """
    c = D.unit(u) @ D.unit(v).T
    exact = lambda x: np.histogram(np.arccos(np.clip(x, -1, 1)), cuts)[0]
    if np.isnan(c.sum()) or (np.diff(cuts) <= 0).any():
        return exact(c if chosen is None else c[chosen])
    # A margin of a step on either side holds what rounding moves.
    ends = np.arccos(np.clip((np.arange(STEPS + 4)[:, None] + np.array([[1, -2]])) * (2 / STEPS) - 1, -1, 1))
    low, high = (np.searchsorted(cuts, x, "right") - 1 for x in ends.T)
    size = len(cuts) - 1
    bins = np.where((low == high) & (low >= 0) & (low < size), low, np.where((low == high) & ((low < 0) | (low >= size)), size, -1))
    bins[:4] = bins[-4:] = -1
    unsure = bins < 0
    total, steps = np.zeros(size, np.int64), np.zeros(len(bins), np.int64)
    # A few rows at a time stay in the processor's cache.
    for i in range(0, len(c), rows := max(1, (1 << 18) // max(1, c.shape[1]))):
        x = c[i : i + rows]
        x = x.ravel() if chosen is None else x[chosen[i : i + rows]]
        step = (x * (STEPS / 2) + (STEPS / 2 + 1)).astype(np.int32)
        steps += np.bincount(step, minlength=len(bins))
        total += exact(x[unsure[step]])
    within = ~unsure & (bins < size)
    total += np.bincount(bins[within], steps[within], size).astype(np.int64)
    return total


def random_directions(vectors: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """``(c, vec)``: unit Gaussian directions scaled by sqrt(dims) / 5 / the mean norm of the vectors."""
    row = vectors.agg(F.avg(D.norm(F.col("vec"))).alias("mu"), F.max(F.size("vec")).alias("d")).first()
    g = np.random.default_rng(seed).standard_normal((n, row.d))
    g = D.unit(g) * (np.sqrt(row.d) / 5 / row.mu)
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "c int, vec array<double>")


def partition_values(vectors: DataFrame, directions: DataFrame) -> DataFrame:
    """``(c, z)``: the sum over all words of exp(direction . vector).

    Tasks add up one number for each direction, so words are never paired with
    directions as rows; the directions' count is a parameter and they are
    carried to the tasks.
    """
    rows = sorted(directions.collect())
    c, w = pa.array([r[0] for r in rows], to_arrow_type(directions.schema[0].dataType)), np.array([r[1] for r in rows], float)
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        z = np.zeros(len(c))
        for b in batches:
            a = matrix(b.column(0))
            for i in range(0, len(a), 1024):
                z += np.exp(a[i : i + 1024] @ shared.value.T).sum(axis=0)
        yield pa.RecordBatch.from_arrays([c, pa.array(z)], ["c", "z"])

    kind = directions.schema[directions.columns[0]].dataType.simpleString()
    return vectors.select("vec").mapInArrow(run, f"c {kind}, z double").groupBy("c").agg(F.sum("z").alias("z"))


def isotropy(vectors: DataFrame, directions: DataFrame | None = None, epsilon: float = 0.1) -> DataFrame:
    """One row ``(share, mean, n)``: the share of directions whose partition value is strictly within 1 - epsilon and 1 + epsilon times the mean."""
    z = partition_values(vectors, random_directions(vectors) if directions is None else directions)
    mean = z.agg(F.avg("z").alias("mean"))
    inside = (F.col("z") > (1 - epsilon) * F.col("mean")) & (F.col("z") < (1 + epsilon) * F.col("mean"))
    return z.crossJoin(F.broadcast(mean)).agg(F.avg(inside.cast("double")).alias("share"), F.first("mean").alias("mean"), F.count(F.lit(1)).alias("n"))

