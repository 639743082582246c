"""Word mover's distance: the cheapest way to move one sentence's words onto another's.

The exact distance is a transport problem for each pair, solved in Arrow
workers; two lower bounds are relational and serve as prefilters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from .vectors import matrix


def transport(supply: list[int], demand: list[int], cost: np.ndarray) -> tuple[float, np.ndarray]:
    """The least cost of moving integer supplies onto integer demands of the same sum, and the flow.

    Successive shortest paths over the bipartite graph with potentials, so that
    reduced costs stay at least 0; every round moves what the path allows.
    """
    n, m = cost.shape
    left, want = np.array(supply, np.int64), np.array(demand, np.int64)
    flow = np.zeros((n, m), np.int64)
    u, v = np.zeros(n), np.zeros(m)
    while left.sum():
        du, dv = np.where(left > 0, 0.0, inf), np.full(m, inf)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        from_u, from_v = np.full(n, -1), np.full(m, -1)
        end = -1
        while True:
            a = np.where(done_u, inf, du)
            b = np.where(done_v, inf, dv)
            i, j = int(a.argmin()), int(b.argmin())
            if a[i] <= b[j]:
                if a[i] == inf:
                    raise ValueError("supplies and demands have different sums")
                done_u[i] = True
                step = du[i] + np.maximum(cost[i] + u[i] - v, 0)
                better = ~done_v & (step < dv)
                dv[better], from_v[better] = step[better], i
            else:
                done_v[j] = True
                if want[j] > 0:
                    end = j
                    break
                back = dv[j] + np.maximum(-(cost[:, j] + u - v[j]), 0)
                better = ~done_u & (flow[:, j] > 0) & (back < du)
                du[better], from_u[better] = back[better], j
        top = dv[end]
        u += np.minimum(du, top)
        v += np.minimum(dv, top)
        path, j = [], end
        while True:
            i = from_v[j]
            path.append((i, j, 1))
            if from_u[i] < 0:
                break
            path.append((i, from_u[i], -1))
            j = from_u[i]
        amount = min([left[path[-1][0]], want[end], *(flow[i, k] for i, k, s in path if s < 0)])
        for i, k, s in path:
            flow[i, k] += s * amount
        left[path[-1][0]] -= amount
        want[end] -= amount
    return float((flow * cost).sum()), flow


def bags(sentences: DataFrame, vectors: DataFrame, stopwords: Iterable[str] = ()) -> DataFrame:
    """``(id, word, n, share, vec)``: each sentence's words with a vector that aren't stopwords.

    ``sentences`` is ``(id, tokens)``.
    """
    at = sentences.select("id", F.explode("tokens").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    stop = list(stopwords)
    if stop:
        at = at.where(~F.col("word").isin(stop))
    at = at.join(vectors.select("word", "vec"), "word")
    sums = at.groupBy("id").agg(F.sum("n").alias("total"))
    return at.join(sums, "id").select("id", "word", "n", (F.col("n") / F.col("total")).alias("share"), "vec")


def _sides(pairs: DataFrame, sentences: DataFrame, vectors: DataFrame, stopwords: Iterable[str]) -> DataFrame:
    """``pairs`` (a, b) with the bags ``x`` and ``y`` of both sides, null where a side has no known word."""
    folded = bags(sentences, vectors, stopwords).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", F.col("n").cast("long").alias("n"), "vec"))).alias("bag"))
    return pairs.select("a", "b").distinct().join(folded.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a", "left").join(folded.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b", "left").select("a", "b", "x", "y")


def word_mover_distance(
    pairs: DataFrame, sentences: DataFrame, vectors: DataFrame, stopwords: Iterable[str] = (), metric: str = "euclidean", emd: Callable = transport, **options
) -> DataFrame:
    """``(a, b, distance, flow)`` of pairs of sentence ids.

    ``distance`` is NaN and ``flow`` empty if a side is left without a word.
    ``flow`` has what moves from which word to which, as shares.  ``emd`` may be
    any function of integer supplies, demands and costs that returns cost and
    flow.
    """
    f = D.kernel(metric, **options)
    both = _sides(pairs, sentences, vectors, stopwords)
    ids = both.schema["a"].dataType.simpleString(), both.schema["b"].dataType.simpleString()
    kind = pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for t in batches:
            dist, flows = [], []
            for x, y in zip(t.column("x"), t.column("y")):
                if not x.is_valid or not y.is_valid:
                    dist.append(float("nan"))
                    flows.append([])
                    continue
                words, counts, mats = zip(*((s.values.field("word").to_pylist(), s.values.field("n").to_pylist(), matrix(s.values.field("vec"))) for s in (x, y)))
                total = [sum(c) for c in counts]
                # Shares become whole numbers over the product of both sizes, so that the flow is exact.
                scale = total[0] * total[1]
                cost, flow = emd([c * total[1] for c in counts[0]], [c * total[0] for c in counts[1]], f(*mats))
                dist.append(cost / scale)
                flows.append([{"source": words[0][i], "target": words[1][j], "share": flow[i, j] / scale} for i, j in zip(*np.nonzero(flow))])
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(dist, pa.float64()), pa.array(flows, kind)], ["a", "b", "distance", "flow"])

    return both.mapInArrow(run, f"a {ids[0]}, b {ids[1]}, distance double, flow array<struct<source:string,target:string,share:double>>")


def centroid_distance(pairs: DataFrame, sentences: DataFrame, vectors: DataFrame, stopwords: Iterable[str] = ()) -> DataFrame:
    """``(a, b, distance)``: the Euclidean distance of the mean vectors, at most the word mover's distance."""
    mean = (
        bags(sentences, vectors, stopwords)
        .select("id", "share", F.posexplode("vec").alias("d", "x"))
        .groupBy("id", "d")
        .agg(F.sum(F.col("share") * F.col("x")).alias("x"))
        .groupBy("id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p.x).alias("m"))
    )
    u, v = mean.select(F.col("id").alias("a"), F.col("m").alias("u")), mean.select(F.col("id").alias("b"), F.col("m").alias("v"))
    return pairs.select("a", "b").distinct().join(u, "a").join(v, "b").select("a", "b", D.column("euclidean")(F.col("u"), F.col("v")).alias("distance"))


def relaxed_distance(pairs: DataFrame, sentences: DataFrame, vectors: DataFrame, stopwords: Iterable[str] = (), metric: str = "euclidean") -> DataFrame:
    """``(a, b, distance)``: every word moves to its nearest on the other side, the dearer of both directions; at most the word mover's distance."""
    f: Callable[[Column, Column], Column] = D.column(metric)
    at = bags(sentences, vectors, stopwords)
    x = at.select(F.col("id").alias("a"), F.col("word").alias("wa"), F.col("share").alias("sa"), F.col("vec").alias("va"))
    y = at.select(F.col("id").alias("b"), F.col("word").alias("wb"), F.col("share").alias("sb"), F.col("vec").alias("vb"))
    cost = pairs.select("a", "b").distinct().join(x, "a").join(y, "b").select("a", "b", "wa", "wb", "sa", "sb", f(F.col("va"), F.col("vb")).alias("c"))
    there = cost.groupBy("a", "b", "wa").agg(F.min("c").alias("c"), F.first("sa").alias("s")).groupBy("a", "b").agg(F.sum(F.col("c") * F.col("s")).alias("d1"))
    back = cost.groupBy("a", "b", "wb").agg(F.min("c").alias("c"), F.first("sb").alias("s")).groupBy("a", "b").agg(F.sum(F.col("c") * F.col("s")).alias("d2"))
    return there.join(back, ["a", "b"]).select("a", "b", F.greatest("d1", "d2").alias("distance"))
