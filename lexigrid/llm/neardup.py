"""Near duplicates by MinHash with sequential Bayesian verification.

Texts are sets of word shingles.  Banded MinHash signatures propose pairs.
Each pair's signatures are compared a batch of rows at a time; after every
batch the posterior of the similarity, given the matches so far, tells whether
the pair can still reach the threshold, and it is pruned once the chance is
under the miss probability.  Survivors are verified by the exact Jaccard
similarity of their shingle sets.  Groups are the connected components of the
verified pairs.

Work in a bucket isn't quadratic in its members.  First every member is tried
against the bucket's lowest id only.  Members that this joins need no other
pair.  Buckets that still hold several components are searched for pairs
across these: small ones pair by pair, the members of others through the rare
shingles that a pair of enough similarity must share (prefixes of the sets in
the order of rising frequency), so pages of one template, whose common
shingles are the frequent ones, don't meet.  What this leaves out can't reach
the threshold; so the components are those of all banded candidates.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from . import common as C

SHINGLE, ROWS, BANDS, BATCH = 2, 4, 32, 16
THRESHOLD, MISS = 0.6, 0.001
#: Members of a bucket that are compared pair by pair, and rows of a shingle that one task compares with as many; neither changes a result.
FEW, BLOCK = 32, 1024
#: Frequent shingles that are sent to the workers (16 bytes each); more are joined.
SENT = C.BROADCAST_BYTES // 16

_r = np.random.default_rng(11)
_MUL = (_r.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) << 1) | 1
_XOR = _r.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_BMUL = _r.integers(0, 2**63, ROWS, dtype=np.uint64) * 2 + 1


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, rows: int = ROWS * BANDS, batch: int = BATCH) -> list[int]:
    """For n = batch, 2 batch, ... rows: the fewest matches with which P(similarity >= threshold) is at least ``miss``, from a uniform prior."""
    out = []
    for n in range(batch, rows + 1, batch):
        p, m = 0.0, -1
        while p < miss and m < n:
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sign(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The MinHash signatures, one row for each set that isn't empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = rows[:-1][np.diff(rows) > 0]
    out = np.empty((ROWS * BANDS, len(starts)), np.uint32)
    buf = np.empty_like(x)
    for k in range(ROWS * BANDS):
        np.bitwise_xor(x, _XOR[k], out=buf)
        np.multiply(buf, _MUL[k], out=buf)
        np.bitwise_xor(buf, buf >> np.uint32(15), out=buf)
        np.minimum.reduceat(buf, starts, out=out[k])
    return np.ascontiguousarray(out.T)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of it."""
    v = (sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) * _BMUL).sum(axis=2, dtype=np.uint64)
    return A.mix(v + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(texts: pa.Array):
    """Sorted distinct shingle hashes of each text, laid end to end, and their offsets."""
    h, r = A.shingles(*A.words(*A.flat(texts)), SHINGLE)
    row = np.repeat(np.arange(len(r) - 1), np.diff(r))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(r)))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, whole, sig, bands)`` of each text that has a word; ``whole`` is a 128-bit key of the shingle multiset's words in order."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches):
        import xxhash

        for b in A.slices(batches, "text"):
            data, o = A.flat(A.column(b, "text"))
            words, wr = A.words(data, o)
            h, r = A.shingles(words, wr, SHINGLE)
            has = np.flatnonzero(np.diff(r) > 0)
            if not len(has):
                continue
            sig = sign(h, r)
            whole = [xxhash.xxh3_128_digest(words[wr[i] : wr[i + 1]]) for i in has]
            raw = pa.array([s.tobytes() for s in sig], pa.binary())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(has) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands(sig).ravel()))
            yield pa.RecordBatch.from_arrays([A.column(b, "id").take(pa.array(has)), pa.array(whole, pa.binary()), raw, keys], ["id", "whole", "sig", "bands"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, whole binary, sig binary, bands array<long>")


def survives(a: np.ndarray, b: np.ndarray, least: list[int], batch: int = BATCH) -> np.ndarray:
    """Which of the signature pairs pass every batch's bound."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        s = slice(k * batch, (k + 1) * batch)
        matches[live] += (a[live, s] == b[live, s]).sum(axis=1)
        live = live[matches[live] >= m]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _matrix(sigs: pa.Array) -> np.ndarray:
    data, _ = A.flat(sigs)
    return data.view(np.uint32).reshape(len(sigs), ROWS * BANDS)


def _prune(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that share a band and that their signatures don't rule out."""
    least = least_matches(threshold, miss)
    both = pairs.join(sigs.selectExpr("id as a", "sig as sa"), "a").join(sigs.selectExpr("id as b", "sig as sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for x in batches:
            if x.num_rows:
                sa, sb = _matrix(A.column(x, "sa")), _matrix(A.column(x, "sb"))
                keep = survives(sa, sb, least)
                live = np.flatnonzero(keep)
                keep[live] = (sa[live] == sb[live]).reshape(len(live), BANDS, ROWS).all(axis=2).any(axis=1)
                yield x.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, both.select("a", "b").schema)


def _shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, set)`` of the rows with a text whose id is in ``ids`` (materialized); several rows of one id keep a set each."""
    slim = C.only(docs.select(id_col, text_col), ids, id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches):
        for b in A.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([A.column(b, "id"), _lists(*_sets(A.column(b, "text")))], ["id", "set"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, set array<long>")


def _exact(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """The ``(a, b, jaccard)`` of ``pairs`` (materialized) whose shingle sets reach the threshold; of ids with several texts the most similar two count."""
    ids = C.materialize(pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct(), "pair-ids")
    sets = C.materialize(_shingle_sets(docs, ids, id_col, text_col), "sets")
    both = pairs.join(sets.selectExpr("id as a", "set as x"), "a").join(sets.selectExpr("id as b", "set as y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("jaccard", common / (F.size("x") + F.size("y") - common)).where(F.col("jaccard") >= threshold).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of each vertex of ``edges`` (a, b): the lowest id of its connected component.

    Large-star and small-star steps alternate until nothing changes; each
    step's edges are written to the shared folder, which cuts the lineage.
    """
    now = C.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.select("a", "b").union(now.selectExpr("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: links each vertex and its lower neighbours to the lowest of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = C.materialize(small, "stars")
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
        state = told


def _rest(buckets: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``(a, b)``, a < b: the pairs across components that could reach the threshold, from the buckets that hold several components."""
    placed = buckets.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    size = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("band", "n")
    open_ = C.materialize(placed.join(size, "band"), "open")
    few = open_.where(F.col("n") <= FEW).select("band", "id", "root")
    ends = few.alias("p").join(few.alias("q"), "band").where("p.id < q.id and p.root <> q.root")
    pairs = ends.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    pool = C.materialize(open_.where(F.col("n") > FEW).select("id", "root").distinct(), "pool")
    if pool.isEmpty():
        return pairs
    ids = pool.select(F.col("id").alias(id_col)).distinct()
    sets = C.materialize(_shingle_sets(docs, ids, id_col, text_col), "pool-sets")
    return pairs.union(_sharing(sets, pool, threshold)).distinct()


def _sharing(sets: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, a < b: the ids of different roots whose sets share a shingle that sets of ``threshold`` similarity must share.

    Shingles are ordered by rising frequency, then value.  If x, y have the
    Jaccard similarity t and x is no smaller, they have t |x| shingles in
    common, and 2 t / (1 + t) |y|; so their first common shingle is among the
    first |x| - t |x| + 1 of x and |y| - 2 t / (1 + t) |y| + 1 of y, and as
    many as must be common still follow it in both.
    """
    spark, kind = sets.sparkSession, sets.schema["id"].dataType.simpleString()
    counts = C.materialize(sets.select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW), "frequent")

    def prefixes(values, often, offsets):
        """``(shingle, row, place, size, whether y's part)`` of the shingles in front, by rows of sets."""
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((values, often, row))
        place = np.arange(len(values)) - offsets[:-1][row]
        probe = size - np.ceil(threshold * size - 1e-9) + 1
        index = size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9) + 1
        ok = place < probe[row]
        return values[order][ok], row[ok], place[ok], size[row[ok]], (place < index[row])[ok]

    if counts.count() <= SENT:
        told = sorted((r.s, r.n) for r in counts.collect())
        shared = spark.sparkContext.broadcast((np.array([s for s, _ in told], np.int64), np.array([n for _, n in told], np.int64)))
        source = sets.select("id", "set")

        def often(values, _):
            s, n = shared.value
            at = np.minimum(np.searchsorted(s, values), max(0, len(s) - 1))
            return np.where(s[at] == values, n[at], 0) if len(s) else np.zeros(len(values), np.int64)
    else:
        one = sets.withColumn("row", F.monotonically_increasing_id()).select("row", "id", F.explode("set").alias("s"))
        told = one.join(counts, "s", "left").groupBy("row", "id").agg(F.collect_list(F.struct("s", F.coalesce("n", F.lit(0)).alias("n"))).alias("x"))
        source = told.select("id", F.col("x.s").alias("set"), F.col("x.n").alias("often"))
        often = lambda _, batch: A.column(batch, "often").values.to_numpy()[A.column(batch, "often").offsets.to_numpy()[0] :]

    def front(batches):
        for b in batches:
            x = A.column(b, "set")
            o = x.offsets.to_numpy().astype(np.int64)
            values = x.values.to_numpy()[o[0] : o[-1]]
            s, row, place, size, index = prefixes(values, often(values, b)[: len(values)], o - o[0])
            yield pa.RecordBatch.from_arrays([pa.array(s), A.column(b, "id").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(index)], ["s", "id", "place", "size", "indexed"])

    rows = source.mapInArrow(front, f"s long, id {kind}, place int, size int, indexed boolean").join(pool, "id").distinct()
    rows = C.materialize(rows, "prefixes")
    # A shingle in front of many sets is dealt into blocks: a task compares one block of them with one other.
    heavy = C.materialize(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("s", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), "heavy")
    dealt = rows.join(C.sized(heavy, 48), "s", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    own = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("g")).cast("int")
    x = dealt.select("s", own(1).alias("u"), every.alias("v"), F.struct("id", "root", "size", "place").alias("x"))
    y = dealt.where("indexed").select("s", every.alias("u"), own(2).alias("v"), F.struct("id", "root", "size", "place").alias("y"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    ok = (
        (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.id") < F.col("x.id"))))
        & (F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= need)
    )
    return x.join(y, ["s", "u", "v"]).where(ok).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(id, kept_id)`` for each row whose group holds a lower id, ``kept_id``, the group's lowest.

    Groups are the connected components of pairs whose sets of two-word
    shingles (ASCII case and punctuation don't count) have at least
    ``threshold`` Jaccard similarity; a text of one word is one shingle.  Rows
    with a null id or text, and texts without a word, are in no group.
    Repeated rows count once.  If several texts have one id, the id is in the
    groups of all of them.  Ids are whole numbers.
    """
    with C.scratch(docs.sparkSession):
        found = _grouped(docs, id_col, text_col, threshold, miss)
        return C.materialize(found.select(F.col("id").alias(id_col), F.col("root").alias("kept_id")).distinct(), "groups", keep=True)


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, miss: float) -> DataFrame:
    signed = C.materialize(signatures(docs, id_col, text_col), "signatures")
    # Texts with the same words in the same order are one node from here on.
    same = signed.groupBy("whole").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    node = C.materialize(same.where("n > 1"), "same")
    twins = C.materialize(signed.select("id", "whole").join(node, "whole").where("id <> rep").select("id", "rep").distinct(), "twins")
    reps = signed.join(node.select("whole", "rep"), "whole", "left").where("rep is null or id = rep")
    keys = reps.select("id", F.explode("bands").alias("band"))
    full = keys.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("band", "lead")
    buckets = C.materialize(keys.join(full, "band").distinct(), "buckets")
    involved = buckets.select("id").distinct()
    sigs = C.materialize(reps.join(involved, "id", "left_semi").select("id", "sig").distinct(), "involved")
    stars = buckets.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    first = C.materialize(_prune(stars, sigs, threshold, miss).distinct(), "star-pairs")
    edges = C.materialize(_exact(first, docs, id_col, text_col, threshold).select("a", "b"), "star-edges")
    roots = C.materialize(components(edges), "star-roots")
    rest = _rest(buckets.select("id", "band"), roots, docs, id_col, text_col, threshold)
    second = C.materialize(_prune(rest, sigs, threshold, miss).distinct(), "rest-pairs")
    more = _exact(second, docs, id_col, text_col, threshold).select("a", "b")
    return components(edges.union(more).union(twins.selectExpr("rep", "id"))).where("id <> root")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``docs`` with all its columns, without the near copies of a text with a lower id; rows with a null id or text stay.

    If rows with one id have several texts, each text is judged by itself;
    rows with one id aren't near copies of each other.
    """
    found = C.materialize(groups(docs, id_col, text_col, threshold, miss), "near")
    ids = C.materialize(found.select(id_col).distinct(), "near-ids")
    # Of a component that drops no repeated id, the others go by their ids alone; these counts read no text.
    many = C.materialize(C.only(docs.select(id_col), ids, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col), "many")
    if many.isEmpty():
        return C.without(docs, ids, id_col)
    # The components with such ids anew, with (id, text) as nodes, numbered in the order of the ids.
    roots = found.join(many, id_col, "left_semi").select("kept_id").distinct()
    of = found.join(roots, "kept_id", "left_semi")
    affected = C.materialize(of.select(id_col).union(of.select("kept_id")).distinct(), "affected")
    key, node, own, text_key = (C.fresh(docs, x) for x in ("key", "node", "own", "text_key"))
    few = C.only(docs, affected, id_col).withColumn(key, F.sha2(F.col(text_col), 256))
    kinds = few.where(F.col(text_col).isNotNull())
    nodes = C.materialize(kinds.select(id_col, key).distinct().orderBy(id_col, key).withColumn(node, F.monotonically_increasing_id()), "nodes")
    texts = C.materialize(kinds.select(id_col, key, text_col).dropDuplicates([id_col, key]).join(nodes, [id_col, key]).select(node, text_col), "node-texts")
    pairs = groups(texts, node, text_col, threshold, miss)
    kept = nodes.select(F.col(node).alias("kept_id"), F.col(id_col).alias("low"))
    gone = C.materialize(pairs.join(kept, "kept_id").join(nodes.select(node, F.col(id_col).alias(own), F.col(key).alias(text_key)), node).where(F.col("low") < F.col(own)).select(own, text_key), "near-texts")
    left = few.join(gone, (F.col(id_col) == F.col(own)) & (F.col(key) == F.col(text_key)), "left_anti").select(docs.columns)
    plain = C.materialize(ids.join(affected, id_col, "left_anti"), "plain")
    return C.without(C.without(docs, plain, id_col), affected, id_col).unionByName(left)
