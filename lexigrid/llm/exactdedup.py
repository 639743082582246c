"""Exact duplicates by content-defined chunk recipes.

A gear hash over the bytes places chunk borders where the content says so, so
equal texts have equal chunks.  A text's recipe is the ordered list of its
chunks' identifiers (128-bit digest and length).  Recipes are compared, not
texts: long documents are read where they lie and are never shuffled.  Chunks
of texts whose recipes agree are then compared byte by byte, once for each
distinct chunk; if one identifier turns out to stand for several byte strings,
these get numbers and the recipes that hold them are written anew.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from . import common as C

#: Bytes: least and most of a chunk; one byte in 2**BITS is a border by chance.
LEAST, MOST, BITS = 256, 16384, 11
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def borders(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks; a text of no bytes has none."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # after these, h[i] sums the last 32 bytes' gears, each shifted by its distance
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist()
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts = []
        while e - s > LEAST:
            i = bisect_left(marks, s + LEAST)
            cut = min(marks[i] if i < len(marks) else e, s + MOST, e)
            cuts.append(cut)
            s = cut
        if e > s:
            cuts.append(e)
        out.append(cuts)
    return out


def _digest(raw) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(raw)


def recipes(docs: DataFrame, id_col: str, text_col: str, digest=_digest) -> DataFrame:
    """``(id, recipe)`` of the rows with an id and a text; a recipe has 20 bytes for each chunk."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches):
        for b in A.slices(batches, "text"):
            data, o = A.flat(A.column(b, "text"))
            out = []
            for s, cuts in zip(o.tolist(), borders(data, o)):
                parts = []
                for e in cuts:
                    parts.append(digest(data[s:e]) + (e - s).to_bytes(4, "big"))
                    s = e
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([A.column(b, "id"), pa.array(out, pa.binary())], ["id", "recipe"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, recipe binary")


def _chunks(docs: DataFrame, id_col: str, text_col: str, digest=_digest) -> DataFrame:
    """``(id, row, pos, chunk, bytes)`` of each chunk; ``row`` tells repeated rows apart."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def run(batches):
        for b in A.slices(batches, "text"):
            data, o = A.flat(A.column(b, "text"))
            at, pos, ids, raws = [], [], [], []
            for i, (s, cuts) in enumerate(zip(o.tolist(), borders(data, o))):
                for k, e in enumerate(cuts):
                    raw = data[s:e].tobytes()
                    at.append(i), pos.append(k), ids.append(digest(raw) + (e - s).to_bytes(4, "big")), raws.append(raw)
                    s = e
            yield pa.RecordBatch.from_arrays([A.column(b, "id").take(pa.array(at, pa.int64())), pa.array(at, pa.int64()), pa.array(pos, pa.int32()), pa.array(ids, pa.binary()), pa.array(raws, pa.binary())], ["id", "row", "pos", "chunk", "bytes"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, row long, pos int, chunk binary, bytes binary")


def verified(docs: DataFrame, id_col: str, text_col: str, digest=_digest) -> DataFrame:
    """``(id, recipe)`` of the texts whose verified recipe another row has too."""
    found = C.materialize(recipes(docs, id_col, text_col, digest), "recipes")
    shared = found.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("recipe")
    again = C.materialize(found.join(shared, "recipe", "left_semi"), "candidates")
    ids = C.materialize(again.select("id").distinct(), "candidate-ids")
    chunks = _chunks(C.only(docs, ids.withColumnRenamed("id", id_col), id_col), id_col, text_col, digest)
    # One row for each distinct chunk leaves a task, however often it occurs.
    kinds = chunks.select("chunk", "bytes").distinct()
    clash = C.materialize(kinds.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("bytes")).alias("kinds")).where("n > 1").select("chunk", "kinds"), "clashes")
    if clash.isEmpty():
        return again
    number = F.coalesce(F.array_position("kinds", F.col("bytes")), F.lit(0)).cast("int")
    part = F.struct("pos", F.concat("chunk", F.unhex(F.lpad(F.hex(number), 8, "0"))).alias("v"))
    anew = chunks.join(clash, "chunk", "left").groupBy("id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.hex(x.v)), "").alias("v"))
    anew = anew.select("id", F.unhex("v").alias("recipe"))
    empty = again.where(F.octet_length("recipe") == 0)  # texts without a chunk have nothing to number
    return C.materialize(anew.unionByName(empty), "numbered")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kept_id)`` for each row that is a copy of a row with a lower id.

    Texts are copies if all their bytes agree; empty texts are copies of each
    other.  Of each group the lowest id is kept.  Rows with a null id or text
    are in no group.  Repeated rows with the lowest id aren't listed, those
    with another id are listed once.
    """
    same = verified(docs, id_col, text_col)
    lowest = same.groupBy("recipe").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = same.join(lowest, "recipe").where("id <> kept_id").select(F.col("id").alias(id_col), "kept_id")
    return out.distinct()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the copies.

    Of the rows with equal texts one with the lowest id stays.  Rows with a
    null id or text stay.  If rows with one id have several texts, each text
    is judged by itself.
    """
    same = verified(docs, id_col, text_col)
    lowest = same.groupBy("recipe").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = same.join(lowest, "recipe").groupBy("id").agg(F.max(F.col("id") == F.col("kept_id")).alias("first"), F.max(F.col("id") != F.col("kept_id")).alias("later"), F.count(F.lit(1)).alias("n"))
    marked = C.materialize(marked, "marked")
    n, shared = C.fresh(docs, "n"), C.fresh(docs, "shared")
    later = C.materialize(marked.where("later and not first").select(F.col("id").alias(id_col), F.col("n").alias(shared)), "later")
    # A later id goes by its id alone only if copies are all its rows: rows are counted without their texts.
    ids = C.materialize(later.select(id_col), "later-ids")
    rows = C.only(docs.select(id_col), ids, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias(n))
    more = C.materialize(rows.join(later, id_col).where(F.col(n) > F.col(shared)).select(id_col), "more")
    plain = C.materialize(C.without(ids, more, id_col), "plain")
    rest = C.without(docs, plain, id_col)
    # An id with repeated rows, with copied texts of both kinds, or with copies and other rows: these few rows are settled by their texts.
    odd = C.materialize(marked.where("first and (later or n > 1)").select(F.col("id").alias(id_col)).unionByName(more), "odd")
    if odd.isEmpty():
        return rest
    few = C.only(rest, odd, id_col)
    key, low = C.fresh(docs, "key"), C.fresh(docs, "low")
    ids = C.materialize(same.select(F.col("id").alias(id_col)).distinct(), "same-ids")
    lower = C.only(docs, ids, id_col).where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col), 256).alias(key)).agg(F.min(id_col).alias(low))
    one = few.withColumn(key, F.sha2(F.col(text_col), 256)).join(lower, key, "left").where(F.col(low).isNull() | (F.col(id_col) == F.col(low)))
    once = one.where(F.col(text_col).isNull()).unionByName(one.where(F.col(text_col).isNotNull()).dropDuplicates([id_col, key]))
    return C.without(rest, odd, id_col).unionByName(once.select(docs.columns))
