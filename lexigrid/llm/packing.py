"""Best-fit-decreasing packing of documents into training sequences.

Pieces are placed longest first into the open bin with the least room that
still fits.  A segment tree over remaining capacities (its leaves count the
open bins with that much room) finds this bin in O(log capacity) steps.  A
text longer than a bin is cut into full bins and a rest; only the rest is
packed with others.

The packing depends on how many pieces have each length and on nothing else,
and pieces of one length that find bins of one room all do the same.  So whole
runs of equal pieces are placed at once: a plan of at most some thousands of
runs, whatever the table, is made from the counts by length.  Pieces are
numbered within their length by a range-partitioned sort, and each looks up
its run.  This is best fit decreasing over the whole table, in parallel.
Texts themselves are not moved: a row holds an id and a length.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 2048
#: Aimed-at rows of a task of the sort; it changes no result.
TASK_ROWS = 250_000
_RANKS = 1 << 40


class Rooms:
    """Open bins by remaining room, under a segment tree of counts; bins of one room are kept as ranges of their numbers."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.tree = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, first: int, n: int = 1) -> None:
        """Bins ``first`` to ``first + n - 1`` have that room; full bins are closed."""
        if room and n:
            heapq.heappush(self.ranges[room], (first, n))
            self._count(room, n)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """``(room, first, n)``: the lowest range of the bins with the least room of at least ``need``; None if there is none."""
        i, tree = need + self.size, self.tree
        while not tree[i]:  # climb until a subtree to the right has a bin
            while i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
            if not i & (i - 1):
                return None
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        first, n = heapq.heappop(self.ranges[room])
        self._count(room, -n)
        return room, first, n


def plan(counts: dict[int, int], capacity: int, opened: int = 0) -> np.ndarray:
    """Rows ``(length, rank, n, each, bin, start)``: pieces ``rank`` to ``rank + n - 1`` of a length fill the bins from ``bin`` on, ``each`` of them in one, from ``start`` on.

    The bin of a piece is that of best fit decreasing over all pieces, the
    lowest among bins of equal room; new bins are numbered from ``opened``.
    """
    rooms, out = Rooms(capacity), []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            got = rooms.take(length)
            if got is None:
                n = -(-left // (capacity // length))
                got, opened = (capacity, opened, n), opened + n
            room, first, n = got
            # A bin that takes one piece has the least room that fits the next, until it fits none.
            each = room // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            whole, some = divmod(placed, each)
            out.append((length, rank, placed, each, first, capacity - room))
            rooms.put(room - each * length, first, whole)
            if some:
                rooms.put(room - some * length, first + whole)
            rooms.put(room, first + used, n - used)
            left, rank = left - placed, rank + placed
    return np.array(out, np.int64).reshape(-1, 6)


def n_words(text: Column) -> Column:
    """Whitespace-separated words of a text; none of a null or blank one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(bin, start, id, piece, piece_start, length)``: which words of which document lie where in which bin.

    ``length`` (default: the text's words) is a document's size.  Documents of
    size 0, null texts among them, take no place and give no row; rows with a
    null id are packed like any, before others of their length.  Each repeated
    row is packed.  Pieces of equal length are placed in the order of their
    ids; pieces as long as a bin take the first bins, in the order of their
    documents' rests (longest first) and ids.
    """
    if not 0 < capacity < 1 << 20:
        raise ValueError("a bin's capacity is from 1 to about a million")
    with C.scratch(docs.sparkSession):
        return _packed(docs, id_col, text_col, length, capacity)


def _packed(docs: DataFrame, id_col: str, text_col: str, length: Column | None, capacity: int) -> DataFrame:
    spark = docs.sparkSession
    size = n_words(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0))
    sizes = C.materialize(docs.select(F.col(id_col).alias("id"), size.cast("long").alias("n")).where("n > 0"), "sizes")
    kind = sizes.schema["id"].dataType.simpleString()
    tasks = max(1, -(-sizes.count() // TASK_ROWS))
    # Repeated rows and null ids differ by their place in the table, so no key is too heavy for a task.
    place = F.monotonically_increasing_id().alias("place")
    keyed = sizes.select("id", F.expr(f"n div {capacity}").alias("full"), (F.col("n") % capacity).cast("int").alias("rest"), place)
    order = (F.desc("rest"), F.asc_nulls_first("id"), F.asc("place"))
    ranged = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "full", "rest", F.spark_partition_id().alias("part"))

    def number(batches):
        at = before = 0
        for b in batches:
            full = b.column(1).to_numpy()
            sums = before + np.cumsum(full)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + np.arange(b.num_rows)), pa.array(sums - full)], ["id", "full", "rest", "part", "at", "before"])
            at += b.num_rows
            before = int(sums[-1]) if b.num_rows else before

    numbered = C.materialize(ranged.mapInArrow(number, f"id {kind}, full long, rest int, part int, at long, before long"), "numbered", keep=True)
    # A row for each task and for each length: tasks are ranges of lengths.
    told = numbered.groupBy("part", "rest").agg(F.count(F.lit(1)), F.sum("full")).collect()
    groups = sorted(map(tuple, told), key=lambda r: (r[0], -r[1]))
    seen: dict[int, int] = {}
    firsts, bases, fulls, so_far, at, last = [], [], [], 0, 0, None
    keys = []
    for part, rest, n, full in groups:
        if part != last:
            last, at = part, 0
            fulls.append((part, so_far))
        keys.append(part * (capacity + 1) + rest)
        firsts.append(at)
        bases.append(seen.get(rest, 0))
        seen[rest] = seen.get(rest, 0) + n
        at, so_far = at + n, so_far + full
    seen.pop(0, None)
    runs = plan(seen, capacity, so_far)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    by_key = np.argsort(np.array(keys, np.int64))
    shared = spark.sparkContext.broadcast((np.array(keys, np.int64)[by_key], np.array(bases, np.int64)[by_key] - np.array(firsts, np.int64)[by_key], dict(fulls), runs))

    def place_all(batches):
        known, shift, full_base, plan_ = shared.value
        starts = plan_[:, 0] * _RANKS + plan_[:, 1]
        for b in batches:
            full, rest, part, at_, before = (b.column(k).to_numpy().astype(np.int64) for k in range(1, 6))
            if not len(full):
                continue
            some = np.flatnonzero(rest)
            rank = at_ + shift[np.searchsorted(known, part * (capacity + 1) + rest)]
            run = plan_[np.searchsorted(starts, rest[some] * _RANKS + rank[some], "right") - 1]
            k = rank[some] - run[:, 1]
            first = np.array([full_base[p] for p in np.unique(part)])[np.searchsorted(np.unique(part), part)] + before
            row = np.repeat(np.arange(len(full)), full)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            cols = (
                np.r_[first[row] + piece, run[:, 4] + k // run[:, 3]],
                np.r_[np.zeros(len(row), np.int64), run[:, 5] + k % run[:, 3] * run[:, 0]],
                np.r_[row, some],
                np.r_[piece, full[some]],
                np.r_[piece * capacity, full[some] * capacity],
                np.r_[np.full(len(row), capacity), rest[some]],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), b.column(0).take(pa.array(cols[2])), pa.array(cols[3].astype(np.int32)), pa.array(cols[4]), pa.array(cols[5].astype(np.int32))],
                ["bin", "start", "id", "piece", "piece_start", "length"],
            )

    out = numbered.mapInArrow(place_all, f"bin long, start int, id {kind}, piece int, piece_start long, length int")
    return out.withColumnRenamed("id", id_col)
