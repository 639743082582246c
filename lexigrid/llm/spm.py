"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words at borders that no piece of the model crosses, so
words can be encoded by themselves.  The distinct words of the whole table
form the lattice: substrings of bounded length are exploded and equi-joined to
the piece table, the edges found are grouped by word, and a higher-order
``aggregate`` folds each word's edges into its pieces.

For a Unigram model the fold is Viterbi: the path with the highest sum of
scores.  For a BPE model a path's score isn't what the model maximizes, so
there the fold goes over the same edges in the order of their merge rank and
merges the two pieces under an edge whenever they are just two; this gives the
ids of the model's own library, which the highest-scoring path doesn't.
``unigram`` reads a model's pieces and scores as a Unigram model's.

Texts are never shuffled.  A word remembers which parts of input files it is
from (of ``PART_BYTES``, cut again where a task has read ``PART_TEXT`` of
texts); the encoded words are written once as one small dictionary for each
part, and a second pass over the texts looks its words up in the dictionary of
its own part.  What a worker holds is thus bounded by a part, whatever the
table, the sizes of its files and row groups, and their compression.  Texts
that don't come straight from files are written to some first.
"""

from __future__ import annotations

import dataclasses
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as A
from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words of more characters are encoded in the workers (the lattice keeps borders as the bits of a long).
LATTICE_CHARS = 61
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_UNSEEN_PENALTY = 10.0
#: Bytes of the texts that a worker encodes at a time; its largest temporary arrays have eight times as many.
SLICE_BYTES = 1 << 20
#: Bytes of an input file, and of the texts that a task has read of it, whose words have one dictionary.
PART_BYTES, PART_TEXT = 32 << 20, 64 << 20
#: Bytes of input files for which there is a task of words, and the most of these tasks.
TASK_BYTES, MOST_TASKS = 16 << 20, 50_000


@dataclass(frozen=True)
class Pieces:
    kind: int
    pieces: tuple[str, ...]  # by id
    scores: tuple[float, ...]
    usable: tuple[bool, ...]  # may come out of a text
    byte0: int  # id of the byte piece of 0, -1 if the model has none
    unk: int
    prefix: bool = True  # a space is put before every text

    @property
    def longest(self) -> int:
        return max((len(p) for p, u in zip(self.pieces, self.usable) if u), default=1)


def _proto(raw: bytes) -> dict[int, list]:
    """The fields of one protobuf message."""
    out: dict[int, list] = {}
    i = 0

    def varint() -> int:
        nonlocal i
        v = s = 0
        while True:
            b = raw[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            v = varint()
        elif kind == 2:
            n = varint()
            v, i = raw[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = raw[i : i + n], i + n
        out.setdefault(tag >> 3, []).append(v)
    return out


def load(path: str = MODEL) -> Pieces:
    """The piece table of a model file; its normalization must be the identity, as the engine's is."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = _proto(m.serialized_model_proto())
    trainer, normal = (_proto(proto[k][0]) if k in proto else {} for k in (2, 3))
    if normal.get(2, [b""])[0] or normal.get(4, [1])[0]:
        raise ValueError("the model normalizes texts or removes spaces; only models that keep texts as they are are supported")
    n = m.get_piece_size()
    byte = [i for i in range(n) if m.is_byte(i)]
    return Pieces(
        trainer.get(3, [UNIGRAM])[0],
        tuple(m.id_to_piece(i) for i in range(n)),
        tuple(m.get_score(i) for i in range(n)),
        tuple(not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)),
        byte[0] if len(byte) == 256 else -1,
        m.unk_id(),
        bool(normal.get(3, [1])[0]),
    )


def unigram(p: Pieces) -> Pieces:
    """The same pieces and scores as a Unigram model, whose encoding is the path of the highest sum of scores."""
    return dataclasses.replace(p, kind=UNIGRAM)


def joins(p: Pieces) -> np.ndarray:
    """Which byte may be followed, across a character's end, by which in a piece; elsewhere words may be cut."""
    t = np.zeros((256, 256), bool)
    for piece, ok in zip(p.pieces, p.usable):
        if ok:
            raw = [x.encode() for x in piece.replace(SPACE, " ")]
            for a, b in zip(raw, raw[1:]):
                t[a[-1], b[0]] = True
    return t


def units(texts: pa.Array, table: np.ndarray, prefix: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, laid end to end, and their row offsets; a null or empty text has none."""
    texts = texts.fill_null("") if texts.null_count else texts
    if prefix:
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")))
    d, o = A.flat(texts)
    if not len(d):
        return pa.array([], pa.string()), np.zeros(len(o), np.int64)
    start = np.zeros(len(d), bool)
    start[o[:-1][o[:-1] < len(d)]] = True
    pair = d[:-1].astype(np.uint16) << np.uint16(8) | d[1:]
    start[1:] |= ~table.ravel().take(pair) & ((d[1:] < 128) | (d[1:] >= 192))
    space = d == 32
    start[1:] |= space[1:] & ~space[:-1] & ~table[d[:-1], 32]
    s = np.flatnonzero(start)
    off = np.append(s, len(d)).astype(np.int32)
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(d))), np.searchsorted(s, o)


def piece_table(spark: SparkSession, p: Pieces) -> DataFrame:
    """``(piece, id, score, rank)``: the best score has rank 0, equal scores share a rank."""
    place = {x: k for k, x in enumerate(sorted({x for x, u in zip(p.scores, p.usable) if u}, reverse=True))}
    rows = [(s, i, float(x), place[x]) for i, (s, x, u) in enumerate(zip(p.pieces, p.scores, p.usable)) if u]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank int")


#: A BPE edge in a long, in the order of merging: rank, start, length, id + 1.
_RANK, _START, _LENGTH = 40, 34, 28
_LAST = (1 << 23) - 1


def lattice(words: DataFrame, p: Pieces, carry: str | None = None) -> DataFrame:
    """``(word, u, n, edges[, carry])``: the edges of each distinct word of ``words`` (word).

    ``words`` should be partitioned by word, as a grouping leaves it; grouping
    the edges then moves nothing.  The piece table has the model's size, not
    the data's, and is broadcast.
    """
    spark = words.sparkSession
    low = min([x for x, u in zip(p.scores, p.usable) if u], default=0.0) - _UNSEEN_PENALTY
    have = [F.col(carry)] if carry else []
    base = words.select("word", *have, F.translate("word", " ", SPACE).alias("u")).withColumn("n", F.length("u"))
    at = base.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    sub = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest), F.col("n") - F.col("s")))).alias("l"))
    # One edge of a word carries; the others' rows stay short.
    once = [F.when((F.col("s") == 0) & (F.col("l") == 1), F.col(carry)).alias(carry)] if carry else []
    sub = sub.select("word", *once, "s", "l", F.substring("u", F.col("s") + 1, F.col("l")).alias("piece"))
    found = sub.join(F.broadcast(piece_table(spark, p)), "piece", "left").where("id is not null or l = 1")
    if p.kind == BPE:
        # Single characters sort last: they are never merged into, only read off.
        rank = F.when(F.col("l") == 1, F.lit(_LAST)).otherwise(F.col("rank")).cast("long")
        edge = F.shiftleft(rank, _RANK).bitwiseOR(F.shiftleft(F.col("s").cast("long"), _START)).bitwiseOR(F.shiftleft(F.col("l").cast("long"), _LENGTH)).bitwiseOR(F.coalesce("id", F.lit(-1)).cast("long") + 1)
    else:
        edge = F.struct((F.col("s") + F.col("l")).alias("e"), "s", F.coalesce("score", F.lit(low)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    more = [F.first(carry, ignorenulls=True).alias(carry)] if carry else []
    out = found.select("word", *have, edge.alias("edge")).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *more)
    return out.withColumn("u", F.translate("word", " ", SPACE)).withColumn("n", F.length("u"))


def _byte_ids(p: Pieces, ch: str) -> str:
    """SQL for the ids of a character that isn't a piece."""
    if p.byte0 < 0:
        return f"array({p.unk})"
    return f"transform(sequence(1, octet_length({ch})), i -> {p.byte0} + cast(conv(substring(hex(encode({ch}, 'UTF-8')), 2 * i - 1, 2), 16, 10) as int))"


def fold(grouped: DataFrame, p: Pieces) -> DataFrame:
    """``lattice`` with ``ids``: each word's piece ids, null where a BPE word has to be merged step by step."""
    if p.kind == BPE:
        # Bit i of the accumulator: there is a border before character i.
        start, length = f"cast(shiftright(e, {_START}) & 63 as int)", f"cast(shiftright(e, {_LENGTH}) & 63 as int)"
        ends = f"(shiftleft(shiftleft(1L, {length}) | 1L, {start}))"
        inner = f"(shiftleft(shiftleft(1L, {length}) - 2L, {start}))"
        merged = f"aggregate(slice(edges, 1, size(edges) - n), shiftleft(1L, n + 1) - 1, (acc, e) -> if((acc & {ends}) = {ends} and bit_count(acc & {inner}) = 1, acc & ~{inner}, acc))"
        # Edges whose ends are borders with none between are the word's pieces; by start, then id + 1.
        kept = f"array_sort(transform(filter(edges, e -> (acc & ({ends} | {inner})) = {ends}), e -> shiftleft(shiftright(e, {_START}) & 63, 32) | (e & {(1 << _LENGTH) - 1})))"
        left = f"exists(slice(edges, 1, size(edges) - n), e -> (acc & {ends}) = {ends} and bit_count(acc & {inner}) = 1)"
        unknown = _byte_ids(p, "substring(u, cast(shiftright(x, 32) as int) + 1, 1)")
        one = "cast(x & 4294967295 as int) - 1"
        ids = f"if(exists(path, x -> (x & 4294967295) = 0), flatten(transform(path, x -> if((x & 4294967295) > 0, array({one}), {unknown}))), transform(path, x -> {one}))"
        out = grouped.withColumn("acc", F.expr(merged)).withColumn("path", F.expr(kept)).withColumn("left", F.expr(left))
        return out.withColumn("ids", F.expr(f"if(left, null, {ids})")).drop("acc", "path", "edges", "left")
    flat = f"flatten(transform(path, x -> if(x.id >= 0, array(x.id), {_byte_ids(p, 'substring(u, x.s + 1, 1)')})))"
    # best[k]: score of the best path to border k, its last edge's start and id; edges come by end, then start.
    better = "element_at(acc, e.s + 1).score + e.score"
    step = (
        f"if(size(acc) = e.e, concat(acc, array(named_struct('score', {better}, 's', e.s, 'id', e.id))), "
        f"if({better} > element_at(acc, -1).score, concat(slice(acc, 1, size(acc) - 1), array(named_struct('score', {better}, 's', e.s, 'id', e.id))), acc))"
    )
    best = f"aggregate(edges, array(named_struct('score', 0.0D, 's', -1, 'id', -1)), (acc, e) -> {step})"
    back = (
        "aggregate(sequence(1, n), named_struct('at', n, 'path', cast(array() as array<struct<s:int,id:int>>)), "
        "(acc, k) -> if(acc.at > 0, named_struct('at', element_at(best, acc.at + 1).s, 'path', concat(array(named_struct('s', element_at(best, acc.at + 1).s, 'id', element_at(best, acc.at + 1).id)), acc.path)), acc)).path"
    )
    return grouped.withColumn("best", F.expr(best)).withColumn("path", F.expr(back)).withColumn("ids", F.expr(flat)).drop("best", "path", "edges")


def merge_steps(word: str, ranks: dict[str, tuple[int, float]], p: Pieces) -> list[int]:
    """Ids of a word of any length by repeatedly merging the neighbours whose union ranks first, the leftmost among equals."""
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (x := ranks.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-x[1], a, end[b]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, a, e = heapq.heappop(heap)
        if not alive[a] or end[a] >= n or end[end[a]] != e:
            continue
        b = end[a]
        alive[b] = False
        end[a] = e
        if e < n:
            prev[e] = a
        offer(a)
        if prev[a] >= 0:
            offer(prev[a])
    out: list[int] = []
    i = 0
    while i < n:
        x = ranks.get(word[i : end[i]])
        if x is not None:
            out.append(x[0])
        elif p.byte0 >= 0:
            out += [p.byte0 + b for b in word[i : end[i]].encode()]
        else:
            out.append(p.unk)
        i = end[i]
    return out


def best_path(word: str, ranks: dict[str, tuple[int, float]], p: Pieces) -> list[int]:
    """Ids of a word of any length by Viterbi."""
    low = min((x[1] for x in ranks.values()), default=0.0) - _UNSEEN_PENALTY
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]
    longest = p.longest
    for e in range(1, len(word) + 1):
        top = None
        for s in range(max(0, e - longest), e):
            x = ranks.get(word[s:e], (-1, low) if e - s == 1 else None)
            if x is not None and (top is None or best[s][0] + x[1] > top[0]):
                top = (best[s][0] + x[1], s, x[0])
        best.append(top)
    path, e = [], len(word)
    while e:
        _, s, i = best[e]
        path.append([i] if i >= 0 else [p.byte0 + b for b in word[s:e].encode()] if p.byte0 >= 0 else [p.unk])
        e = s
    return [i for ids in reversed(path) for i in ids]


def gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[offsets[i]:offsets[i+1]]`` of the picked i, laid end to end, and their offsets."""
    size = (offsets[1:] - offsets[:-1])[pick]
    out = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offsets[pick] - out[:-1], size) + np.arange(out[-1])], out


def encode(docs: DataFrame, p: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` of each input row, repeated rows included.

    A null text has null ids, an empty one none.  Characters that aren't
    pieces become byte pieces, or the unknown id if the model has no bytes.
    Equal scores: BPE merges the leftmost, Viterbi takes the longest last
    piece.  Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    table = joins(p)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not _from_files(slim):
        slim = C.materialize(slim, "texts")
    size = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slim = slim.withColumn("f", F.xxhash64(F.input_file_name(), F.floor(F.input_file_block_start() / PART_BYTES)))
    prefix, most = p.prefix, PART_TEXT

    def words(batches):
        read: dict = {}
        for b in batches:
            for key, part in _by_part(b, read, most):
                seen = []
                for s in A.slices([part], "text", SLICE_BYTES):
                    seen.append(pc.unique(units(A.column(s, "text"), table, prefix)[0]))
                    if len(seen) == 8:
                        seen = [pc.unique(pa.concat_arrays(seen))]
                u = pc.unique(pa.concat_arrays(seen))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), key)), u], ["f", "word"])

    # One exchange by word serves the grouping, the lattice and its folding.  A word is some bytes here and dozens of
    # edges later, so tasks follow the texts' bytes, and are no fewer than the session's.
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, size // TASK_BYTES))
    found = slim.mapInArrow(words, "f long, word string").repartition(n_tasks, "word").groupBy("word").agg(F.collect_set("f").alias("fs"))
    short = fold(lattice(found.where(F.length("word") <= LATTICE_CHARS), p, "fs"), p)
    where = C.shared_dir(spark, "dictionaries")
    # Words without ids are dropped by the readers: a filter here would have the fold computed twice.
    rows = short.select(F.explode("fs").alias("f"), "word", "ids")
    # sorted by file within a task, so that a task writes one dictionary after the other
    rows.repartition("f").sortWithinPartitions("f").write.partitionBy("f").parquet(where)
    ranks = {s: (i, x) for i, (s, x, u) in enumerate(zip(p.pieces, p.scores, p.usable)) if u}
    shared = spark.sparkContext.broadcast((p, ranks))

    def look_up(batches):
        model, by_piece = shared.value
        alone = merge_steps if model.kind == BPE else best_path
        held: dict = {}
        read: dict = {}
        for b in batches:
            for key, part in _by_part(b, read, most):
                for s in A.slices([part], "text", SLICE_BYTES):
                    text = A.column(s, "text")
                    u, r = units(text, table, prefix)
                    if len(u) and key not in held:
                        held.clear()  # before the next one is read
                        held[key] = _dictionary(where, key)
                    dict_words, values, offsets = held[key] if len(u) else (pa.chunked_array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))
                    code = pc.dictionary_encode(u)
                    kinds = code.dictionary
                    at = _places(kinds, dict_words)
                    new = np.flatnonzero(at < 0)
                    v, o = values, offsets
                    if len(new):
                        extra = [alone(kinds[int(i)].as_py().replace(" ", SPACE), by_piece, model) for i in new]
                        at[new] = len(o) - 1 + np.arange(len(new))
                        o = np.concatenate([o, o[-1] + np.cumsum([len(x) for x in extra])])
                        v = np.concatenate([v, np.array([i for x in extra for i in x], np.int32)])
                    ids, io = gather(v, o, at[code.indices.to_numpy()] if len(u) else np.zeros(0, np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(io[r].astype(np.int32)), pa.array(ids.astype(np.int32)))
                    lists = pc.if_else(pc.is_valid(text), lists, pa.scalar(None, lists.type))
                    yield pa.RecordBatch.from_arrays([A.column(s, "id"), lists], ["id", "ids"])

    out = slim.mapInArrow(look_up, f"id {slim.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _by_part(batch: pa.RecordBatch, read: dict, most: int):
    """``(part, its rows)``; a batch of one file, the usual case, isn't copied.

    ``read`` has the bytes of texts that the task has read of each file: both passes read the same rows in the same
    order, however they are cut into batches.  Were they not, words would be missed in a dictionary and encoded alone.
    """
    f = A.column(batch, "f")
    keys = pc.unique(f).to_pylist()
    for key in keys:
        rows = batch if len(keys) == 1 else batch.filter(pc.equal(f, key))
        o = A.flat(A.column(rows, "text"))[1] + read.get(key, 0)
        read[key] = int(o[-1])
        k = o[:-1] // most
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            # A part's number is spread over the 64 bits of a key; two parts of one key would share their dictionary.
            yield (key + int(k[a]) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63), rows.slice(a, b - a)


def _places(kinds: pa.Array, dict_words: pa.ChunkedArray) -> np.ndarray:
    """The place of each of some distinct words in a dictionary, -1 where it isn't.

    The dictionary's words are looked up among the others, a chunk at a time: only the few are ever hashed.
    """
    at = np.full(len(kinds), -1, np.int64)
    start = 0
    for chunk in dict_words.chunks:
        got = pc.index_in(chunk, value_set=kinds)
        found = np.flatnonzero(pc.is_valid(got).to_numpy(zero_copy_only=False))
        at[got.drop_null().to_numpy()] = start + found
        start += len(chunk)
    return at


def _from_files(df: DataFrame) -> bool:
    """Whether rows come straight from files, so that each knows its own."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter") and not (node.children().isEmpty() and "Relation" in node.nodeName()):
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return bool(df.inputFiles())


def _system(where: str):
    """A file system of the workers for Spark's folder, and the path in it."""
    import re

    from pyarrow import fs

    if where.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", where)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", where))


def _dictionary(where: str, key: int):
    """Words, ids and offsets of the dictionary of one part of the input; a part whose words are all too long for the lattice has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = _system(where)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"workers don't see {where}")
    infos = system.get_file_info(fs.FileSelector(f"{at}/f={key}", allow_not_found=True))
    words, values, sizes = [], [], []
    for i in infos:
        if i.path.endswith(".parquet"):
            with system.open_input_file(i.path) as f, pq.ParquetFile(f) as file:
                # Batch by batch, so that the file's decoded columns aren't there beside what is kept of them.
                for b in file.iter_batches(1 << 16, columns=["word", "ids"], use_threads=False):
                    b = b.filter(pc.is_valid(A.column(b, "ids")))
                    words.append(A.column(b, "word"))
                    values.append(A.column(b, "ids").flatten().to_numpy().astype(np.int32))
                    sizes.append(pc.list_value_length(A.column(b, "ids")).to_numpy())
    sizes = np.concatenate([np.zeros(1, np.int32), *sizes])
    return pa.chunked_array(words, pa.string()), np.concatenate([np.zeros(0, np.int32), *values]), np.cumsum(sizes, dtype=np.int64)


def decode(ids: Column, p: Pieces) -> Column:
    """The text of piece ids, as a Column: pieces and bytes are laid end to end, spaces restored and the one put before the text taken off.

    Control ids and ids that the model doesn't have give no text; bytes that
    aren't UTF-8 become U+FFFD; null ids give null.
    """
    import json

    raw = []
    for i, (s, u) in enumerate(zip(p.pieces, p.usable)):
        if p.byte0 >= 0 and p.byte0 <= i < p.byte0 + 256:
            raw.append(f"{i - p.byte0:02x}")
        else:
            raw.append(s.replace(SPACE, " ").encode().hex() if u else "e28187" if i == p.unk else "")
    table = F.from_json(F.lit(json.dumps(raw)), "array<string>")
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string"))
    return F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text) if p.prefix else text
