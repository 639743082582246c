"""Token ids in ORC files laid out for training readers.

Texts are encoded with a byte-level BPE vocabulary and written as ORC: integer
run-length encoding of ids, small stripes, a row index and Bloom filters on
document ids.  Rows are sorted by id within a file, so stripe and row-group
statistics prune lookups, and readers take stripes in parallel.  Nothing is
shuffled.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as A
from .spm import gather

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01
#: Encoded pieces that a worker remembers.
REMEMBERED = 400_000


def encoder(ranks_file: str = RANKS):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts, laid end to end, that can be encoded by themselves, and their row offsets.

    A text is cut before a space that a printable ASCII character or a letter
    beyond follows, and after a single line end between printable characters:
    no token crosses these places, and none changes for them.
    """
    d, o = A.flat(texts)
    if not len(d):
        return pa.array([], pa.string()), np.zeros(len(o), np.int64)
    graph = (d > 32) & (d < 127)
    start = np.zeros(len(d), bool)
    start[o[:-1][o[:-1] < len(d)]] = True
    # lead bytes C2 and E1 to E3 may begin white space, and only there the border could matter
    plain = graph | (d >= 0xC3) & ~((d >= 0xE1) & (d <= 0xE3))
    start[:-1] |= (d[:-1] == 32) & plain[1:]
    start[2:] |= graph[:-2] & (d[1:-1] == 10) & graph[2:]
    s = np.flatnonzero(start)
    off = np.append(s, len(d)).astype(np.int32)
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(d))), np.searchsorted(s, o)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS) -> DataFrame:
    """``(id, n_tokens, token_ids)`` of each input row; a null text has null ids and 0 tokens, an empty one no ids."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encode, known = encoder(ranks_file), {}
        for b in A.slices(batches, "text", 8 << 20):
            text = A.column(b, "text")
            parts, r = pieces(text)
            code = pc.dictionary_encode(parts)
            if len(known) > REMEMBERED:
                known = {}
            lists = []
            for k in code.dictionary.to_pylist():
                ids = known.get(k)
                if ids is None:
                    ids = known[k] = np.array(encode(k), np.int32).tobytes()
                lists.append(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64) // 4
            ids, io = gather(np.frombuffer(b"".join(lists), np.int32), offsets, code.indices.to_numpy() if len(parts) else np.zeros(0, np.int64))
            cuts = io[r].astype(np.int32)
            out = pc.if_else(pc.is_valid(text), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)), pa.scalar(None, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([A.column(b, "id"), pa.array(np.diff(cuts)), out], ["id", "n_tokens", "token_ids"])

    out = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, n_tokens int, token_ids array<int>")
    return out.withColumnRenamed("id", id_col)


def write(tokens: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write token rows as ORC under ``path``, sorted by id within each file; null ids come first and repeated rows stay."""
    (
        tokens.sortWithinPartitions(id_col)
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", str(FALSE_POSITIVES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All rows; tasks take splits at stripe borders."""
    return (spark.read.schema(schema) if schema else spark.read).orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The rows of some documents; file, stripe and row-group statistics and the Bloom filters skip the rest."""
    return spark.read.orc(path).where(F.col(id_col).isin(list(ids)))


def stripes(file: str) -> list[dict]:
    """Row count of each stripe of a local ORC file; only its first column is read."""
    from pyarrow import orc

    f = orc.ORCFile(file)
    return [{"stripe": k, "rows": f.read_stripe(k, columns=f.schema.names[:1]).num_rows} for k in range(f.nstripes)]
