"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of labelled sample
texts.  A text is cut into blocks; every block of the whole text is compressed
with every dictionary and the sizes are added up.  The language whose
dictionary gives the smallest total is chosen (ASCII case and symbols don't count), unless the runner-up is within
``margin`` of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrowtext as A

#: Bound of the labelled sample: bytes of a language's dictionary, and of the parts of texts that it is made of.
DICT_BYTES, PART = 96 << 10, 768
BLOCK, LEVEL, MARGIN = 4096, 6, 0.01
UNKNOWN = "und"


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts with each run of ASCII other than letters and digits as one space: case and symbols tell nothing about language."""
    data, o = A.flat(pc.utf8_lower(texts))
    if len(data) == 0:
        return data, o
    word = A._WORD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = word[1:] | word[:-1]
    out = np.where(word, data, np.uint8(32))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[o]


def fit_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """One dictionary for each language, from parts of all its labelled texts.

    Every text, however long, is cut into parts of ``PART`` bytes; of a
    language's distinct parts those with the lowest hashes, as many as fill
    ``DICT_BYTES``, are its dictionary.  A task sends at most that much a
    language.  Rows with a null text or label don't take part; an empty table
    gives no dictionaries.
    """
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    most = DICT_BYTES // PART

    def lowest(batches):
        import heapq

        import xxhash

        held: dict[str, tuple[list[int], dict[int, bytes]]] = {}  # negated hashes as a heap, and parts by hash
        for b in A.slices(batches, "text"):
            data, o = letters(A.column(b, "text"))
            for i, lang in enumerate(A.column(b, "lang").to_pylist()):
                heap, parts = held.setdefault(lang, ([], {}))
                for at in range(int(o[i]), int(o[i + 1]), PART):
                    raw = data[at : min(at + PART, int(o[i + 1]))].tobytes()
                    h = xxhash.xxh3_64_intdigest(raw) >> 1
                    if h in parts or (len(heap) >= most and h >= -heap[0]):
                        continue
                    parts[h] = raw
                    heapq.heappush(heap, -h)
                    if len(heap) > most:
                        parts.pop(-heapq.heappop(heap))
        rows = [(lang, h, raw) for lang, (_, parts) in held.items() for h, raw in parts.items()]
        for k in range(0, len(rows), 10_000):
            part = list(zip(*rows[k : k + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())], ["lang", "h", "part"])

    told = slim.mapInArrow(lowest, "lang string, h long, part binary").dropDuplicates(["lang", "h"])
    first = told.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= most)
    parts: dict[str, list] = {}
    for r in first.collect():
        parts.setdefault(r.lang, []).append((r.n, bytes(r.part)))
    made = {lang: b"\n".join(p for _, p in sorted(ps)) for lang, ps in sorted(parts.items())}
    return {lang: raw for lang, raw in made.items() if len(raw) >= 8}


def sizes(dictionaries: dict[str, bytes]):
    """A function from a text's bytes to its compressed size under each dictionary, in the dictionaries' order."""
    import zstandard

    made = []
    for raw in dictionaries.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress)

    def of(data) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in made]

    return of


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``(id, pred_lang, margin)``, one row for each input row, repeated rows included.

    ``pred_lang`` is ``und`` where the relative margin between the two smallest
    sizes is under ``margin``, and for null or empty texts (margin 0).  Equal
    sizes have margin 0 and so are ``und``.  With one dictionary every
    non-empty text gets it, with margin 1; with none all texts are ``und``.
    Other columns of the input, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        names, of = list(shared.value), sizes(shared.value)
        for b in A.slices(batches, "text"):
            data, o = letters(A.column(b, "text"))
            pred, gap = [], np.zeros(b.num_rows)
            for i in range(b.num_rows):
                best = UNKNOWN
                if o[i + 1] > o[i] and names:
                    s = of(data[o[i] : o[i + 1]])
                    order = sorted(range(len(s)), key=s.__getitem__)
                    gap[i] = (s[order[1]] - s[order[0]]) / s[order[0]] if len(s) > 1 else 1.0
                    if gap[i] > 0 and gap[i] >= margin:
                        best = names[order[0]]
                pred.append(best)
            yield pa.RecordBatch.from_arrays([A.column(b, "id"), pa.array(pred, pa.string()), pa.array(np.round(gap, 6))], ["id", "pred_lang", "margin"])

    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, pred_lang string, margin double")
    return out.withColumnRenamed("id", id_col)
