"""Whole-batch text kernels over Arrow buffers.

Every kernel works on the UTF-8 bytes of many texts laid end to end, so the
inner loops are numpy passes over one flat buffer and no Python object is made
per text, word or shingle.  A batch is cut into slices of whole texts of at
most ``SLICE_BYTES`` together (one longer text forms a slice of its own), which
bounds a worker's memory by the slice and never by the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: ASCII letters and digits and every non-ASCII byte belong to words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for k, r in enumerate((_R, _RINV)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of the texts in them; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches, text: str, limit: int = SLICE_BYTES):
    """Cut record batches into runs of whole rows whose texts hold at most ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, o = flat(column(batch, text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(o, o[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a text's border ends a run."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of the buffer."""
    p, inv = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words (ASCII letters lowered, other bytes kept; runs of other ASCII separate) and their n+1 row offsets."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    starts, ends = runs(_WORD[low], offsets)
    return hashes(low, starts, ends), np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, rows: np.ndarray, n: int):
    """Hashes of the n-word shingles and their row offsets; a text of fewer words is one shingle, one of none has none."""
    counts = np.diff(rows)
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    acc = h.copy()
    m = len(h)
    for k in range(1, n):
        acc[: m - k] = mix(acc[: m - k] * _R + h[k:])
    keep = np.ones(m, bool)
    pos = np.arange(m) - np.repeat(rows[:-1], counts)
    size = np.repeat(counts, counts)
    keep = pos <= np.maximum(size - n, 0)
    short = (size < n) & (pos == 0)
    if short.any():
        for i in np.flatnonzero(short):
            v = h[i]
            for k in range(1, int(size[i])):
                v = mix((v * _R + h[i + k])[None])[0]
            acc[i] = v + np.uint64(size[i])
    out = np.concatenate([[0], np.cumsum(np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)))])
    return acc[keep], out.astype(np.int64)
