"""Kernels over sentences laid end to end: words as codes in one flat array, with the sentences' offsets.

A batch of ``array<string>`` rows becomes a dictionary of its words and one
array of codes, so that inner loops are numpy passes and no Python object is
made per token or pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens of the sentences that are worked on at a time (a longer sentence is one slice), and pairs counted at a time.
TOKENS, PAIRS = 1 << 20, 1 << 22
#: The most cells of two vocabularies that a task holds as a dense matrix.
CELLS = 1 << 22
#: Distinct words from which on a sentence counts as long.
LONG = 128
#: Draws are numbers under this prime.
PRIME = 2147483647


def gathered(batches, name: str, limit: int = TOKENS // 2) -> Iterator[pa.RecordBatch]:
    """Batches laid end to end until their lists hold ``limit`` values."""
    held, size = [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        o = column(b, name).offsets
        held.append(b)
        size += o[-1].as_py() - o[0].as_py()
        if size >= limit:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches, name: str, limit: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows whose lists hold at most ``limit`` values together."""
    for b in batches:
        if b.num_rows == 0:
            continue
        o = column(b, name).offsets.to_numpy()
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(o, o[start] + limit, "right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end


def lists(col: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, laid end to end, and their offsets."""
    o = col.offsets.to_numpy().astype(np.int64)
    return col.values.slice(int(o[0]), int(o[-1] - o[0])), o - o[0]


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each value, -1 for null, and the distinct values by code."""
    d = pc.dictionary_encode(values)
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def known(code: np.ndarray, dictionary: pa.Array, listed: pa.Array | None) -> np.ndarray:
    """``code`` with -1 for words that aren't listed."""
    if listed is None:
        return code
    ok = np.append(pc.is_in(dictionary, value_set=listed).to_numpy(zero_copy_only=False), False)
    return np.where(ok[code], code, -1)


def placed(code: np.ndarray, dictionary: pa.Array, listed: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """Places in a list for codes, -1 for words that aren't listed, and the list; without one, codes and dictionary as they are."""
    if listed is None:
        return code, dictionary
    at = np.append(pc.index_in(dictionary, value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
    return at[code], listed


def add(total: np.ndarray, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
    """Adds to the cells of a flat matrix how often their keys occur, or the keys' weights."""
    if len(keys) * 8 >= len(total):
        total += np.bincount(keys, weights, len(total)).astype(np.int64)
    elif len(keys):
        np.add.at(total, keys, 1 if weights is None else weights)


def cells(total: np.ndarray, names: pa.Array, named: pa.Array) -> Iterator[pa.RecordBatch]:
    """The cells of a flat matrix that aren't 0, by word and context."""
    at, width = np.flatnonzero(total), max(1, len(named))
    for i in range(0, len(at), 1 << 16):
        k = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(k // width)), named.take(pa.array(k % width)), pa.array(total[k])], ["word", "ctx", "n"])


def nested(keys: list[np.ndarray], width: int, named: pa.Array) -> pa.RecordBatch:
    """One row a context, key = context * width + target: its targets and how often it occurs with each, as pairs of 32-bit numbers laid end to end."""
    kinds, n = tally(keys)
    ctx = kinds // width
    first = np.flatnonzero(np.diff(ctx, prepend=-1))
    pairs = np.stack([kinds % width, n], axis=1).astype(np.uint32)
    bounds = (np.append(first, len(kinds)) * 8).astype(np.int32)
    return pa.RecordBatch.from_arrays([named.take(pa.array(ctx[first])), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(pairs)])], ["ctx", "pairs"])


def unnested(batches, names: pa.Array, limit: int = PAIRS // 4) -> Iterator[pa.RecordBatch]:
    """The sums of ``nested`` rows that are sorted by context, by word and context.

    About ``limit`` pairs are worked on at a time, and the last context's sums, one a target at most, wait for its next rows.
    """
    width = max(1, len(names))
    last, kept = None, np.zeros((2, 0), np.int64)

    def rows(key, n, kinds):
        return pa.RecordBatch.from_arrays([names.take(pa.array(key % width)), kinds.take(pa.array(key // width)), pa.array(n)], ["word", "ctx", "n"])

    for b in batches:
        start = 0
        while start < b.num_rows:
            _, offsets, data = column(b, "pairs").buffers()
            o = np.frombuffer(offsets, np.int32)[column(b, "pairs").offset :][: b.num_rows + 1].astype(np.int64)
            end = min(max(int(np.searchsorted(o, o[start] + 8 * limit, "right")) - 1, start + 1), b.num_rows)
            pairs = np.frombuffer(data, np.uint8)[o[start] : o[end]].view(np.uint32).reshape(-1, 2).astype(np.int64)
            code, kinds = codes(column(b, "ctx").slice(start, end - start))
            if last is not None and kinds[0].as_py() != last:
                yield rows(*kept, pa.array([last], names.type))
                kept = np.zeros((2, 0), np.int64)
            key, n = tally([kept[0], np.repeat(code * width, np.diff(o[start : end + 1]) // 8) + pairs[:, 0]], [kept[1], pairs[:, 1]])
            whole = int(np.searchsorted(key, (len(kinds) - 1) * width))
            if whole:
                yield rows(key[:whole], n[:whole], kinds)
            last, kept = kinds[-1].as_py(), np.stack([key[whole:] % width, n[whole:]])
            start = end
    if last is not None:
        yield rows(*kept, pa.array([last], names.type))


def taken(values: pa.Array, code: np.ndarray) -> pa.Array:
    """The values of codes, null for -1."""
    return values.take(pa.array(code, mask=code < 0))


class Held:
    """Counts of rows of values over a task's batches: equal rows are added up before they leave it, and at most about ``limit`` rows are held."""

    def __init__(self, names: list[str], limit: int = 1 << 20):
        self.names, self.limit, self.parts, self.rows = names, limit, [], 0

    def add(self, values: list[pa.Array], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes a batch's counts, and gives those held if they are too many."""
        self.parts.append(pa.table([*values, pa.array(n, pa.int64())], [*self.names, "n"]))
        self.rows += len(n)
        if self.rows > self.limit:
            whole = self._whole()
            self.parts, self.rows = [whole], whole.num_rows
            if self.rows > self.limit // 2:
                yield from self.rest()

    def _whole(self) -> pa.Table:
        both = pa.concat_tables(self.parts)
        if len(self.parts) == 1:
            return both
        return both.group_by(self.names, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select([*self.names, "n"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._whole().to_batches(max_chunksize=1 << 16)
        self.parts, self.rows = [], 0


class Join:
    """An inner join with an array of keys: places in other keys, and the places here that are equal to them."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.keys, keys)
        size = np.searchsorted(self.keys, keys, "right") - first
        i = np.repeat(np.arange(len(keys)), size)
        return i, self.order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(i))]


def dense(*columns: np.ndarray) -> np.ndarray:
    """One number for each distinct row of columns of numbers from -1."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * (int(c.max(initial=-1)) + 2) + c + 1, return_inverse=True)[1]
    return out


def draws(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers from 0 to ``PRIME`` - 1 by a row's base and a place in it; ``text.draw`` is the same as a Column."""
    base = base.astype(np.int64)
    x = (base + place * 1000003) % PRIME
    x = (x * x + 12345) % PRIME
    x = (x * x + base) % PRIME
    return x * 48271 % PRIME


def grams(code: np.ndarray, dictionary: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """A code for the run of n items from each item, -1 where one is missing, and the runs as text."""
    out, names, width = code, dictionary, max(1, len(dictionary))
    for k in range(1, n):
        after = np.full(len(code), -1, np.int64)
        after[: max(0, len(code) - k)] = code[k:]
        ok = (out >= 0) & (after >= 0)
        kinds, at = np.unique(out[ok] * width + after[ok], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(kinds // width)), dictionary.take(pa.array(kinds % width)), " ")
        out = np.full(len(code), -1, np.int64)
        out[ok] = at
    return out, names


def around(target: np.ndarray, ctx: np.ndarray, offsets: np.ndarray, sides: tuple[int, int], n: int, dirty: bool, reach: Callable | None = None):
    """``(items' places, parts)``; each part has the targets' places, the first items of their context runs, and signed distances.

    Items are all places, or for ``dirty`` those of context words alone.
    ``reach`` gives the sizes of the sides by place in the sentence and
    sentence; without it they are ``sides``.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if dirty:
        own = ctx >= 0
        items = np.flatnonzero(own)
        before = np.cumsum(own) - own
        bounds = np.searchsorted(items, offsets)
    else:
        items = before = np.arange(len(ctx))
        own, bounds = np.ones(len(ctx), bool), offsets

    def parts():
        t = np.flatnonzero(target >= 0)
        r = row[t]
        left, right = before[t], before[t] + own[t]
        low, high = bounds[r], bounds[r + 1]
        near, far = reach(t - offsets[r], r) if reach else sides
        for j in range(sides[0] - n + 1):
            k = left - n - j
            ok = (k >= low) & (j <= near - n)
            k = k[ok]
            yield t[ok], k, items[k + n - 1] - t[ok]
        for j in range(sides[1] - n + 1):
            k = right + j
            ok = (k + n <= high) & (j <= far - n)
            k = k[ok]
            yield t[ok], k, items[k] - t[ok]

    return items, parts()


def tally(keys: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs, or the sum of its weights."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    if weights is None:
        return np.unique(key, return_counts=True)
    kinds, at = np.unique(key, return_inverse=True)
    return kinds, np.bincount(at, np.concatenate(weights) if weights else None, len(kinds)).astype(np.int64)


def sentence_pairs(target: np.ndarray, ctx: np.ndarray, offsets: np.ndarray, width: int, limit: int = PAIRS, total: np.ndarray | None = None):
    """``(keys, counts)`` of the pairs of words of one sentence, key = target * width + context, a chunk of about ``limit`` pairs at a time.

    A word x times and another y times make x y pairs, a word with itself x (x - 1).
    With ``total``, a flat matrix of all cells, they are added to it and not given; long
    sentences are then multiplied as rows of a matrix, in blocks.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def counted(code):
        ok = code >= 0
        kinds, n = np.unique(row[ok] * width + code[ok], return_counts=True)
        return kinds // width, kinds % width, n

    tr, tw, tn = counted(target)
    cr, cw, cn = counted(ctx)
    if total is not None:
        is_long = np.bincount(cr, minlength=len(offsets) - 1) >= LONG
        square, block = total.reshape(width, width), 128
        place = np.cumsum(is_long) - 1
        t_long, c_long = is_long[tr], is_long[cr]
        rows = [(place[r[ok]], w[ok], n[ok]) for r, w, n, ok in ((tr, tw, tn, t_long), (cr, cw, cn, c_long))]
        for i in range(0, int(is_long.sum()), block):
            t, c = np.zeros((2, block, width))
            for m, (r, w, n) in zip((t, c), rows):
                a, b = np.searchsorted(r, [i, i + block])
                m[r[a:b] - i, w[a:b]] = n[a:b]
            square += (t.T @ c).astype(np.int64)
            # a word isn't a context of the same place
            square[np.arange(width), np.arange(width)] -= (t * (c > 0)).sum(axis=0).astype(np.int64)
        tr, tw, tn = tr[~t_long], tw[~t_long], tn[~t_long]
    first, last = np.searchsorted(cr, tr), np.searchsorted(cr, tr, "right")
    done = np.concatenate([[0], np.cumsum(last - first)])
    start = 0
    while start < len(tr):
        end = max(start + 1, int(np.searchsorted(done, done[start] + limit, "right")) - 1)
        size = (last - first)[start:end]
        base = done[start:end] - done[start]
        at = np.repeat(first[start:end] - base, size) + np.arange(size.sum())
        w = np.repeat(tw[start:end], size)
        n = np.repeat(tn[start:end], size) * (cn[at] - (w == cw[at]))
        some = n > 0
        if total is None:
            yield tally([(w * width + cw[at])[some]], [n[some]])
        else:
            add(total, w * width + cw[at], n)
        start = end


def merged(code: np.ndarray, dictionary: pa.Array, offsets: np.ndarray, hit: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Tokens after merging the places that ``hit`` with the next ones, from left to right, and new offsets; a merged token takes part in no other pair."""
    at = np.arange(len(code))
    begins = hit & ~np.append(False, hit[:-1])
    run = np.maximum.accumulate(np.where(begins, at, -1)) if len(at) else at
    chosen = hit & ((at - run) % 2 == 0)
    gone = np.append(False, chosen[:-1])[: len(at)]
    words = dictionary.take(pa.array(code, mask=code < 0)) if len(code) else pa.array([], pa.string())
    after = pc.if_else(pa.array(chosen), pc.binary_join_element_wise(words, pa.concat_arrays([words.slice(1), pa.nulls(min(1, len(words)), words.type)]), " "), words)
    return after.filter(pa.array(~gone)), np.concatenate([[0], np.cumsum(~gone)])[offsets]
