"""Quality rules as a short-circuit cascade.

A rule is a kernel over the bytes of many texts (``arrowtext``) that tells
which to reject.  On a bounded sample each rule's cost (time) and selectivity
(share rejected) are estimated, and rules are ordered by rejection per cost; a
text that one rule rejects isn't counted by a later one, and once enough texts
of a slice are gone the rest is packed together, so later rules don't touch
them.  The order changes the time a run takes, never which texts are kept, so
measured times can't make results differ between runs.
"""

from __future__ import annotations

import functools
import sys
import time
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A

#: About so many rows are the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
SYMBOLS = "#%&*$|<>{}^~=_"
MAX_SYMBOLS, MAX_UPPER, MAX_REPEATS, MAX_DUP_LINES, MIN_ALPHA, WORD_LENGTH = 0.08, 0.4, 0.2, 0.4, 0.7, (2.0, 14.0)
#: Rules on shares of words need this many words to tell anything.
LEAST_WORDS = 20
#: Rejected share of a slice from which the rest is packed together.
PACK = 0.1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_HEAD = np.ones(256, bool)  # a byte that begins a character
_HEAD[128:192] = False


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether a character is a letter, an upper-case letter."""
    names = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    return np.array([n[0] == "L" for n in names]), np.array([n == "Lu" for n in names])


class Texts:
    """Texts laid end to end, and what several rules need of them, found out once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.offsets))

    @functools.cached_property
    def chars(self) -> np.ndarray:
        return self.sums(_HEAD[self.data])

    @functools.cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @functools.cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return A.runs(~self.space, self.offsets)

    @functools.cached_property
    def word_rows(self) -> np.ndarray:
        """Offsets of the texts in ``words``."""
        return np.searchsorted(self.words[0], self.offsets)

    @functools.cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_rows)

    @functools.cached_property
    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and code points of the characters beyond ASCII."""
        d = self.data
        at = np.flatnonzero(d >= 0xC2)
        b = [d[np.minimum(at + k, len(d) - 1)].astype(np.int32) for k in range(4)] if len(at) else [np.zeros(0, np.int32)] * 4
        two = (b[0] & 31) << 6 | b[1] & 63
        three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
        four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
        return at, np.minimum(np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)), sys.maxunicode)

    def marked(self, kind: int) -> np.ndarray:
        """Which bytes begin a letter (0) or an upper-case letter (1)."""
        table = _kinds()[kind]
        out = table[:256][self.data] & (self.data < 128)
        at, cp = self.wide
        out[at] = table[cp]
        return out


def _blank(t: Texts) -> np.ndarray:
    return t.sums(~t.space) == 0


def _symbols(t: Texts) -> np.ndarray:
    return t.sums(_SYMBOL[t.data]) > MAX_SYMBOLS * t.chars


def _upper(t: Texts) -> np.ndarray:
    return t.sums(t.marked(1)) > MAX_UPPER * t.chars


def _repeats(t: Texts) -> np.ndarray:
    h = A.hashes(t.data, *t.words)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[t.word_rows[:-1][t.n_words > 0]] = False
    count = np.diff(np.searchsorted(np.flatnonzero(same), t.word_rows))
    return count / np.maximum(t.n_words, 1) > MAX_REPEATS


def _lines(t: Texts) -> np.ndarray:
    ends = np.flatnonzero(t.data == 10)
    # A line begins at each text and behind each line end; it ends at the next line end of its text, or at the text's end.
    n = np.diff(np.searchsorted(ends, t.offsets)) + 1
    rows = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    starts, stops = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    own = np.ones(len(rows), bool)
    own[first] = False
    starts[first], starts[own] = t.offsets[:-1], ends + 1
    last = first + n - 1
    own[:] = True
    own[last] = False
    stops[last], stops[own] = t.offsets[1:], ends
    key = A.mix(A.hashes(t.data, starts, stops) + A.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((key, rows))
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.add.reduceat(new, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return 1 - distinct / n > MAX_DUP_LINES


def _alpha(t: Texts) -> np.ndarray:
    letters = np.flatnonzero(t.marked(0))
    starts, ends = t.words
    with_letter = np.searchsorted(letters, ends) > np.searchsorted(letters, starts)
    count = np.diff(np.searchsorted(np.flatnonzero(with_letter), t.word_rows))
    return (t.n_words >= LEAST_WORDS) & (count < MIN_ALPHA * t.n_words)


def _word_length(t: Texts) -> np.ndarray:
    mean = t.sums(_HEAD[t.data] & ~t.space) / np.maximum(t.n_words, 1)
    return (t.n_words >= LEAST_WORDS) & ~((mean >= WORD_LENGTH[0]) & (mean <= WORD_LENGTH[1]))


@dataclass(frozen=True)
class Rule:
    """``reject`` tells of ``Texts`` which to drop."""

    name: str
    reject: Callable[[Texts], np.ndarray]


RULES = (
    Rule("blank", _blank),
    Rule("symbols", _symbols),
    Rule("upper", _upper),
    Rule("repeats", _repeats),
    Rule("lines", _lines),
    Rule("alpha", _alpha),
    Rule("word_length", _word_length),
)


def profile(texts: pa.Array, rules=RULES) -> list[tuple[str, float, float]]:
    """``(name, seconds, texts rejected)`` of each rule on some texts."""
    data, o = A.flat(texts)
    out = []
    for rule in rules:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.thread_time()
            rejected = rule.reject(Texts(data, o)) if len(texts) else np.zeros(0, bool)
            best = min(best, time.thread_time() - began)
            hits = int(rejected.sum())
        out.append((rule.name, max(1e-7, best), hits))
    return out


def sampled(docs: DataFrame, id_col: str, text_col: str, rules=RULES) -> list[tuple[str, float, float]]:
    """``(name, seconds, share rejected)`` of each rule on about ``SAMPLE_ROWS`` rows, chosen over the whole table by a hash of id and text.

    The tasks time the rules where the texts are, whole texts of any length;
    only sums leave them.
    """
    share = int((1 << 31) * min(1.0, SAMPLE_ROWS / max(1, docs.count())))
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 31)) < share
    few = docs.where(F.col(text_col).isNotNull() & drawn).select(F.col(text_col).alias("text"))

    def run(batches):
        for b in A.slices(batches, "text"):
            told = profile(A.column(b, "text"), rules)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told]), pa.array([t[1] for t in told]), pa.array([t[2] for t in told], pa.int64()), pa.array([b.num_rows] * len(told), pa.int64())], ["name", "seconds", "hits", "n"])

    rows = few.mapInArrow(run, "name string, seconds double, hits long, n long").groupBy("name").agg(F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    told = {r.name: r for r in rows}
    return [(r.name, told[r.name].seconds, told[r.name].hits / told[r.name].n) if r.name in told else (r.name, 1.0, 0.0) for r in rules]


def ordered(profiled: list[tuple[str, float, float]], rules=RULES) -> list[Rule]:
    """The rules by rejection per cost, highest first; ties keep the given order."""
    worth = {name: share / cost for name, cost, share in profiled}
    return sorted(rules, key=lambda r: -worth[r.name])


def first_rejection(texts: pa.Array, rules) -> np.ndarray:
    """For each text the number of the first rule that rejects it, -1 if none does; a null text counts as empty."""
    out = np.full(len(texts), -1, np.int32)
    rows = np.arange(len(texts))
    t = Texts(*A.flat(texts))
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        hit = rule.reject(t) & (out[rows] < 0)
        out[rows[hit]] = k
        live = out[rows] < 0
        if not live.all() and (~live).mean() >= PACK:
            rows = rows[live]
            t = Texts(*A.flat(texts.take(pa.array(rows))))
    return out


def verdict(text: Column, rules) -> Column:
    """The name of the first rule that rejects a text, null if none does; only the text goes to the Arrow workers."""
    names = pa.array([r.name for r in rules], pa.string())

    @F.arrow_udf("string")
    def judge(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [first_rejection(A.column(b, "text"), rules) for b in A.slices([batch], "text")]
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        return names.take(pa.array(at, mask=at < 0))

    return judge(text)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects.

    Null, empty and blank texts are rejected (rule ``blank``).  Repeated rows
    are judged alike; a null id changes nothing.  An empty table stays empty.
    """
    rules = ordered(sampled(docs, id_col, text_col, rules), rules)
    return docs.where(verdict(F.col(text_col), rules).isNull())


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, source, text, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS w, string_split(text, chr(10)) AS lines FROM documents
)
SELECT doc_id, source, len(w) AS n_words FROM t
WHERE text IS NOT NULL AND regexp_matches(text, '\S')
  AND NOT length(text) - length(translate(text, '{SYMBOLS}', '')) > {MAX_SYMBOLS} * length(text)
  AND NOT length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) > {MAX_UPPER} * length(text)
  AND NOT len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / len(w) > {MAX_REPEATS}
  AND NOT 1 - len(list_distinct(lines)) / len(lines) > {MAX_DUP_LINES}
  AND NOT (len(w) >= {LEAST_WORDS} AND len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < {MIN_ALPHA} * len(w))
  AND NOT ((length(text) - length(regexp_replace(text, '\S', '', 'g'))) / len(w) NOT BETWEEN {WORD_LENGTH[0]} AND {WORD_LENGTH[1]} AND len(w) >= {LEAST_WORDS})
"""
