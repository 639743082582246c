import unicodedata

import pyarrow as pa
import pytest

from lexigrid.llm import quality as Q
from tests.llm.conftest import words

SPACES = "\t\n\f\r "


def reasons(text):
    """The rules that reject a text, by plain Python."""
    text = text or ""
    w = [x for x in "".join(" " if c in SPACES else c for c in text).split(" ") if x]
    n, out = len(text), set()
    if not w:
        return {"blank"}
    if sum(c in Q.SYMBOLS for c in text) > Q.MAX_SYMBOLS * n:
        out.add("symbols")
    if sum(unicodedata.category(c) == "Lu" for c in text) > Q.MAX_UPPER * n:
        out.add("upper")
    if sum(a == b for a, b in zip(w, w[1:])) / len(w) > Q.MAX_REPEATS:
        out.add("repeats")
    lines = text.split("\n")
    if 1 - len(set(lines)) / len(lines) > Q.MAX_DUP_LINES:
        out.add("lines")
    if len(w) >= Q.LEAST_WORDS:
        if sum(any(unicodedata.category(c)[0] == "L" for c in x) for x in w) < Q.MIN_ALPHA * len(w):
            out.add("alpha")
        if not Q.WORD_LENGTH[0] <= sum(c not in SPACES for c in text) / len(w) <= Q.WORD_LENGTH[1]:
            out.add("word_length")
    return out


TEXTS = [
    *(words(i, 40, 10**6) for i in range(20)),
    "", None, "   \n\t ", "É", "ÀÉÎ ab", "#### ab cd", "a a a a b", "x\nx\nx\ny", "x\n\n\n", "1 2 3 " * 10, "漢字 " * 30, "a " * 30, "q" * 600 + " b" * 19,
    "abcdefghijklmnop " * 25, "🙂 🙂", "𝐀𝐁 c", "\x0b\x0b", "word\x00word", "ends\n", "\n", "Ünï Cödé text here",
]


def test_first_rejection_against_plain_python():
    got = Q.first_rejection(pa.array(TEXTS, pa.string()), Q.RULES)
    for text, k in zip(TEXTS, got):
        want = reasons(text)
        assert (k >= 0) == bool(want) and (k < 0 or Q.RULES[k].name in want), text


@pytest.mark.parametrize("order", [0, 1])
def test_driver_documents(spark, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in docs.collect() if not reasons(r.text)}
    rules = Q.RULES if order else Q.RULES[::-1]
    assert {r.doc_id for r in Q.keep(docs, rules=rules).collect()} == want and len(want) > 100


def test_odd_rows(odd):
    kept = Q.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [r.doc_id for r in odd.collect() if not reasons(r.text)]))


def test_empty_table(empty):
    assert Q.keep(empty).count() == 0


def test_order_by_rejection_per_cost():
    rules = [Q.Rule(n, None) for n in "abcd"]
    got = Q.ordered([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.0), ("d", 2.0, 0.0)], rules)
    assert [r.name for r in got] == ["b", "a", "c", "d"]


def test_the_sample_is_of_the_whole_table(make, monkeypatch):
    """Rows of every part of the table, whole texts of any length among them, are profiled where they are."""
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 120)
    docs = make([(i, "#" * 9) for i in range(300)] + [(i, words(i, 30)) for i in range(300, 600)] + [(None, words(7, 60_000)), (1, None)]).repartition(7)
    told = {name: (seconds, share) for name, seconds, share in Q.sampled(docs, "doc_id", "text")}
    assert set(told) == {r.name for r in Q.RULES} and 0 < told["symbols"][1] <= 1 and all(s > 0 for s, _ in told.values())
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 10**6)
    assert dict((n, round(x * 601)) for n, _, x in Q.sampled(docs, "doc_id", "text"))["symbols"] == 300


def test_cascade_stops_at_the_first_rejection():
    """Once a tenth of the texts is rejected, later rules don't get them."""
    seen = []

    def count(t):
        seen.append(len(t.offsets) - 1)
        return t.sums(t.data == ord("x")) > 0

    Q.first_rejection(pa.array(["x", "y", "z"]), [Q.Rule("one", count), Q.Rule("two", count)])
    assert seen == [3, 2]
