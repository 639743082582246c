import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import packing as P
from tests.llm.conftest import rows, words


def brute(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        fit = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fit:
            room, i = min(fit)
        else:
            bins.append(capacity)
            room, i = capacity, len(bins) - 1
        out.append((i, capacity - room))
        bins[i] = room - n
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_against_brute_force(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 64, 100, 2048])
    lengths = sorted((r.choice([r.randint(1, capacity), min(capacity, 3)]) for _ in range(600)), reverse=True)
    runs, want, seen = P.plan(Counter(lengths), capacity, 5), brute(lengths, capacity), Counter()
    for n, (b, o) in zip(lengths, want):
        rank = seen[n]
        seen[n] += 1
        (run,) = [x for x in runs.tolist() if x[0] == n and x[1] <= rank < x[1] + x[2]]
        k = rank - run[1]
        assert (run[4] + k // run[3] - 5, run[5] + k % run[3] * n) == (b, o)


def packed(sizes, capacity):
    """Brute force over ``(id, size)``: full pieces first, then rests."""
    rests = sorted((-(n % capacity), i is not None, i, n // capacity) for i, n in sizes)
    out = []
    for neg, _, i, full in rests:
        out += [(len(out) + k, 0, i, k, k * capacity, capacity) for k in range(full)]
    pieces = [(i, full, -neg) for neg, _, i, full in rests if neg]
    base = len(out)
    return out + [(base + b, o, i, full, full * capacity, n) for (i, full, n), (b, o) in zip(pieces, brute([p[2] for p in pieces], capacity))]


@pytest.mark.parametrize("task_rows", [30, 10**6])
def test_query_against_brute_force(make, monkeypatch, task_rows):
    monkeypatch.setattr(P, "TASK_ROWS", task_rows)
    r = random.Random(1)
    docs = make([(i, words(i, r.choice([r.randint(0, 90), 17]))) for i in range(300)])
    sizes = [(x.doc_id, len(x.text.split())) for x in docs.collect()]
    assert rows(P.pack(docs, capacity=40)) == sorted(packed([x for x in sizes if x[1]], 40))


def test_one_heavy_key_is_split(make, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 50)
    docs = make([(None, "a b c")] * 300 + [(1, "a b c")] * 200)
    got = P.pack(docs, capacity=10).collect()
    assert len(got) == 500 and len({(x.bin, x.start) for x in got}) == 500 and max(x.bin for x in got) == 166
    # nulls come before others of their length
    assert max(x.bin for x in got if x.doc_id is None) <= min(x.bin for x in got if x.doc_id == 1)


def test_bins_hold_every_word_once(odd):
    got = P.pack(odd, capacity=100).collect()
    assert all(0 <= r.start and r.start + r.length <= 100 for r in got)
    used = {}
    for r in got:
        used.setdefault(r.bin, []).append((r.start, r.length))
    for spans in used.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    total = sum(len(r.text.split()) for r in odd.collect() if r.text)
    assert sum(r.length for r in got) == total
    assert {r.doc_id for r in got} == {1, None, 4, 5, 6, 8}


def test_empty_table(empty):
    assert rows(P.pack(empty)) == []


def test_own_length(make):
    got = P.pack(make([(1, "a"), (2, None)]), length=F.lit(5), capacity=4)
    assert sum(r.length for r in got.collect()) == 10
