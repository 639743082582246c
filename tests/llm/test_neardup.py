import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import arrowtext as A
from lexigrid.llm import neardup as N
from tests.llm.conftest import rows, words


def shingle_set(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(w, w[1:])) if len(w) >= N.SHINGLE else {tuple(w)} if w else set()


def components_of(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return sorted((i, find(i)) for i in root if find(i) != i)


def brute(docs, threshold=N.THRESHOLD, banded=False):
    """Groups of all pairs that reach the threshold; ``banded``: of those that share a band and pass every batch's bound."""
    items = [(r.doc_id, shingle_set(r.text), r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None]
    items = [x for x in items if x[1]]
    sig = N.sign(*A.shingles(*A.words(*A.flat(pa.array([x[2] for x in items]))), N.SHINGLE)) if banded else None
    pairs = []
    for k, (a, x, _) in enumerate(items):
        for j, (b, y, _) in enumerate(items[:k]):
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and (n := len(x & y)) and n / (len(x) + len(y) - n) >= threshold:
                same = x == y or not banded
                if same or (sig[k] == sig[j]).reshape(-1, N.ROWS).all(axis=1).any() and N.survives(sig[k : k + 1], sig[j : j + 1], N.least_matches()).all():
                    pairs.append((a, b))
    return components_of([x[0] for x in items], pairs)


def corpus(make):
    """Groups of copies with some words changed, from clearly above the threshold to clearly below."""
    r, out = random.Random(3), []
    for g in range(25):
        base = words(g, r.choice([40, 120, 400]), 10**6).split()
        for share in [0.0, 0.02, 0.05, 0.08, 0.3, 0.6][: r.randint(1, 6)]:
            out.append(" ".join(w if r.random() > share else f"n{r.random()}".replace(".", "") for w in base))
    r.shuffle(out)
    return make(list(enumerate(out)))


def test_against_brute_force(make):
    docs = corpus(make)
    got, want, all_ = rows(N.groups(docs)), brute(docs, banded=True), brute(docs)
    assert got == want and len(set(all_) & set(got)) >= 0.98 * len(all_) > 20


def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(N.groups(docs)) == brute(docs, banded=True) == brute(docs)


@pytest.mark.parametrize("sent, block", [(N.SENT, N.BLOCK), (0, 8)])
def test_pages_of_one_template(make, monkeypatch, sent, block):
    """Pages that share most words are in the same buckets and below the threshold; copies among them are found, whatever way they go."""
    monkeypatch.setattr(N, "SENT", sent)
    monkeypatch.setattr(N, "BLOCK", block)
    r, base = random.Random(4), words(9, 62, 10**6)
    own = [f"{base} {words(100 + i, 38, 10**6)}" for i in range(240)]
    short = [f"{words(9, r.choice([6, 8, 9]), 10**6)} {words(500 + i, 3, 60)}" for i in range(120)]
    docs = make(list(enumerate([*own, *(f"{t} {words(7, 9, 10**6)}" for t in own[:200:9]), *short])))
    pools, sharing = [], N._sharing
    monkeypatch.setattr(N, "_sharing", lambda sets, pool, t: pools.append(sharing(sets, pool, t)) or pools[-1])
    got = rows(N.groups(docs))
    assert got == brute(docs, banded=True) and len(got) > 20 and len(pools) == 1


def test_prefixes_lose_no_pair(spark, monkeypatch):
    r, ids = random.Random(8), range(150)
    sets = {i: sorted(r.sample(range(60), r.randint(1, 14))) for i in ids}
    for i in range(2, 150, 3):  # some near copies
        sets[i] = sorted({*r.sample(sets[i - 2], max(1, len(sets[i - 2]) - 2)), *r.sample(range(60), r.randint(0, 2))})
    pool = spark.createDataFrame([(i, i // 2) for i in ids], "id long, root long")
    monkeypatch.setattr(N, "FEW", 2)
    for t in (0.3, 0.6, 0.8):
        got = set(rows(N._sharing(spark.createDataFrame(list(sets.items()), "id long, set array<long>"), pool, t)))
        want = {(a, b) for b in ids for a in range(b) if a // 2 != b // 2 and len(set(sets[a]) & set(sets[b])) >= t * len(set(sets[a]) | set(sets[b]))}
        assert want <= got and len(want) > 5 and all(a < b for a, b in got)


def test_a_hot_group_is_one_group(make):
    base = words(5, 80, 10**6).split()
    docs = make([(i, " ".join([*base[:70], *[f"t{i}v{k}" for k in range(3)], *base[73:]])) for i in range(400)])
    assert rows(N.groups(docs)) == [(i, 0) for i in range(1, 400)]


def test_odd_rows(odd):
    assert rows(N.groups(odd)) == brute(odd) == [(5, 4), (8, 1)]
    kept = N.drop_near(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 1, 2, None, 3, 4, 6, 7, None]))


def test_an_id_with_near_copies_unique_and_null_texts(make):
    """Each text is judged by itself, also where ids with several texts tie groups together."""
    a, b, c = (words(k, 80, 10**6) for k in (1, 2, 3))
    docs = make([(1, a), (5, f"{a} more"), (5, c), (5, None), (5, ""), (9, f"{c} more"), (6, b), (7, f"{b} more"), (None, a)])
    assert rows(N.drop_near(docs).select("doc_id", "text")) == rows(make([(1, a), (5, c), (5, None), (5, ""), (6, b), (None, a)]).select("doc_id", "text"))


def test_empty_table(empty):
    assert rows(N.groups(empty)) == [] and N.drop_near(empty).count() == 0


def test_words_only_and_short_texts(make):
    docs = make([(1, "One"), (2, "one!"), (3, "one two"), (4, "ONE, two"), (5, "..."), (6, "...")])
    assert rows(N.groups(docs)) == [(2, 1), (4, 3)]


def test_bounds_keep_pairs_at_the_threshold():
    """Of pairs exactly at the threshold the tests together lose few."""
    r = np.random.default_rng(0)
    n = N.ROWS * N.BANDS
    match = r.random((20_000, n)) < N.THRESHOLD
    a = np.zeros((20_000, n), np.uint32)
    kept = N.survives(a, np.where(match, 0, 1).astype(np.uint32), N.least_matches())
    assert kept.mean() > 0.97
    far = np.where(r.random((2000, n)) < 0.2, 0, 1).astype(np.uint32)
    assert N.survives(a[:2000], far, N.least_matches()).mean() < 0.001


def test_posterior_bound_is_the_beta_tail():
    """The bound for a batch is the fewest matches whose posterior tail, integrated by steps, reaches the miss probability."""
    x = (np.arange(200_000) + 0.5) / 200_000
    for i, m in enumerate(N.least_matches()):
        n = (i + 1) * N.BATCH

        def tail(k):
            log = k * np.log(x) + (n - k) * np.log1p(-x)
            d = np.exp(log - log.max())
            return d[x >= N.THRESHOLD].sum() / d.sum()

        assert tail(m) >= N.MISS * 0.999 and (m == 0 or tail(m - 1) < N.MISS * 1.001)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = N.components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(got) == sorted((i, find(i)) for i in root)
