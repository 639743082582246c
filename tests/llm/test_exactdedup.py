import random

import numpy as np

from lexigrid.llm import exactdedup as X
from tests.llm.conftest import rows, words


def brute(docs):
    by = {}
    for r in docs.collect():
        if r.doc_id is not None and r.text is not None:
            by.setdefault(r.text, set()).add(r.doc_id)
    return sorted((i, min(ids)) for ids in by.values() for i in ids if i != min(ids))


def corpus(make, n=200):
    r = random.Random(4)
    texts = [words(k, r.choice([0, 1, 30, 900, 9000])) for k in range(60)]
    return make([(i, r.choice(texts)) for i in r.sample(range(10_000), n)])


def test_against_brute_force(make):
    docs = corpus(make)
    assert rows(X.copies(docs)) == brute(docs)


def test_odd_rows(odd):
    assert rows(X.copies(odd)) == brute(odd)
    kept = X.drop_copies(odd)
    assert kept.columns == odd.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # one row of id 1 stays of the two; 5 and 8 go as copies of 4 and 1
    assert sorted(str(g[0]) for g in got) == sorted(map(str, [1, 2, None, 3, 4, 6, 7, None]))


def test_empty_table(empty):
    assert rows(X.copies(empty)) == [] and X.drop_copies(empty).count() == 0


def test_drop_keeps_one_of_each_text(make):
    docs = corpus(make)
    kept = X.drop_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.doc_id for r in docs.collect()} - {i for i, _ in brute(docs)})
    assert len({r.text for r in kept}) == len(kept)


def test_one_id_with_several_texts(make):
    docs = make([(1, "a b"), (1, "c d"), (2, "c d"), (0, "a b"), (3, "e"), (3, "e")])
    assert rows(X.copies(docs)) == [(1, 0), (2, 1)]
    assert sorted((r.doc_id, r.text) for r in X.drop_copies(docs).collect()) == [(0, "a b"), (1, "c d"), (3, "e")]


def test_an_id_with_copied_unique_and_null_texts(make):
    """Only the copies go; rows of the same id that are no copies stay."""
    docs = make([(1, "A"), (5, "A"), (5, "B unique"), (5, None), (6, "A"), (6, "A"), (7, "C"), (8, "C"), (8, None)])
    assert rows(X.copies(docs)) == [(5, 1), (6, 1), (8, 7)]
    assert rows(X.drop_copies(docs).select("doc_id", "text")) == rows(make([(1, "A"), (5, "B unique"), (5, None), (7, "C"), (8, None)]).select("doc_id", "text"))


def test_equal_identifiers_of_different_chunks(make):
    """With a digest that tells nothing apart but the length, verification still does."""
    docs = make([(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, ""), (5, "")])
    same = X.verified(docs, "doc_id", "text", digest=lambda raw: b"0" * 16)
    got = same.groupBy("recipe").agg({"id": "collect_set"}).collect()
    assert sorted(sorted(r[1]) for r in got if len(r[1]) > 1) == [[1, 3], [4, 5]]


def test_chunks_follow_the_content():
    raw = words(9, 20_000).encode()
    one = np.frombuffer(raw, np.uint8)
    two = np.frombuffer(b"something before " + raw, np.uint8)
    a = X.borders(one, np.array([0, len(one)]))[0]
    b = X.borders(two, np.array([0, len(two)]))[0]
    assert len(set(a) & {x - 17 for x in b}) > 0.8 * len(a)
    sizes = np.diff([0, *a])
    assert sizes.max() <= X.MOST and sizes[:-1].min() >= X.LEAST and a[-1] == len(one)
