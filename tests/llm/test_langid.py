import random

from lexigrid.llm import langid as L
from tests.llm.conftest import rows

ALPHABETS = {"aa": "bcdeo", "bb": "fghiu", "cc": "jklma"}


def text(lang, seed, n=60):
    own = random.Random(lang)
    vocabulary = ["".join(own.choices(ALPHABETS[lang], k=own.randint(3, 7))) for _ in range(80)]
    return " ".join(random.Random(seed).choices(vocabulary, k=n))


def labelled():
    return [(i, text(lang, i), lang) for i, lang in enumerate(list(ALPHABETS) * 30)]


def test_held_out_accuracy(make):
    d = L.fit_dictionaries(make(labelled()))
    held = make([(1000 + i, text(lang, 1000 + i, 20), lang) for i, lang in enumerate(list(ALPHABETS) * 20)])
    got = {r.doc_id: r.pred_lang for r in L.identify(held, d).collect()}
    right = [got[r.doc_id] == r.lang for r in held.collect()]
    assert sum(right) / len(right) >= 0.95


def test_driver_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, L.fit_dictionaries(docs)).join(docs, "doc_id")
    told = got.where("pred_lang <> 'und'")
    assert told.where("pred_lang = lang").count() / told.count() >= 0.95
    assert told.count() / docs.count() >= 0.8


def test_sizes_are_those_of_single_blocks(make):
    import zstandard

    d = L.fit_dictionaries(make(labelled()))
    sample = (text("aa", 5, 3000)).encode()
    want = []
    for raw in d.values():
        z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=L.LEVEL, write_content_size=False, write_dict_id=False)
        want.append(sum(len(z.compress(sample[i : i + L.BLOCK])) for i in range(0, len(sample), L.BLOCK)))
    got = L.sizes(d)(sample)
    assert [abs(a - b) <= 0.02 * b for a, b in zip(got, want)] == [True] * len(want)


def test_odd_rows(odd, make):
    d = L.fit_dictionaries(make(labelled()))
    got = L.identify(odd, d)
    assert got.columns == ["doc_id", "pred_lang", "margin"] and got.count() == odd.count()
    by = [(r.doc_id, r.pred_lang, r.margin) for r in got.collect()]
    assert by.count((2, "und", 0.0)) == by.count((3, "und", 0.0)) == 1
    assert by.count((None, "und", 0.0)) >= 1  # the row without id or text
    assert len({x for x in by if x[0] == 1}) == 1


def test_nothing_to_fit_on(empty, odd):
    assert L.fit_dictionaries(empty) == {}
    assert {r.pred_lang for r in L.identify(odd, {}).collect()} == {"und"}
    assert rows(L.identify(empty, {})) == []


def test_tie_is_rejected(make):
    same = L.fit_dictionaries(make([(1, "abc def ghi " * 5, "aa")]))["aa"]
    got = L.identify(make([(1, "hello abc def")]), {"aa": same, "bb": same}).first()
    assert (got.pred_lang, got.margin) == ("und", 0.0)


def test_one_dictionary(make):
    d = L.fit_dictionaries(make([(1, "abc def ghi " * 5, "aa")]))
    assert tuple(L.identify(make([(1, "zzz")]), d).first()) == (1, "aa", 1.0)


def test_long_texts_alone_carry_a_language(make):
    """A language whose texts are all long has a dictionary, of parts from anywhere in them."""
    docs = make([(1, text("aa", 1, 60_000), "aa"), *((i, text("bb", i, 30), "bb") for i in range(2, 9)), *((1, text("aa", 1, 60_000), "aa") for _ in range(5))])
    d = L.fit_dictionaries(docs)
    assert set(d) == {"aa", "bb"} and 0.9 * L.DICT_BYTES < len(d["aa"]) < 1.1 * L.DICT_BYTES
    got = {r.doc_id: r.pred_lang for r in L.identify(make([(1, text("aa", 77, 25)), (2, text("bb", 78, 25))]), d).collect()}
    assert got == {1: "aa", 2: "bb"}


def test_query_against_plain_python(spark):
    """Every row's language and margin, from sizes under each dictionary taken text by text."""
    import re

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = L.fit_dictionaries(docs)
    made = {}
    for lang, raw in d.items():
        z = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z.precompute_compress(level=L.LEVEL)
        made[lang] = zstandard.ZstdCompressor(dict_data=z, level=L.LEVEL, write_content_size=False, write_dict_id=False)
    want = []
    for r in docs.collect():
        plain = re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", b" ", (r.text or "").lower().encode())
        size = sorted((sum(len(z.compress(plain[i : i + L.BLOCK])) for i in range(0, len(plain), L.BLOCK)), lang) for lang, z in made.items())
        gap = (size[1][0] - size[0][0]) / size[0][0] if plain else 0.0
        want.append((r.doc_id, size[0][1] if gap >= L.MARGIN else "und", round(gap, 6)))
    assert rows(L.identify(docs, d)) == sorted(want)
