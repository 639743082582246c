"""Counting: words, bigrams, sizes, and vocabularies with their filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import flat
from ..functions import text as T
from ..functions.errors import NotAllowedValue, OutOfVocabulary, UnsupportedType
from ..plans.store import listed, materialize

Filter = Callable[[DataFrame], DataFrame]
#: The most words that are ranked in one task.
RANKED = 1_000_000


def tokens(sentences: DataFrame, *keep: str) -> DataFrame:
    """``(doc_id, sent_id, pos, word)``, positions from 0."""
    return sentences.select("doc_id", "sent_id", *keep, F.posexplode("tokens").alias("pos", "word"))


#: The attributes by which annotated tokens are counted.
ATTRIBUTES = ("form", "lemma", "POS")


def _coded(values: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """A code for each token, and by code the distinct tokens' attributes, or their one text."""
    columns = values.flatten() if pa.types.is_struct(values.type) else [values]
    parts = [flat.codes(c) for c in columns]
    code = flat.dense(*[c for c, _ in parts]) if len(parts) > 1 else parts[0][0] + 1
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code] = np.arange(len(code))
    if len(parts) == 1:
        return code, [flat.taken(parts[0][1], np.arange(len(first)) - 1)]
    return code, [flat.taken(names, c[first]) for c, names in parts]


def count_words(sentences: DataFrame) -> DataFrame:
    """``(word, n)``; annotated tokens are counted as (form, lemma, POS), in the sentences' own tasks first."""
    kind = sentences.schema["tokens"].dataType.elementType
    if kind.simpleString() == "string":
        return sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    one, columns = _attributes(kind)

    def run(batches):
        held = flat.Held(columns)
        for b in flat.slices(flat.gathered(batches, "tokens"), "tokens"):
            code, names = _coded(flat.lists(b.column(0))[0])
            yield from held.add(names, np.bincount(code, minlength=len(names[0])))
        yield from held.rest()

    found = sentences.select(_projected(sentences)).mapInArrow(run, f"{', '.join(f'{c} {one[c]}' for c in columns)}, n long")
    return found.groupBy(*columns).agg(F.sum("n").alias("n")).select(F.struct(*columns).alias("word"), "n")


def _attributes(kind) -> tuple[dict[str, str], list[str]]:
    """The types of the attributes by which tokens are counted."""
    one = {f.name: f.dataType.simpleString() for f in kind if f.name in ATTRIBUTES}
    return one, list(ATTRIBUTES)


def _projected(sentences: DataFrame):
    """Tokens with the attributes by which they are counted, or as texts."""
    kind = sentences.schema["tokens"].dataType.elementType
    plain = kind.simpleString() == "string" or tuple(kind.fieldNames()) == ATTRIBUTES
    return (F.col("tokens") if plain else T.project(F.col("tokens"), ATTRIBUTES)).alias("tokens")


def count_bigrams(sentences: DataFrame) -> DataFrame:
    """``(first, second, n)`` of adjacent tokens; a pair never crosses a sentence's end.

    Pairs are counted in the sentences' own tasks first.
    """
    kind = sentences.schema["tokens"].dataType.elementType
    one, columns = ({"word": "string"}, ["word"]) if kind.simpleString() == "string" else _attributes(kind)
    both = [f"{c}{k}" for k in (1, 2) for c in columns]

    def run(batches):
        held = flat.Held(both)
        for b in flat.slices(flat.gathered(batches, "tokens"), "tokens"):
            values, o = flat.lists(b.column(0))
            code, names = _coded(values)
            within = np.ones(len(code), bool)
            within[o[1:][o[1:] > 0] - 1] = False
            at, width = np.flatnonzero(within), max(1, len(names[0]))
            kinds, n = np.unique(code[at] * width + code[at + 1], return_counts=True)
            yield from held.add([x.take(pa.array(c)) for c in (kinds // width, kinds % width) for x in names], n)
        yield from held.rest()

    found = sentences.select(_projected(sentences)).mapInArrow(run, f"{', '.join(f'{c} {one[c[:-1]]}' for c in both)}, n long")
    token = lambda k: (F.col(f"word{k}") if columns == ["word"] else F.struct(*[F.col(f"{c}{k}").alias(c) for c in columns]))
    return found.groupBy(*both).agg(F.sum("n").alias("n")).select(token(1).alias("first"), token(2).alias("second"), "n")


def describe(sentences: DataFrame, *by: str) -> DataFrame:
    """Sentences (empty ones too), tokens and distinct words, of all or by given columns."""
    sizes = sentences.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sentences"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n_tokens"))
    words = sentences.select(*by, F.explode("tokens").alias("word")).groupBy(*by, "word").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_words"))
    if not by:
        return sizes.crossJoin(words)
    return sizes.join(words, list(by), "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


# Filters on counts: each maps (word, n) to (word, n) and they apply in order.


def truncate(k: int) -> Filter:
    """The k most frequent words; of equal counts the first by word."""

    def run(counts: DataFrame) -> DataFrame:
        return counts.orderBy(F.desc("n"), "word").limit(k)

    run.most = k
    return run


def _threshold(m: float, keep: Callable) -> Filter:
    if m < 0:
        raise NotAllowedValue(f"a frequency is not negative: {m}")
    if m >= 1:
        return lambda counts: counts.where(keep(F.col("n"), m))

    def relative(counts: DataFrame) -> DataFrame:
        # One row with the total of what earlier filters left.
        total = counts.agg(F.sum("n").alias("_total"))
        return counts.crossJoin(F.broadcast(total)).where(keep(F.col("n") / F.col("_total"), m)).drop("_total")

    return relative


def remove_least_frequent(m: float) -> Filter:
    """Keep counts of at least m, or shares of at least m if m < 1."""
    return _threshold(m, lambda x, y: x >= y)


def remove_most_frequent(m: float) -> Filter:
    """Keep counts of at most m, or shares of at most m if m < 1."""
    return _threshold(m, lambda x, y: x <= y)


def remove_elements(stop: Iterable[str] | str, attribute: str | None = None) -> Filter:
    """Drop listed words; a string drops every word that is a part of it."""

    def run(counts: DataFrame) -> DataFrame:
        col = F.col(f"word.{attribute}") if attribute else F.col("word")
        if isinstance(stop, str):
            return counts.where(F.instr(F.lit(stop), col) == 0)
        listed = counts.sparkSession.createDataFrame([(w,) for w in sorted(set(stop))], "stop string")
        return counts.join(listed, col == F.col("stop"), "left_anti")

    return run


def filter_by_attribute(attribute: str, values: Iterable[str] | str) -> Filter:
    """Keep tokens whose attribute has one of the values."""
    listed = [values] if isinstance(values, str) else list(values)
    return lambda counts: counts.where(F.col(f"word.{attribute}").isin(listed))


def filter_attributes(attributes: str | tuple[str, ...]) -> Filter:
    """Reduce tokens to attributes and add up the counts of those that become equal."""

    def run(counts: DataFrame) -> DataFrame:
        col = F.col(f"word.{attributes}") if isinstance(attributes, str) else F.struct(*[F.col(f"word.{a}").alias(a) for a in attributes])
        return counts.groupBy(col.alias("word")).agg(F.sum("n").alias("n"))

    return run


def create_vocabulary(counts: DataFrame, attributes: str | tuple[str, ...] | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """``(word, idx)`` by falling count, then word.

    What a ``truncate`` leaves last is ranked in one task.  Other vocabularies
    are sorted in ranges, and a range's words are numbered from the number of
    words before it.
    """
    filters = list(filters)
    if attributes is not None:
        counts = filter_attributes(attributes)(counts)
    for f in filters:
        counts = f(counts)
    if filters and getattr(filters[-1], "most", RANKED + 1) <= RANKED:
        return counts.select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("long").alias("idx"))
    return ranked(counts, F.desc("n"), F.asc("word")).select("word", "idx")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``idx``, their places from 0 in an order, without bringing them to one task.

    They are written once, sorted in ranges; then only the ranges' sizes are
    gathered.
    """
    at = F.monotonically_increasing_id().alias("_at")
    held = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", at), "ranked")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted((r[0], r[1]) for r in held.groupBy(part).agg(F.count(F.lit(1))).collect())
    before, bases = 0, []
    for p, n in sizes:
        bases.append((p, before))
        before += n
    base = rows.sparkSession.createDataFrame(bases, "_part long, _base long")
    return held.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("idx", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*rows.columns, "idx")


def vocabulary(spark, words) -> DataFrame:
    """A vocabulary from a list (kept in order), a dict word -> index, or a DataFrame with ``word`` and ``idx``; a pair or a string with a space is a bigram."""
    if isinstance(words, DataFrame):
        return words.select("word", F.col("idx").cast("long"))
    if isinstance(words, dict):
        words = sorted(words, key=words.get)
    if not isinstance(words, (list, tuple)):
        raise UnsupportedType(f"no vocabulary can be made of {type(words).__name__}")
    flat = [" ".join(w) if isinstance(w, tuple) else w for w in words]
    return spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(flat))], "word string, idx long")


def merge_vocabularies(*vocabs: DataFrame) -> DataFrame:
    """The ordered union: words keep the place of their first vocabulary."""
    rows = None
    for k, v in enumerate(vocabs):
        part = v.select("word", F.struct(F.lit(k).alias("v"), F.col("idx")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy("word").agg(F.min("at").alias("at")), F.asc("at")).select("word", "idx")


def index_of(vocab: DataFrame, word: str) -> int:
    """A word's index; a word that isn't there is an error."""
    row = vocab.where(F.col("word") == word).select("idx").first()
    if row is None:
        raise OutOfVocabulary(word)
    return row[0]


def bigrams_of(vocab: DataFrame) -> DataFrame:
    """The entries of a vocabulary that are bigrams."""
    return vocab.where(F.instr("word", " ") > 0)


def _rebuilt(sentences: DataFrame, kernel: Callable, kind: str) -> DataFrame:
    """``sentences`` with ``tokens`` replaced by what ``kernel`` makes of a batch; all other columns stay, and nothing is shuffled."""
    schema = T_.StructType([f if f.name != "tokens" else T_.StructField("tokens", T_._parse_datatype_string(kind)) for f in sentences.schema])

    def run(batches):
        for b in flat.slices(batches, "tokens"):
            at = b.schema.get_field_index("tokens")
            new = kernel(b)
            yield b.set_column(at, pa.field("tokens", new.type), new)

    return sentences.mapInArrow(run, schema)


def merge_bigrams(sentences: DataFrame, bigrams: DataFrame) -> DataFrame:
    """Sentences after merging listed pairs (``word``: two words with a space between) from left to right into one token each.

    A merged token takes part in no other pair.  A list of a checked size is
    looked up in the workers; for another one the sentences' adjacent pairs are
    joined with it.
    """
    few = listed(bigrams, "word")
    if few == []:
        return sentences
    if few is not None:
        shared = sentences.sparkSession.sparkContext.broadcast(few)

        def kernel(b):
            values, o = flat.lists(flat.column(b, "tokens"))
            code, names = flat.codes(values)
            width = max(1, len(names))
            parts = [x.split(" ", 1) for x in shared.value]
            first, second = (pc.index_in(pa.array([p[k] for p in parts], pa.string()), value_set=names).fill_null(-1).to_numpy().astype(np.int64) for k in (0, 1))
            keys = (first * width + second)[(first >= 0) & (second >= 0)]
            after = np.append(code[1:], -1)[: len(code)]
            after[o[1:-1][(o[1:-1] > 0) & (o[1:-1] <= len(code))] - 1] = -1
            hit = np.isin(np.where((code >= 0) & (after >= 0), code * width + after, -1), keys)
            new, cuts = flat.merged(code, names, o, hit)
            return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), new)

        return _rebuilt(sentences, kernel, "array<string>")
    keyed = sentences.withColumn("_row", F.monotonically_increasing_id())
    size = F.greatest(F.size("tokens") - 1, F.lit(0))
    pairs = keyed.select("_row", F.posexplode(F.arrays_zip(F.slice("tokens", 1, size).alias("x"), F.slice("tokens", 2, size).alias("y"))).alias("pos", "p"))
    hits = pairs.select("_row", "pos", F.concat("p.x", F.lit(" "), "p.y").alias("word")).join(bigrams.select("word").distinct(), "word", "left_semi")
    both = keyed.join(hits.groupBy("_row").agg(F.collect_list("pos").alias("_hits")), "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<int>")))

    def joined(b):
        values, o = flat.lists(flat.column(b, "tokens"))
        code, names = flat.codes(values)
        at, ho = flat.lists(flat.column(b, "_hits"))
        hit = np.zeros(len(code), bool)
        hit[at.to_numpy() + np.repeat(o[:-1], np.diff(ho))] = True
        new, cuts = flat.merged(code, names, o, hit)
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), new)

    return _rebuilt(both, joined, "array<string>").select(sentences.columns)


def encode(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, ids)``: the index of each token in its place, -1 out of vocabulary.

    A vocabulary of a checked size is looked up in the sentences' own tasks;
    for another one tokens are joined with it and gathered again.
    """
    slim = sentences.select("doc_id", "sent_id", "tokens")
    words = listed(vocab, "word")
    if words is not None:
        shared = sentences.sparkSession.sparkContext.broadcast([(r.word, r.idx) for r in vocab.select("word", "idx").collect()])

        def kernel(b):
            values, o = flat.lists(flat.column(b, "tokens"))
            listed_ = pa.array([w for w, _ in shared.value], pa.string())
            index = np.append(np.array([i for _, i in shared.value], np.int64), -1)
            at = pc.index_in(values, value_set=listed_).fill_null(-1).to_numpy()
            return pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(index[at]))

        return _rebuilt(slim, kernel, "array<bigint>").withColumnRenamed("tokens", "ids")
    at = tokens(slim).join(vocab, "word", "left").select("doc_id", "sent_id", F.struct("pos", F.coalesce("idx", F.lit(-1).cast("long")).alias("idx")).alias("t"))
    ids = F.transform(F.array_sort(F.collect_list("t")), lambda t: t.idx)
    empty = slim.where(F.size("tokens") == 0).select("doc_id", "sent_id", F.array().cast("array<bigint>").alias("ids"))
    return at.groupBy("doc_id", "sent_id").agg(ids.alias("ids")).unionByName(empty)


def subsampling(counts: DataFrame, threshold: float = 1e-5) -> DataFrame:
    """``(word, p)``: the probability 1 - sqrt(threshold / frequency) with which a word's occurrence is dropped; words of none are left out."""
    total = counts.agg(F.sum("n").alias("_total"))
    p = 1 - F.sqrt(F.lit(threshold) / (F.col("n") / F.col("_total")))
    return counts.crossJoin(F.broadcast(total)).select("word", p.alias("p")).where("p > 0")


def subsample(sentences: DataFrame, probabilities: DataFrame, seed: int = 0) -> DataFrame:
    """Sentences with dropped occurrences as null tokens, so positions stay.

    The draw is a hash of document, sentence, position and seed: it is the
    same however the table is partitioned.
    """
    base = sentences.withColumn("_base", T.draw_base("doc_id", "sent_id", F.lit(seed)))
    few = listed(probabilities, "word")
    if few is not None:
        shared = sentences.sparkSession.sparkContext.broadcast([(r.word, r.p) for r in probabilities.select("word", "p").collect()])

        def kernel(b):
            values, o = flat.lists(flat.column(b, "tokens"))
            p = np.append(np.array([x for _, x in shared.value], float), 0.0)
            at = pc.index_in(values, value_set=pa.array([w for w, _ in shared.value], pa.string())).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(o))
            u = flat.draws(flat.column(b, "_base").to_numpy()[row], np.arange(len(row)) - o[:-1][row]) / flat.PRIME
            gone = u < p[at]
            return pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pc.if_else(pa.array(gone), pa.scalar(None, values.type), values))

        return _rebuilt(base, kernel, "array<string>").select(sentences.columns)
    at = base.select("doc_id", "sent_id", "_base", F.posexplode("tokens").alias("pos", "word")).join(probabilities, "word", "left")
    u = T.draw(F.col("_base"), F.col("pos")) / F.lit(float(flat.PRIME))
    kept = at.select("doc_id", "sent_id", F.struct("pos", F.when(F.col("p").isNull() | (u >= F.col("p")), F.col("word")).alias("word")).alias("t"))
    words = F.transform(F.array_sort(F.collect_list("t")), lambda t: t.word)
    empty = sentences.where(F.size("tokens") == 0).select("doc_id", "sent_id", "tokens")
    return kept.groupBy("doc_id", "sent_id").agg(words.alias("tokens")).unionByName(empty)
