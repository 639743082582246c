"""Co-occurrence counts as sparse cells ``(word, ctx, n)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flat
from ..functions.errors import IncompatibleValue, RequiredValue
from . import counts as K
from .context import Context, Sentence, Window


def count_cooccurrence(
    sentences: DataFrame,
    words: DataFrame,
    context: Context | DataFrame | None = None,
    contexts: DataFrame | None = None,
    subsampling: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """How often each context occurs with each word of the vocabulary.

    ``context``: a definition, or a vocabulary of context words for a window of
    1; without one, a window of 1.  ``contexts``: the context vocabulary;
    without one every context found is counted.  Bigrams of the vocabularies
    are merged in the sentences first.
    """
    if words is None:
        raise RequiredValue("a vocabulary of words is required")
    if isinstance(context, DataFrame):
        context, contexts = None, context
    context = context or Window()
    plain = sentences.schema["tokens"].dataType.elementType.simpleString() == "string"
    if plain:
        both = [K.bigrams_of(v).select("word") for v in (words, contexts) if v is not None]
        sentences = K.merge_bigrams(sentences, both[0] if len(both) == 1 else both[0].union(both[1]).distinct())
        if subsampling is not None:
            sentences = K.subsample(sentences, K.subsampling(K.count_words(sentences), subsampling), seed)
    if isinstance(context, Sentence):
        return _within_sentences(sentences, words, contexts)
    if isinstance(context, Window):
        return context.counted(sentences, words, contexts)
    rows = context(sentences, words, contexts)
    item = ["ctx", "dist"] if "dist" in rows.columns else ["ctx"]
    return rows.groupBy("word", *item).agg(F.count(F.lit(1)).alias("n"))


def _within_sentences(sentences: DataFrame, words: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """Sentence contexts from each sentence's word counts: a word x times and another y times make x y pairs, a word with itself x (x - 1).

    Pairs of places are never made, and pairs of words are added up in the
    sentences' tasks before the shuffle, some millions at a time.
    """
    rows, parts = Window(0)._rows(sentences, words, contexts)
    fixed = parts.fixed

    def run(batches):
        held = flat.Held(["word", "ctx"])
        total = None
        for b in flat.slices(flat.gathered(batches, "w"), "w"):
            o, target, names, ctx, named, _ = parts(b)
            # one dictionary for both, as a word isn't its own context
            code, all_ = flat.codes(pa.concat_arrays([names, named]))
            target = np.append(code[: len(names)], -1)[target]
            ctx = np.append(code[len(names) :], -1)[ctx]
            width = max(1, len(all_))
            if fixed and width * width <= flat.CELLS:
                # Words have the same codes in all batches: cells are added up as they are.
                total = (np.zeros(width * width, np.int64), all_, all_) if total is None else total
                for _ in flat.sentence_pairs(target, ctx, o, width, total=total[0]):
                    pass
                continue
            for kinds, n in flat.sentence_pairs(target, ctx, o, width):
                yield from held.add([all_.take(pa.array(kinds // width)), all_.take(pa.array(kinds % width))], n)
        if total is not None:
            yield from flat.cells(*total)
        yield from held.rest()

    return rows.mapInArrow(run, "word string, ctx string, n long").groupBy("word", "ctx").agg(F.sum("n").alias("n"))


def merge(*cells: DataFrame, word_keys: Sequence[str] | None = None, context_keys: Sequence[str] | None = None, concat: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The sum of several counts, over all their words and contexts.

    Keys, one for each count, keep equal words of different sources apart:
    ``key_word`` by default, on both parts of a bigram.
    """
    for keys in (word_keys, context_keys):
        if keys is not None and len(keys) != len(cells):
            raise IncompatibleValue("one key for each count")
    concat = concat or (lambda key, w: F.concat(key, F.lit("_"), w))

    def named(col: Column, key: str | None) -> Column:
        if key is None:
            return col
        return F.array_join(F.transform(F.split(col, " "), lambda p: concat(F.lit(key), p)), " ")

    rows = None
    for i, c in enumerate(cells):
        part = c.select(named(F.col("word"), word_keys and word_keys[i]).alias("word"), named(F.col("ctx"), context_keys and context_keys[i]).alias("ctx"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("word", "ctx").agg(F.sum("n").alias("n"))
