"""Text and token normalization, as Column expressions.

Raw lines are normalized in the order punctuation, digits, case.  Tokens of
annotated corpora are structs with at least ``form``, ``lemma`` and ``POS``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flat import PRIME

PUNCTUATION = string.punctuation
#: A digit and all digits, commas and dots behind it; possessive, so that no text is too long for it.
NUMBER = r"(?U)\d++[\d,.]*+"


def drop_punctuation(line: Column) -> Column:
    """Delete every ASCII punctuation character; what it separated is joined."""
    return F.translate(line, PUNCTUATION, "")


def digits(line: Column) -> Column:
    """Every number, also inside a word, becomes ``0``."""
    return F.regexp_replace(line, NUMBER, "0")


def normalize(line: Column, lower: bool = False, digit: bool = False, ignore_punctuation: bool = False) -> Column:
    """A raw line after the chosen steps."""
    if ignore_punctuation:
        line = drop_punctuation(line)
    if digit:
        line = digits(line)
    return F.lower(line) if lower else line


def split_words(line: Column, unicode_spaces: bool = True) -> Column:
    """The words of a line: what whitespace separates, without empty ones; of a null line an empty array."""
    return F.filter(F.split(F.coalesce(line, F.lit("")), r"(?U)\s+" if unicode_spaces else r"\s+"), lambda x: x != "")


def lower_tokens(tokens: Column, lemma: bool = False) -> Column:
    """Lower-cased forms, of CoNLL tokens (``lemma``) also lemmas."""

    def one(t: Column) -> Column:
        t = t.withField("form", F.lower(t.form))
        return t.withField("lemma", F.lower(t.lemma)) if lemma else t

    return F.transform(tokens, one)


def digit_tokens(tokens: Column) -> Column:
    """A token tagged ``NUM`` whose form begins with a number gets form and lemma ``0``."""
    hit = lambda t: (t.POS == "NUM") & t.form.rlike(r"(?U)^\d")
    return F.transform(tokens, lambda t: F.when(hit(t), t.withField("form", F.lit("0")).withField("lemma", F.lit("0"))).otherwise(t))


def drop_punctuation_tokens(tokens: Column) -> Column:
    """Tokens without those whose lemma is a part of the punctuation string; an empty lemma is one."""
    return F.filter(tokens, lambda t: F.instr(F.lit(PUNCTUATION), t.lemma) == 0)


def project(tokens: Column, entity: str | tuple[str, ...] | None) -> Column:
    """Tokens reduced to one attribute (a string), to several (a struct), or kept."""
    if entity is None:
        return tokens
    if isinstance(entity, str):
        return F.transform(tokens, lambda t: t[entity])
    return F.transform(tokens, lambda t: F.struct(*[t[a].alias(a) for a in entity]))


def draw_base(*key: Column | str) -> Column:
    """A number from 0 to ``flat.PRIME`` - 1 by the values of a key, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])), 1, 8), 16, 10).cast("long") % F.lit(PRIME)


def draw(base: Column, place: Column) -> Column:
    """``flat.draws`` as a Column: a number from 0 to ``PRIME`` - 1 by a row's base and a place in it."""
    x = (base + place.cast("long") * F.lit(1000003)) % F.lit(PRIME)
    x = (x * x + F.lit(12345)) % F.lit(PRIME)
    x = (x * x + base) % F.lit(PRIME)
    return x * F.lit(48271) % F.lit(PRIME)
