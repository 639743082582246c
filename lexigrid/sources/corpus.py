"""Corpora as DataFrames of sentences: ``(doc_id, sent_id, tokens)``.

Readers give one row for each sentence.  Sentences of a file are numbered in
the file's order; ``doc_id`` is the file's path, or the key of a table's row.
Files may be gzip; folders are read with all below them, but for names that
begin with a dot.  Text files are read in splits, line by line: no task holds
a whole file.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.errors import UnsupportedType
from ..plans.store import materialize, sized

CONLL = ("id", "form", "lemma", "POS", "NER", "head", "dependency_relation")
CONLLU = ("id", "form", "lemma", "POS", "xpostag", "feats", "head", "dependency_relation", "deps", "misc")
BROWN = ("form", "lemma", "POS")
XML = ("id", "form", "lemma", "POS", "features", "head", "dependency_relation")

Reader = Callable[[SparkSession, str], DataFrame]


#: What a piece of a split is: what comes before its first blank line, all of a split without one, what comes after its last, and a whole sentence.
HEAD, THROUGH, TAIL, WHOLE = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, at, value)``: the lines of each split of a file in order; ``at`` is the split's first byte."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").option("lineSep", "\n")
    return r.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("at"), "value")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, sent_id, line)``: the lines of files, numbered from 0.  They are written once, as later reads might split the files in another way."""
    held = materialize(_lines(spark, path).withColumn("_row", F.monotonically_increasing_id()), "lines")
    sizes = held.groupBy("doc_id", "at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("at")) - F.col("_n")
    base = sized(sizes.select("doc_id", "at", (before - F.col("_first")).alias("_base")), 256)
    return held.join(base, ["doc_id", "at"]).select("doc_id", (F.col("_row") + F.col("_base")).cast("int").alias("sent_id"), F.col("value").alias("line"))


def _numbered(docs: DataFrame, lines: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(lines).alias("sent_id", "line"))


def from_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), unicode_spaces: bool = True, **normalize: bool) -> DataFrame:
    """Sentences of a table of texts: every line is one, blank ones have no tokens."""
    lines = F.split(T.normalize(F.col(text_col), **normalize), "\n")
    at = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(lines).alias("sent_id", "line"))
    return at.select("doc_id", *keep, "sent_id", T.split_words(F.col("line"), unicode_spaces).alias("tokens"))


def read_text(spark: SparkSession, path: str, **normalize: bool) -> DataFrame:
    """Raw text files, one sentence a line."""
    return _numbered_lines(spark, path).select("doc_id", "sent_id", T.split_words(T.normalize(F.col("line"), **normalize)).alias("tokens"))


def from_iterable(spark: SparkSession, sentences: Iterable, lower: bool = False, digit: bool = False, ignore_punctuation: bool = False) -> DataFrame:
    """Sentences given as strings or as lists of words; words that normalization empties are dropped."""
    rows = list(sentences)
    if all(isinstance(s, str) for s in rows):
        df = spark.createDataFrame(list(enumerate(rows)), "sent_id int, line string")
        words = T.split_words(T.normalize(F.col("line"), lower, digit, ignore_punctuation))
    elif all(isinstance(s, (list, tuple)) for s in rows):
        df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(rows)], "sent_id int, line array<string>")
        words = F.filter(F.transform("line", lambda x: T.normalize(x, lower, digit, ignore_punctuation)), lambda x: x != "")
    else:
        raise UnsupportedType("sentences are strings or lists of words")
    return df.select(F.lit(0).alias("doc_id"), "sent_id", words.alias("tokens"))


def annotated(sentences: DataFrame, lower: bool = False, digit: bool = False, ignore_punctuation: bool = False, lower_lemma: bool = False) -> DataFrame:
    """Annotated sentences after the chosen steps."""
    tokens = F.col("tokens")
    if ignore_punctuation:
        tokens = T.drop_punctuation_tokens(tokens)
    if digit:
        tokens = T.digit_tokens(tokens)
    if lower:
        tokens = T.lower_tokens(tokens, lower_lemma)
    return sentences.withColumn("tokens", tokens)


def brown_tokens(line: Column) -> Column:
    """Structs of ``form/POS/lemma`` words."""

    def one(t: Column) -> Column:
        p = F.split(t, "/")
        return F.struct(F.get(p, F.lit(0)).alias("form"), F.get(p, F.lit(2)).alias("lemma"), F.get(p, F.lit(1)).alias("POS"))

    return F.transform(T.split_words(line), one)


def read_brown(spark: SparkSession, path: str, **steps: bool) -> DataFrame:
    return annotated(_numbered_lines(spark, path).select("doc_id", "sent_id", brown_tokens(F.col("line")).alias("tokens")), **steps)


def _conll_tokens(lines: Column, fields: tuple[str, ...]) -> Column:
    """Structs of a sentence's token lines; each line is split once."""
    parts = F.transform(F.filter(lines, _is_token), lambda x: F.split(x, "\t"))
    return F.transform(parts, lambda p: F.struct(*[F.get(p, F.lit(i)).alias(name) for i, name in enumerate(fields)]))


def _is_token(line: Column) -> Column:
    """Neither a comment nor a line whose id is a range or a decimal."""
    return line.rlike(r"^[^#\s]") & ~line.rlike(r"^[^\t]*[-.]")


def conll_sentences(docs: DataFrame, text_col: str = "value", fields: tuple[str, ...] = CONLL) -> DataFrame:
    """Sentences of texts in a tab-separated format with one token a line.

    Blank lines and the text's end close a sentence; comment lines and ids
    that are ranges or decimals are skipped; missing fields are null.
    """
    blocks = F.filter(F.split(F.col(text_col), r"\n[ \t\r]*(?:\n[ \t\r]*)*\n|\A\s*\n"), lambda b: b.rlike(r"(?m)^[^#\s]"))
    lines = F.split(F.regexp_replace("line", r"\r\z", ""), r"\r?\n")
    return _numbered(docs, blocks).where(F.exists(lines, _is_token)).select("doc_id", "sent_id", _conll_tokens(lines, fields).alias("tokens"))


def _pieces(batches):
    """Splits' lines cut at blank ones: rows ``(doc_id, at, kind, part, n, counts, lines)``.

    Whole sentences that count have their number within the split as ``part``;
    a split's other pieces come when it ends in ``HEAD`` and ``TAIL``, the
    latter with the number of whole sentences before it, or in ``THROUGH``.
    Only the sentence at hand is held.
    """
    names = ["doc_id", "at", "kind", "part", "n", "counts", "lines"]
    key, parts, lines, ok = None, 0, [], False
    headed = False

    def made(kind, part, n, counts, lists):
        size = len(lists)
        whole = lambda x, t: pa.array(np.broadcast_to(x, size), t)
        cols = [pa.array([key[0]] * size, pa.string()), whole(key[1], pa.int64()), whole(kind, pa.int32()), whole(part, pa.int64()), whole(n, pa.int64()), whole(counts, pa.bool_()), lists]
        return pa.RecordBatch.from_arrays(cols, names)

    def one(kind, n=0):
        text = pa.concat_arrays(lines) if lines else pa.array([], pa.string())
        return made(kind, 0, n, ok, pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text))

    for b in batches:
        docs, ats = b.column(0).dictionary_encode(), b.column(1).to_numpy()
        code = docs.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(ats) != 0)) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, b.num_rows)):
            if i == j:
                continue
            own = (docs.dictionary[int(code[i])].as_py(), int(ats[i]))
            if own != key:
                if key is not None:
                    yield one(TAIL if headed else THROUGH, parts)
                key, parts, lines, ok, headed = own, 0, [], False, False
            v = b.column(2).slice(i, j - i)
            counts = pc.match_substring_regex(v, r"^[^#\s]").to_numpy(zero_copy_only=False)
            blank = np.flatnonzero(pc.match_substring_regex(v, r"^[ \t\r]*$").to_numpy(zero_copy_only=False))
            if not len(blank):
                lines.append(v)
                ok |= bool(counts.any())
                continue
            first, last = int(blank[0]), int(blank[-1])
            lines.append(v.slice(0, first))
            ok |= bool(counts[:first].any())
            if not headed:
                yield one(HEAD)
                headed = True
            elif ok:
                text = pa.concat_arrays(lines)
                yield made(WHOLE, parts, 0, True, pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text))
                parts += 1
            # Between blank lines: a sentence wherever a line counts.
            done = np.append(0, np.cumsum(counts))
            some = np.flatnonzero(done[blank[1:]] > done[blank[:-1]])
            if len(some):
                inner = np.ones(len(v), bool)
                inner[blank] = False
                keep = np.append(0, np.cumsum(inner))
                start, end = keep[blank[some]], keep[blank[some + 1]]
                take = np.zeros(len(v) + 1, np.int64)
                np.add.at(take, blank[some], 1)
                np.add.at(take, blank[some + 1], -1)
                text = v.filter(pa.array((np.cumsum(take)[:-1] > 0) & inner))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(end - start)).astype(np.int32)), text)
                yield made(WHOLE, parts + np.arange(len(some)), 0, True, lists)
                parts += len(some)
            lines, ok = [v.slice(last + 1)], bool(counts[last + 1 :].any())
    if key is not None:
        yield one(TAIL if headed else THROUGH, parts)


def _read_conll(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """``conll_sentences`` of files.

    Splits are cut to sentences in their own tasks and written once; what a
    split begins and ends with is joined with its neighbours' pieces, and only
    these and the splits' numbers of sentences are shuffled.
    """
    kind = "doc_id string, at long, kind int, part long, n long, counts boolean, lines array<string>"
    held = materialize(_lines(spark, path).mapInArrow(_pieces, kind), "pieces")
    order = Window.partitionBy("doc_id").orderBy("at", "kind")
    ends = held.where(F.col("kind") != WHOLE).withColumn("g", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    # A tail begins a sentence; the heads of the splits behind it, and splits without a blank line, go on with it.
    joined = ends.groupBy("doc_id", "g").agg(
        F.max(F.when(F.col("kind") == TAIL, F.col("at"))).alias("at"),
        F.sum("n").alias("n"),
        F.max(F.col("counts").cast("int")).alias("one"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind", "lines"))), lambda x: x.lines)).alias("lines"),
    )
    units = Window.partitionBy("doc_id").orderBy("g")
    joined = materialize(joined.withColumn("before", F.sum(F.col("n") + F.col("one")).over(units) - F.col("n") - F.col("one")), "ends")
    base = sized(joined.where("at is not null and n > 0").select("doc_id", "at", "before"), 256)
    whole = held.where(F.col("kind") == WHOLE).join(base, ["doc_id", "at"]).select("doc_id", (F.col("before") + F.col("part")).alias("sent_id"), "lines")
    rows = whole.unionByName(joined.where("one = 1").select("doc_id", (F.col("before") + F.col("n")).alias("sent_id"), "lines"))
    lines = F.transform("lines", lambda x: F.regexp_replace(x, r"\r\z", ""))
    return rows.where(F.exists("lines", _is_token)).select("doc_id", F.col("sent_id").cast("int").alias("sent_id"), _conll_tokens(lines, fields).alias("tokens"))


def read_conll(spark: SparkSession, path: str, **steps: bool) -> DataFrame:
    """CoNLL files of seven columns; lower-casing takes lemmas too."""
    return annotated(_read_conll(spark, path, CONLL), lower_lemma=True, **steps)


def read_conllu(spark: SparkSession, path: str, **steps: bool) -> DataFrame:
    return annotated(_read_conll(spark, path, CONLLU), **steps)


_XML_ROW = "tokens array<struct<id:string,form:string,lemma:string,POS:string,features:string,head:string,dependency_relation:string>>"


def read_xml(spark: SparkSession, path: str, **steps: bool) -> DataFrame:
    """XML files with ``sentence`` elements of ``token``s and basic dependencies; a token without a governor has ``_``.

    Spark's XML source splits files at sentences.  Sentences of a file are
    numbered in the order of its tasks' rows.
    """
    schema = (
        "_id string, tokens struct<token: array<struct<_id: string, word: string, lemma: string, POS: string>>>, "
        "dependencies array<struct<_type: string, dep: array<struct<_type: string, governor: struct<_VALUE: string, _idx: string>, dependent: struct<_VALUE: string, _idx: string>>>>>"
    )
    raw = spark.read.format("xml").option("rowTag", "sentence").option("rootTag", "sentences").schema(schema).load(path)
    return annotated(_xml(raw.withColumn("doc_id", F.input_file_name()).withColumn("sent_id", F.coalesce(F.col("_id").cast("long"), F.monotonically_increasing_id()))), **steps)


def _xml(raw: DataFrame) -> DataFrame:
    basic = F.flatten(F.transform(F.filter(F.coalesce("dependencies", F.array().cast(raw.schema["dependencies"].dataType)), lambda d: d["_type"] == "basic-dependencies"), lambda d: d.dep))

    def one(t: Column) -> Column:
        dep = F.get(F.filter(basic, lambda d: d.dependent["_idx"] == t["_id"]), F.lit(0))
        blank = lambda c: F.coalesce(c, F.lit("_"))
        return F.struct(
            t["_id"].alias("id"), t.word.alias("form"), blank(t.lemma).alias("lemma"), blank(t.POS).alias("POS"), F.lit("_").alias("features"), blank(dep.governor["_idx"]).alias("head"), blank(dep["_type"]).alias("dependency_relation")
        )

    return raw.select("doc_id", "sent_id", F.transform("tokens.token", one).alias("tokens"))


def from_xml_string(spark: SparkSession, xml: str, **steps: bool) -> DataFrame:
    """Sentences of one XML document given as a string."""
    rows = []
    for k, s in enumerate(ET.fromstring(xml).iter("sentence")):
        deps = {d.find("dependent").get("idx"): (d.find("governor").get("idx"), d.get("type")) for g in s.iter("dependencies") if g.get("type") == "basic-dependencies" for d in g.iter("dep")}
        get = lambda t, n: t.findtext(n) or "_"
        rows.append((0, k, [(t.get("id"), t.findtext("word"), get(t, "lemma"), get(t, "POS"), "_", *deps.get(t.get("id"), ("_", "_"))) for t in s.iter("token")]))
    return annotated(spark.createDataFrame(rows, f"doc_id int, sent_id int, {_XML_ROW}"), **steps)


def read(spark: SparkSession, path: str, reader: Reader = read_text, **steps) -> DataFrame:
    """Sentences by any reader: a callable ``(spark, path, ...)`` that returns ``(doc_id, sent_id, tokens)``."""
    out = reader(spark, path, **steps)
    if not {"doc_id", "sent_id", "tokens"} <= set(out.columns):
        raise UnsupportedType("a reader returns the columns doc_id, sent_id and tokens")
    return out


def peek(sentences: DataFrame, n: int = 5) -> DataFrame:
    """The first n sentences."""
    return sentences.orderBy("doc_id", "sent_id").limit(n)
