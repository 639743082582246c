"""Saving and loading vocabularies, counts, matrices and vectors.

Tables are Parquet folders with a ``metadata.json`` beside them, written
through Spark so that any file system it knows will do.  Text forms exist for
exchange with other tools.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import NotAllowedValue, ResourceNotFound

HEADER = "_$"


def _write_text(df: DataFrame, path: str, **options: str) -> None:
    w = df.coalesce(1).write.mode("overwrite")
    for k, v in options.items():
        w = w.option(k, v)
    w.text(path)


def save_metadata(spark: SparkSession, path: str, params: dict) -> None:
    _write_text(spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string"), f"{path}/metadata.json")


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata.json").first()[0])


def save_tables(path: str, params: dict | None = None, **tables: DataFrame) -> None:
    """Each table as a Parquet folder under ``path``, and the parameters."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = df.sparkSession
    save_metadata(spark, path, {"params": params or {}, "tables": sorted(tables)})


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables that ``save_tables`` wrote, by name, and the parameters."""
    from pyspark.errors import AnalysisException

    try:
        meta = load_metadata(spark, path)
    except AnalysisException as e:
        raise ResourceNotFound(path) from e
    return {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}, meta["params"]


def save_corpus(path: str, word_counts: DataFrame, n_sentences: int, **params) -> None:
    """A corpus's statistics without its text."""
    save_tables(path, {"n_sentences": n_sentences, **params}, word_counts=word_counts)


def save_representation(path: str, matrix: DataFrame, words: DataFrame, contexts: DataFrame | None = None, **params) -> None:
    """A weighted matrix with both vocabularies, or vectors with theirs."""
    save_tables(path, params, matrix=matrix, words=words, **({} if contexts is None else {"contexts": contexts}))


def load_representation(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame], dict]:
    """``(kind, tables, params)``; the kind is ``counts`` if there is a context vocabulary, else ``vectors``."""
    tables, params = load_tables(spark, path)
    return ("counts" if "contexts" in tables else "vectors"), tables, params


def save_vocabulary(vocab: DataFrame, path: str, **params) -> None:
    """One entry a line in order, below a header line with the parameters; tokens of several fields are joined by ``/``."""
    kind = vocab.schema["word"].dataType
    word = F.concat_ws("/", *[F.col(f"word.{f}") for f in kind.names]) if hasattr(kind, "names") else F.col("word")
    spark = vocab.sparkSession
    fields = {"fields": list(kind.names)} if hasattr(kind, "names") else {}
    head = spark.createDataFrame([(-1, HEADER + json.dumps(params | fields, sort_keys=True))], "idx long, value string")
    rows = head.unionByName(vocab.select("idx", word.alias("value")))
    # A vocabulary is one ordered list, so it is one file, written by one task after a sort over its entries.
    _write_text(rows.repartition(1).sortWithinPartitions("idx").select("value"), path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """``(word, idx)`` in the file's order, and the parameters."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "line"))
    first = lines.where("at = 0").first()
    if first is None:
        raise ResourceNotFound(path)
    params = json.loads(first.line[len(HEADER) :]) if first.line.startswith(HEADER) else {}
    skip = 1 if first.line.startswith(HEADER) else 0
    word = F.col("line")
    if fields := params.get("fields"):
        parts = F.split("line", "/")
        word = F.struct(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)])
    return lines.where(F.col("at") >= skip).select(word.alias("word"), (F.col("at") - skip).cast("long").alias("idx")), params


def save_vectors_text(vectors: DataFrame, path: str, sep: str = "\t", gzip: bool = False) -> None:
    """A word and its components a line, in parts as Spark writes them; bigrams keep their space only if ``sep`` isn't one."""
    if sep in (",", ".", ":"):
        raise NotAllowedValue(f"{sep!r} can't separate numbers")
    line = F.concat_ws(sep, F.col("word").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), sep))
    vectors.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def load_vectors_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(word, vec)``; a line with the number and size of the others, as word2vec writes it first, is skipped.

    A line of two whole numbers is such a head if the second is the size of the
    longest vector; if that is 1, the first must be the number of other lines.
    """
    parts = F.split("value", "\\Q" + sep + "\\E")
    numbers = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != ""), lambda x: x.cast("double"))
    two = F.when(F.col("value").rlike(r"^\d{1,15}\s+\d{1,9}\s*$"), F.split(F.trim("value"), r"\s+"))
    rows = spark.read.text(path).where(F.length("value") > 0).select(parts[0].alias("word"), numbers.alias("vec"), two.alias("two"))
    shape = F.broadcast(rows.agg(F.max(F.size("vec")).alias("dims"), F.count(F.lit(1)).alias("lines")))
    n, d = F.col("two")[0].cast("long"), F.col("two")[1].cast("long")
    head = F.col("two").isNotNull() & (d == F.col("dims")) & ((d > 1) | (n == F.col("lines") - 1))
    return rows.crossJoin(shape).where(~head).select("word", "vec")


def save_sparse_text(cells: DataFrame, words: DataFrame, contexts: DataFrame, path: str, sep: str = "\t") -> None:
    """A header ``(rows, columns), float64``, then a word and its ``index:value`` cells a line."""
    if sep in (",", ".", ":"):
        raise NotAllowedValue(f"{sep!r} can't separate numbers")
    at = cells.join(contexts.select(F.col("word").alias("ctx"), F.col("idx").alias("j")), "ctx").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("r"))
    body = F.array_join(F.transform("r", lambda c: F.concat(c.j.cast("string"), F.lit(":"), c.value.cast("string"))), sep)
    lines = words.join(at, "word", "left").select("idx", F.concat_ws(sep, "word", F.when(F.col("r").isNotNull(), body)).alias("value"))
    head = cells.sparkSession.createDataFrame([(-1, f"({words.count()}, {contexts.count()}), float64")], "idx long, value string")
    _write_text(head.unionByName(lines).repartition(1).sortWithinPartitions("idx").select("value"), path)


def load_sparse_text(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``(word, j, value)``: cells with the number of their column."""
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").rlike(r"^\(\d+, \d+\), "))
    parts = F.split("value", "\\Q" + sep + "\\E")
    cell = F.explode(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.contains(":")))
    at = rows.select(parts[0].alias("word"), cell.alias("c"))
    return at.select("word", F.split("c", ":")[0].cast("int").alias("j"), F.split("c", ":")[1].cast("double").alias("value"))
