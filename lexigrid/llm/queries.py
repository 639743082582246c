"""The operators applied to their whole tables, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import spread
from . import common, exactdedup, langid, lines, neardup, packing, pii, quality, spm, tokenorc, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_dictionaries(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.copies(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = spm.MODEL) -> DataFrame:
    p = spm.load(model)
    ids = spm.encode(_table(spark, sf_dir, "documents"), p)
    return ids.withColumn("decoded", spm.decode(F.col("ids"), p))


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str, model: str = spm.MODEL) -> DataFrame:
    """The pieces of op3's model read as a Unigram model: for each text the path of the highest sum of scores."""
    return spm.encode(_table(spark, sf_dir, "documents"), spm.unigram(spm.load(model)))


def op4_token_orc(spark: SparkSession, sf_dir: str, ranks_file: str = tokenorc.RANKS) -> DataFrame:
    tokens = tokenorc.tokenize(_table(spark, sf_dir, "documents"), ranks_file=ranks_file)
    path = common.shared_dir(spark, "orc")
    tokenorc.write(tokens, path)
    return tokenorc.read(spark, path, tokens.schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    warc.write_records(warc.from_pages(_table(spark, sf_dir, "pages")), path, gzip=True)
    captures = warc.assemble_files(spark, path)
    # A payload may hold any bytes; what isn't UTF-8 is shown as U+FFFD.
    shown = lambda payload: F.make_valid_utf8(payload.cast("string"))
    first = lambda c: shown(F.get(c, F.lit(0)).payload)
    return captures.select(
        "capture_id",
        "target_uri",
        "date",
        shown(F.col("response.payload")).alias("response"),
        first(F.col("requests")).alias("request"),
        first(F.col("metadata")).alias("metadata"),
        (F.size("requests") + F.size("metadata")).alias("n_linked"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.keep(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", packing.n_words(F.col("text")).alias("n_words"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = lines.clean(pages, lines.html_lines(F.col("html")), lines.url_host(F.col("url")))
    return out.select("page_id", F.array_join("kept", "\n").alias("kept_text"), "n_dropped")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit_on(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_exact_dedup, op3_sentencepiece, sentencepiece_viterbi, op4_token_orc, op5_warc, op6_best_fit_packing, op7_quality_rules, op8_line_dedup, op9_pii, op10_near_dedup)
}

ORACLE = {
    "op2_exact_dedup": """
        SELECT DISTINCT doc_id, kept_id FROM (
          SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents WHERE text IS NOT NULL
        ) WHERE doc_id <> kept_id""",
    "op5_warc": r"""
        SELECT '<urn:page:response:' || page_id || '>' AS capture_id, url AS target_uri, '2024-01-01T00:00:00Z' AS date,
               'HTTP/1.1 200 OK' || e || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || strlen(html) || e || e || html AS response,
               'GET ' || CASE WHEN path = '' THEN '/' ELSE path END || ' HTTP/1.1' || e || 'Host: ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || e || e AS request,
               'page: ' || page_id || e AS metadata, 2::INT AS n_linked
        FROM (SELECT *, chr(13) || chr(10) AS e, regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1) AS path FROM pages)""",
    "op7_quality_rules": quality.ORACLE,
    "op8_line_dedup": lines.ORACLE,
}
