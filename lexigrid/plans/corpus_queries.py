"""Queries over the documents table as a corpus, and equivalent SQL.

Each runs over the whole table.  Vocabularies of the most frequent words are
the feature of the queries that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as X
from ..operators import contextual as B
from ..operators import counts as K
from ..operators import matrix as M
from ..operators import weighting as W
from ..operators.cooccurrence import count_cooccurrence, merge
from ..sources import corpus as S
from .store import materialize, spread

VOCABULARY = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sentences(spark: SparkSession, sf_dir: str, **normalize: bool) -> DataFrame:
    return S.from_table(table(spark, sf_dir, "documents"), keep=("lang",), unicode_spaces=False, **({"lower": True} | normalize))


def top_words(corpus: DataFrame, k: int = VOCABULARY) -> DataFrame:
    return materialize(K.create_vocabulary(K.count_words(corpus), filters=[K.truncate(k)]), "vocabulary")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def cells(spark: SparkSession, sf_dir: str, context=None, v: DataFrame | None = None) -> DataFrame:
    """Counts of a window of 2 over the most frequent words (``v`` if they are at hand), written once: weightings read them several times."""
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus) if v is None else v
    return materialize(count_cooccurrence(corpus, v, context or X.Window(2), v), "cells")


TOKENS = r"""
lines AS (SELECT doc_id, lang, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) - 1 AS sent_id FROM documents WHERE text IS NOT NULL),
sents AS (SELECT doc_id, lang, sent_id, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS tokens FROM lines),
tok AS (SELECT doc_id, lang, sent_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS pos FROM sents),
counts AS (SELECT word, count(*) AS n FROM tok GROUP BY word)"""
VOCAB = f"{TOKENS}, vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM counts ORDER BY n DESC, word LIMIT {VOCABULARY})"
PAIRS = "a.doc_id = b.doc_id AND a.sent_id = b.sent_id"
CELLS = f"""{VOCAB}, cells AS (
  SELECT a.word, b.word AS ctx, count(*) AS n FROM tok a JOIN tok b ON {PAIRS} AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos
  WHERE a.word IN (SELECT word FROM vocab) AND b.word IN (SELECT word FROM vocab) GROUP BY ALL)"""

#: With ``base`` and ``pos`` in scope, ``text.draw`` as the column ``draw``.
DRAW = "(base + pos * 1000003) % 2147483647 AS x0, (x0 * x0 + 12345) % 2147483647 AS x1, (x1 * x1 + base) % 2147483647 AS x2, x2 * 48271 % 2147483647 AS draw"


def base_sql(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(key)})), 1, 8))::BIGINT % 2147483647"


QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Counts and vocabularies


@query(f"WITH {TOKENS} SELECT word, n FROM counts")
def word_counts(spark, sf_dir):
    return K.count_words(sentences(spark, sf_dir))


@query(f'WITH {TOKENS} SELECT a.word AS "first", b.word AS "second", count(*) AS n FROM tok a JOIN tok b ON {PAIRS} AND b.pos = a.pos + 1 GROUP BY ALL')
def bigram_counts(spark, sf_dir):
    return K.count_bigrams(sentences(spark, sf_dir))


@query(f"WITH {TOKENS} SELECT s.lang, n_sentences, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_words, 0) AS n_words FROM (SELECT lang, count(*) AS n_sentences FROM sents GROUP BY lang) s LEFT JOIN (SELECT lang, count(*) AS n_tokens, count(DISTINCT word) AS n_words FROM tok GROUP BY lang) t USING (lang)")
def corpus_stats_by_lang(spark, sf_dir):
    return K.describe(sentences(spark, sf_dir), "lang")


@query(f"WITH {VOCAB} SELECT word, idx FROM vocab")
def vocab_truncate(spark, sf_dir):
    return K.create_vocabulary(K.count_words(sentences(spark, sf_dir)), filters=[K.truncate(VOCABULARY)])


@query(f"WITH {TOKENS} SELECT word, n FROM counts WHERE n / (SELECT sum(n) FROM counts) >= 1e-4")
def vocab_least_frequent(spark, sf_dir):
    return K.remove_least_frequent(1e-4)(K.count_words(sentences(spark, sf_dir)))


@query(f"WITH {TOKENS}, low AS (SELECT * FROM counts WHERE n >= 3) SELECT word, n FROM low WHERE n / (SELECT sum(n) FROM low) <= 1e-3")
def vocab_most_frequent(spark, sf_dir):
    # The share is of what the filter before left.
    return K.remove_most_frequent(1e-3)(K.remove_least_frequent(3)(K.count_words(sentences(spark, sf_dir))))


@query(f"WITH {TOKENS} SELECT word, n FROM counts WHERE word NOT IN ('the', 'le', 'and', 'de') AND instr('laleles', word) = 0")
def vocab_remove_elements(spark, sf_dir):
    return K.remove_elements("laleles")(K.remove_elements(["the", "le", "and", "de"])(K.count_words(sentences(spark, sf_dir))))


def _languages(corpus: DataFrame) -> list[str]:
    return sorted(r[0] for r in corpus.select("lang").where("lang is not null").distinct().collect())


@query(
    f"""WITH {TOKENS}, v AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS idx FROM (SELECT lang, word, count(*) AS n FROM tok WHERE lang IS NOT NULL GROUP BY ALL)),
    first AS (SELECT word, min((lang, idx)) AS place FROM v GROUP BY word) SELECT word, row_number() OVER (ORDER BY place) - 1 AS idx FROM first"""
)
def vocab_merge(spark, sf_dir):
    """The vocabularies of all languages, in the order of their names."""
    corpus = sentences(spark, sf_dir)
    return K.merge_vocabularies(*[K.create_vocabulary(K.count_words(corpus.where(F.col("lang") == x))) for x in _languages(corpus)])


@query(
    r"""WITH n AS (SELECT lower(regexp_replace(translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\d+((,\d*)*(\.\d*)*)*', '0', 'g')) AS t FROM documents WHERE text IS NOT NULL)
    SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS word FROM n) GROUP BY word"""
)
def normalized_counts(spark, sf_dir):
    return K.count_words(sentences(spark, sf_dir, digit=True, ignore_punctuation=True))


@query(f"WITH {VOCAB} SELECT t.doc_id, sum(coalesce(idx, -1) * (pos + 1))::BIGINT AS checksum, count(*) FILTER (idx IS NULL) AS n_unknown FROM tok t LEFT JOIN vocab USING (word) GROUP BY t.doc_id")
def encode_sentences(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    ids = K.encode(corpus, top_words(corpus)).select("doc_id", F.posexplode("ids").alias("pos", "idx"))
    return ids.groupBy("doc_id").agg(F.sum(F.col("idx") * (F.col("pos") + 1)).alias("checksum"), F.sum((F.col("idx") < 0).cast("long")).alias("n_unknown"))


@query(f"WITH {TOKENS} SELECT word, round(1 - sqrt(1e-3 / (n / (SELECT sum(n) FROM counts))), 6) AS p FROM counts WHERE 1 - sqrt(1e-3 / (n / (SELECT sum(n) FROM counts))) > 0")
def subsampler_probabilities(spark, sf_dir):
    return rounded(K.subsampling(K.count_words(sentences(spark, sf_dir)), 1e-3), "p")


@query(f"""WITH {TOKENS}, p AS (SELECT word, 1 - sqrt(1e-3 / (n / (SELECT sum(n) FROM counts))) AS p FROM counts),
k AS (SELECT word, {base_sql('doc_id', 'sent_id', '1')} AS base, {DRAW} FROM tok) SELECT word, count(*) AS n FROM k JOIN p USING (word) WHERE draw / 2147483647 >= p GROUP BY word""")
def subsampled_counts(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    kept = K.subsample(corpus, materialize(K.subsampling(K.count_words(corpus), 1e-3), "subsampling"), seed=1)
    return K.count_words(kept.withColumn("tokens", F.array_compact("tokens")))


@query(f"""WITH {TOKENS}, two AS (SELECT a.doc_id, a.sent_id, a.pos FROM tok a JOIN tok b ON {PAIRS} AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the')
SELECT count(*) AS n FROM two""")
def merged_bigrams(spark, sf_dir):
    listed = spark.createDataFrame([("of the",)], "word string")
    merged = K.merge_bigrams(sentences(spark, sf_dir), listed).select(F.explode("tokens").alias("word"))
    return merged.where("word = 'of the'").agg(F.count(F.lit(1)).alias("n"))


# Annotated corpora given inline

BROWN = "You/PRON/you can/MD/can count/VB/count 1,500/NUM/1500 stars/NNS/star ././.\nStars/NNS/star count/VB/count"


@query("SELECT * FROM (VALUES ('you', 'you', 'PRON', 1), ('can', 'can', 'MD', 1), ('count', 'count', 'VB', 2), ('0', '0', 'NUM', 1), ('stars', 'star', 'NNS', 2)) t(form, lemma, pos, n)")
def brown_counts(spark, sf_dir):
    docs = spark.createDataFrame([(0, BROWN)], "doc_id int, value string")
    raw = docs.select("doc_id", F.posexplode(F.split("value", "\n")).alias("sent_id", "line")).select("doc_id", "sent_id", S.brown_tokens(F.col("line")).alias("tokens"))
    got = K.count_words(S.annotated(raw, lower=True, digit=True, ignore_punctuation=True))
    return got.select("word.form", "word.lemma", F.col("word.POS").alias("pos"), "n")


CONLLU = "# one\n1\tAda\tada\tPROPN\t_\t_\t2\tnsubj\t_\t_\n2\treads\tread\tVERB\t_\t_\t0\troot\t_\t_\n3\told\told\tADJ\t_\t_\t4\tamod\t_\t_\n4\tbooks\tbook\tNOUN\t_\t_\t2\tobj\t_\t_\n5\tin\tin\tADP\t_\t_\t6\tcase\t_\t_\n6\tParis\tparis\tPROPN\t_\t_\t2\tobl\t_\t_\n"


@query(
    """WITH t(id, form, head, rel) AS (VALUES (1, 'Ada', 2, 'nsubj'), (2, 'reads', 0, 'root'), (3, 'old', 4, 'amod'), (4, 'books', 2, 'obj'), (5, 'in', 6, 'case'), (6, 'Paris', 2, 'obl')),
    e AS (SELECT h.form AS word, c.form || '/' || c.rel AS ctx FROM t c JOIN t h ON c.head = h.id UNION ALL SELECT c.form, h.form || '/' || c.rel || '-' FROM t c JOIN t h ON c.head = h.id)
    SELECT word, ctx, count(*) AS n FROM e GROUP BY ALL"""
)
def dependency_contexts(spark, sf_dir):
    docs = spark.createDataFrame([(0, CONLLU)], "doc_id int, value string")
    rows = X.Dependency(labels=True)(S.conll_sentences(docs, fields=S.CONLLU))
    return rows.groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))


# Co-occurrence


@query(f"WITH {CELLS} SELECT word, ctx, n FROM cells")
def cooc_window2(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Window(2), v)


@query(f"WITH {VOCAB} SELECT a.word, b.word AS ctx, count(*) AS n FROM tok a JOIN tok b ON {PAIRS} AND b.pos BETWEEN a.pos - 1 AND a.pos + 3 AND a.pos <> b.pos WHERE a.word IN (SELECT word FROM vocab) GROUP BY ALL")
def cooc_asymmetric_discovered(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    return count_cooccurrence(corpus, top_words(corpus), X.Window((1, 3)))


@query(f"""WITH {VOCAB}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS r FROM tok WHERE word IN (SELECT word FROM vocab))
SELECT a.word, b.word AS ctx, count(*) AS n FROM k a JOIN k b ON {PAIRS} AND b.r BETWEEN a.r - 2 AND a.r + 2 AND a.r <> b.r GROUP BY ALL""")
def cooc_dirty(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Window(2, dirty=True), v)


@query(f"""WITH {VOCAB}, k AS (SELECT doc_id, sent_id, word, count(*) AS n FROM tok WHERE word IN (SELECT word FROM vocab) GROUP BY ALL)
SELECT a.word, b.word AS ctx, sum(a.n * (b.n - CASE WHEN a.word = b.word THEN 1 ELSE 0 END))::BIGINT AS n FROM k a JOIN k b ON {PAIRS} GROUP BY ALL HAVING sum(a.n * (b.n - CASE WHEN a.word = b.word THEN 1 ELSE 0 END)) > 0""")
def cooc_sentence(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Sentence(), v)


@query(f"WITH {VOCAB} SELECT a.word, b.word AS ctx, (b.pos - a.pos)::INT AS dist, count(*) AS n FROM tok a JOIN tok b ON {PAIRS} AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos WHERE a.word IN (SELECT word FROM vocab) AND b.word IN (SELECT word FROM vocab) GROUP BY ALL")
def cooc_distance(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Window(2, distance=True), v)


@query(f"""WITH {VOCAB}, g AS (SELECT a.doc_id, a.sent_id, a.pos, a.word || ' ' || b.word AS ctx FROM tok a JOIN tok b ON {PAIRS} AND b.pos = a.pos + 1 WHERE a.word IN (SELECT word FROM vocab) AND b.word IN (SELECT word FROM vocab))
SELECT a.word, b.ctx, count(*) AS n FROM tok a JOIN g b ON {PAIRS} AND (b.pos BETWEEN a.pos - 3 AND a.pos - 2 OR b.pos BETWEEN a.pos + 1 AND a.pos + 2) WHERE a.word IN (SELECT word FROM vocab) GROUP BY ALL""")
def cooc_ngram(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Window(3, n_grams=2), v)


@query(f"""WITH {VOCAB}, k AS (SELECT *, {base_sql('doc_id', 'sent_id', '1', '0')} AS base, {DRAW} FROM tok WHERE word IN (SELECT word FROM vocab))
SELECT a.word, b.word AS ctx, count(*) AS n FROM k a JOIN tok b ON {PAIRS} AND b.pos BETWEEN a.pos - (1 + a.draw % 4) AND a.pos + 1 + a.draw % 4 AND a.pos <> b.pos WHERE b.word IN (SELECT word FROM vocab) GROUP BY ALL""")
def cooc_dynamic(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v = top_words(corpus)
    return count_cooccurrence(corpus, v, X.Window(4, dynamic=True, seed=1), v)


@query(f"""WITH {VOCAB} SELECT a.lang || '_' || a.word AS word, b.word AS ctx, count(*) AS n FROM tok a JOIN tok b ON {PAIRS} AND abs(b.pos - a.pos) = 1
WHERE a.lang IS NOT NULL AND a.word IN (SELECT word FROM vocab) AND b.word IN (SELECT word FROM vocab) GROUP BY ALL""")
def cooc_merge_langs(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    v, langs = top_words(corpus), _languages(corpus)
    parts = [count_cooccurrence(corpus.where(F.col("lang") == x), v, X.Window(1), v) for x in langs]
    return merge(*parts, word_keys=langs)


# Weightings

SUMS = "r AS (SELECT word, sum(n) AS row FROM cells GROUP BY word), c AS (SELECT ctx, sum(n) AS col FROM cells GROUP BY ctx), total AS (SELECT sum(n) AS total FROM cells)"
PMI = f"WITH {CELLS}, {SUMS}, pmi AS (SELECT word, ctx, ln((n / row) / (col / total)) AS value FROM cells JOIN r USING (word) JOIN c USING (ctx), total)"
SMOOTH = f"WITH {CELLS}, {SUMS}, s AS (SELECT ctx, pow(col, 0.75) AS col FROM c), ratio AS (SELECT word, ctx, (n / row) / (s.col / (SELECT sum(col) FROM s)) AS value FROM cells JOIN r USING (word) JOIN s USING (ctx))"


@query(f"WITH {CELLS}, {SUMS} SELECT word, ctx, round(n / total, 9) AS value FROM cells, total")
def w_joint(spark, sf_dir):
    return rounded(W.joint(cells(spark, sf_dir)), "value", digits=9)


@query(f"WITH {CELLS}, {SUMS} SELECT word, ctx, round(n / row, 6) AS value FROM cells JOIN r USING (word)")
def w_conditional(spark, sf_dir):
    return rounded(W.conditional(cells(spark, sf_dir)), "value")


@query(f"{SMOOTH} SELECT word, ctx, round(value, 6) AS value FROM ratio")
def w_ratio_smoothed(spark, sf_dir):
    return rounded(W.ratio(cells(spark, sf_dir), 0.75), "value")


@query(f"{PMI} SELECT word, ctx, round(value, 6) + 0.0 AS value FROM pmi")
def w_pmi(spark, sf_dir):
    return rounded(W.pmi(cells(spark, sf_dir)), "value")


@query(f"{PMI} SELECT word, ctx, round(value, 6) AS value FROM pmi WHERE value > 1e-9")
def w_ppmi(spark, sf_dir):
    return rounded(W.ppmi(cells(spark, sf_dir)).where("value > 1e-9"), "value")


@query(f"{SMOOTH} SELECT word, ctx, round(ln(value) - ln(2), 6) AS value FROM ratio WHERE ln(value) - ln(2) > 1e-9")
def w_sppmi(spark, sf_dir):
    return rounded(W.shifted_ppmi(cells(spark, sf_dir), 0.75, 2.0).where("value > 1e-9"), "value")


@query(f"WITH {CELLS}, r AS (SELECT word, sum(n) AS row, count(*) AS nnz FROM cells GROUP BY word) SELECT word, ctx, round(n / row * ln({VOCABULARY} / nnz), 6) + 0.0 AS value FROM cells JOIN r USING (word)")
def w_tfidf(spark, sf_dir):
    return rounded(W.tfidf(cells(spark, sf_dir), VOCABULARY), "value")


@query(f"WITH {CELLS}, r AS (SELECT word, sqrt(sum(n * n)) AS size FROM cells GROUP BY word) SELECT word, ctx, round(n / size, 6) AS value FROM cells JOIN r USING (word)")
def normalize_l2(spark, sf_dir):
    return rounded(M.normalize(W.create_representation(cells(spark, sf_dir)), "l2"), "value")


@query(f"WITH {CELLS}, c AS (SELECT ctx, max(n) AS size FROM cells GROUP BY ctx) SELECT word, ctx, round(n / size, 6) AS value FROM cells JOIN c USING (ctx)")
def normalize_max_columns(spark, sf_dir):
    return rounded(M.normalize(W.create_representation(cells(spark, sf_dir)), "max", "ctx"), "value")


@query()
def svd_ppmi(spark, sf_dir):
    return M.svd(materialize(W.ppmi(cells(spark, sf_dir)), "ppmi"), 50, 0.5)


# Data preparation for contextual models


@query(f"WITH {VOCAB} SELECT t.doc_id, t.sent_id, t.pos::INT AS pos, t.word AS token, coalesce(idx, {VOCABULARY})::INT AS token_id FROM tok t LEFT JOIN vocab USING (word)")
def word_level_tokens(spark, sf_dir):
    corpus = sentences(spark, sf_dir)
    vocab = top_words(corpus).select(F.col("word").alias("token"), F.col("idx").cast("int").alias("id"))
    vocab = materialize(vocab.unionByName(spark.createDataFrame([("[UNK]", VOCABULARY)], "token string, id int")), "tokens")
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    both = line.select(F.struct("doc_id", "sent_id").alias("key"), "line")
    return B.word_level(both, vocab, lower=True, id_col="key", text_col="line").select("key.doc_id", "key.sent_id", "pos", "token", "token_id")


@query(
    r"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM conversations),
    w AS (SELECT *, sum(CASE WHEN ch IN (' ', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS gap FROM c),
    g AS (SELECT conv_id, turn, gap, avg(unicode(ch)) AS m, count(*) AS size FROM w WHERE ch NOT IN (' ', chr(10)) GROUP BY ALL)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY gap) - 1)::INT AS word, round(m, 6) AS mean_code, size AS mean_size FROM g"""
)
def merge_subwords(spark, sf_dir):
    """Characters as sub-tokens, with their code and their word's length as vectors."""
    turns = table(spark, sf_dir, "conversations")
    at = turns.select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch not in ('', ' ', '\n')")
    tokens = at.select("conv_id", "turn", F.col("i").alias("pos"), F.col("i").alias("start"), (F.col("i") + 1).alias("end"), F.array(F.ascii("ch").cast("double"), F.lit(1.0)).alias("vec"))
    merged = B.merge_subwords(tokens, ("conv_id", "turn"))
    size = B.word_index(tokens, ("conv_id", "turn")).groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("mean_size"))
    return merged.join(size, ["conv_id", "turn", "word"]).select("conv_id", "turn", "word", F.round(F.col("vec")[0], 6).alias("mean_code"), "mean_size")


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, sent_id, len(tokens) AS n FROM sents)
SELECT CASE WHEN n <= 4 THEN n WHEN n < 8 THEN 5 WHEN n < 16 THEN 6 WHEN n < 32 THEN 7 WHEN n < 64 THEN 8 ELSE 9 END AS bucket, count(*) AS n FROM n GROUP BY 1""")
def bucket_distance(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy(B.bucket_distance(F.size("tokens")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOKENS}, n AS (SELECT doc_id, sent_id, len(tokens) AS n FROM sents WHERE len(tokens) > 0)
SELECT doc_id, sum(n * least(n, 30) - least(n, 30) * (least(n, 30) - 1) / 2)::BIGINT AS n_spans FROM n GROUP BY doc_id""")
def span_counts(spark, sf_dir):
    return B.spans(sentences(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"))


@query(
    r"""WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (CASE WHEN n <= 381 THEN 1 ELSE ceil((n - 381) / 253)::INT + 1 END)::BIGINT AS n_chunks, (CASE WHEN n <= 381 THEN 0 ELSE ceil((n - 381) / 253)::INT * 253 END)::INT AS last_start FROM d WHERE n > 0"""
)
def question_chunks(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.split_words(F.col("text"), False).alias("tokens"))
    return B.chunks(words, taken=F.lit(3)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("start").alias("last_start"))


@query(
    """WITH r AS (SELECT e.user_id, e.event_id AS choice, e.value AS logit FROM events e), m AS (SELECT user_id, max(logit) AS m FROM r GROUP BY user_id)
    SELECT user_id, min(choice) FILTER (logit = m) AS choice, round(1 / sum(exp(logit - m)), 6) AS score FROM r JOIN m USING (user_id) GROUP BY user_id"""
)
def multiple_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("choice"), F.col("value").alias("logit"))
    return rounded(B.best_choice(rows, ("user_id",)), "score")


@query("SELECT doc_id, label_id::INT AS label_id FROM documents JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents)) USING (lang)")
def label_ids(spark, sf_dir):
    return B.label_ids(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "label_id")


@query(r"SELECT doc_id, line_id::INT AS line_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_id FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '\S')")
def line_examples(spark, sf_dir):
    return B.lines(table(spark, sf_dir, "documents"))


@query(f"WITH {TOKENS} SELECT word, n FROM counts")
def streamed_word_counts(spark, sf_dir):
    """The documents as a stream; the last complete result is what a batch gives."""
    import os

    from ..streaming import counts as C
    from .store import shared_dir

    docs = table(spark, sf_dir, "documents")
    path = f"{sf_dir}/documents.parquet"
    folder, name = (path, "*.parquet") if os.path.isdir(path) else (sf_dir, "documents.parquet")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", name).parquet(folder)
    out = shared_dir(spark, "streamed")
    # Each complete result replaces the one before; the schema is fixed, so an empty stream gives an empty table.
    result = C.word_counts(stream.select("doc_id", "text"), lower=True, unicode_spaces=False)
    spark.createDataFrame([], result.schema).write.parquet(out)
    C.drain(result, lambda df, _: df.write.mode("overwrite").parquet(out), "complete")
    return spark.read.schema(result.schema).parquet(out)


@query("""SELECT start, start + INTERVAL 1 HOUR AS "end", word, n FROM (SELECT date_trunc('hour', ts) AS start, event_type AS word, count(*) AS n FROM events GROUP BY ALL)""")
def windowed_event_counts(spark, sf_dir):
    from ..streaming import counts as C

    return C.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
