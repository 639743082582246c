"""Data preparation and decoding around contextual models: tokenizers, sub-word merging, pairs, chunks, coreference.

The networks themselves aren't part of the library; ``infer`` runs any function
over Arrow batches where a runtime for them is installed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flat
from ..functions import text as T
from ..functions.errors import NotAllowedValue, UnsupportedType
from ..functions.flat import PRIME
from ..plans.store import sized

# Tokenizers


def unicode_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD, which Spark's own functions lack; whole Arrow batches at a time."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise NotAllowedValue(f"unknown normalization {form}")

    @F.arrow_udf("string")
    def normal(a: pa.Array) -> pa.Array:
        # ASCII is its own normal form, so only other texts are touched.
        wide = pc.invert(pc.fill_null(pc.string_is_ascii(a), True))
        return pc.replace_with_mask(a, wide, pa.array([unicodedata.normalize(form, x) for x in a.filter(wide).to_pylist()], a.type))

    return normal(text)


def token_vocabulary(spark: SparkSession, tokens: Iterable[str] | dict[str, int], unknown: str = "[UNK]") -> DataFrame:
    """``(token, id)`` from tokens in order, or from a dict; the unknown token comes last if it is missing."""
    ids = dict(tokens) if isinstance(tokens, dict) else {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    if unknown not in ids:
        ids[unknown] = max(ids.values(), default=-1) + 1
    return spark.createDataFrame(sorted(ids.items(), key=lambda x: x[1]), "token string, id int")


def word_level(texts: DataFrame, vocab: DataFrame, unknown: str = "[UNK]", lower: bool = False, form: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, token, token_id)``: whitespace words by vocabulary; others have the unknown token's id."""
    text = F.col(text_col)
    text = unicode_form(text, form) if form else text
    text = F.lower(text) if lower else text
    at = texts.select(F.col(id_col), F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("pos", "token"))
    row = vocab.where(F.col("token") == unknown).first()
    if row is None:
        raise NotAllowedValue(f"the vocabulary lacks {unknown}")
    known = sized(vocab.select("token", F.col("id").alias("_i")))
    return at.join(known, "token", "left").select(id_col, "pos", "token", F.coalesce("_i", F.lit(row.id)).alias("token_id"))


def subwords(texts: DataFrame, tokenizer: str | bytes, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """``(id, ids, starts, ends)`` by a tokenizer file's content or path (byte-level BPE, BPE, WordPiece, SentencePiece-like, or custom).

    The file's size is the model's, not the data's.  A null text has null lists.
    """
    raw = tokenizer if isinstance(tokenizer, bytes) else open(tokenizer, "rb").read()
    shared = texts.sparkSession.sparkContext.broadcast(raw)
    slim = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(shared.value)
        kind = pa.list_(pa.int32())
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts_ = part.column(1).to_pylist()
                got = t.encode_batch([x or "" for x in texts_], add_special_tokens=special)
                pick = lambda f: pa.array([None if x is None else f(e) for x, e in zip(texts_, got)], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), pick(lambda e: e.ids), pick(lambda e: [o[0] for o in e.offsets]), pick(lambda e: [o[1] for o in e.offsets])], ["id", "ids", "starts", "ends"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def word_index(tokens: DataFrame, key: Sequence[str] = ("sent_id",)) -> DataFrame:
    """``tokens`` (key, pos, start, end, ...) with ``word``: the number of the word that a sub-token is part of.

    A word goes on while a sub-token begins where the one before ended.
    Special tokens (end 0) are left out.
    """
    w = Window.partitionBy(*key).orderBy("pos")
    begins = F.coalesce((F.lag("end").over(w) != F.col("start")).cast("int"), F.lit(1))
    real = tokens.where(F.col("end") > 0).withColumn("_b", begins)
    return real.withColumn("word", (F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_b")


def merge_subwords(tokens: DataFrame, key: Sequence[str] = ("sent_id",)) -> DataFrame:
    """``(key, word, vec)``: each word's vector is the mean of its sub-tokens'; ``tokens`` is ``(key, pos, start, end, vec)``."""
    at = word_index(tokens, key).select(*key, "word", F.posexplode("vec").alias("d", "x"))
    means = at.groupBy(*key, "word", "d").agg(F.avg("x").alias("x"))
    return means.groupBy(*key, "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p.x).alias("vec"))


def padded(words: DataFrame, key: Sequence[str] = ("sent_id",)) -> DataFrame:
    """``(key, vecs)``: a sentence's word vectors in order, filled with zeros up to the longest sentence."""
    longest = F.broadcast(words.agg((F.max("word") + 1).alias("most"), F.max(F.size("vec")).alias("dims")))
    rows = words.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "vec"))), lambda p: p.vec).alias("v"))
    zero = F.array_repeat(F.lit(0.0), F.col("dims"))
    return rows.crossJoin(longest).select(*key, F.concat("v", F.array_repeat(zero, F.col("most") - F.size("v"))).alias("vecs"))


def infer(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A model's outputs: ``run`` gets and gives Arrow batches in the workers, where it loads the model once."""
    return rows.mapInArrow(run, schema)


# Training data


def _uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) that depends on the row's key only, however the table is partitioned."""
    return T.draw_base(*key, F.lit(seed)) / F.lit(float(PRIME))


def mask_tokens(tokens: DataFrame, mask_id: int, vocab_size: int, probability: float = 0.15, seed: int = 0, key: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """``tokens`` (key, token_id) with ``input_id`` and ``label`` for masked language modelling.

    Chosen tokens (``probability``) have their id as label and become the mask
    (80 %), any id (10 %), or stay (10 %); others have the label -100.
    """
    if not 0 <= probability <= 1:
        raise NotAllowedValue(f"not a probability: {probability}")
    chosen, kind, other = _uniform(seed, *key) < probability, _uniform(seed + 1, *key), _uniform(seed + 2, *key)
    shown = F.when(~chosen, F.col("token_id")).when(kind < 0.8, F.lit(mask_id)).when(kind < 0.9, F.floor(other * vocab_size).cast("int")).otherwise(F.col("token_id"))
    return tokens.withColumn("input_id", shown).withColumn("label", F.when(chosen, F.col("token_id")).otherwise(F.lit(-100)))


def lines(docs: DataFrame, skip_blank: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, line_id, line)``: one example a line; numbers count all lines."""
    at = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_id", "line"))
    return at.where(F.col("line").rlike(r"\S")) if skip_blank else at


def next_sentence_pairs(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, part, at, first, second, label)``: neighbouring lines, half of them with a line from elsewhere as second (label 1).

    Blank lines end a document's part; a pair never crosses one.  The other
    line is the second of another pair, found by dealing all pairs into a ring
    by a hash within buckets of about a hundred documents' pairs, so that no
    global order is needed.  A bucket's only pair keeps its own second.
    """
    at = lines(docs, False, id_col, text_col).withColumn("blank", (~F.col("line").rlike(r"\S")).cast("int"))
    w = Window.partitionBy(id_col).orderBy("line_id")
    parts = at.withColumn("part", F.sum("blank").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("blank = 0")
    pw = Window.partitionBy(id_col, "part").orderBy("line_id")
    pairs = parts.select(id_col, F.col("part").cast("int").alias("part"), F.col("line_id").alias("at"), F.trim("line").alias("first"), F.trim(F.lead("line").over(pw)).alias("next")).where(F.col("next").isNotNull())
    h = T.draw_base(id_col, "at", F.lit(seed))
    buckets = max(1, docs.count() // 100)
    dealt = pairs.withColumn("_h", h).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    ring = Window.partitionBy("_bucket").orderBy("_h", id_col, "at")
    other = F.coalesce(F.lead("next").over(ring), F.lag("next").over(ring))
    swap = (_uniform(seed + 1, id_col, "at") < 0.5) & other.isNotNull()
    out = dealt.withColumn("_o", other).withColumn("_s", swap)
    return out.select(id_col, "part", "at", "first", F.when(F.col("_s"), F.col("_o")).otherwise(F.col("next")).alias("second"), F.col("_s").cast("int").alias("label"))


def label_ids(rows: DataFrame, label_col: str = "label", order: Sequence | None = None) -> DataFrame:
    """``rows`` with ``label_id``: the place in ``order``, or among the sorted distinct labels; null for a label that isn't listed."""
    spark = rows.sparkSession
    if order is None:
        order = [r[0] for r in rows.select(label_col).where(F.col(label_col).isNotNull()).distinct().orderBy(label_col).collect()]  # classes, not rows
    kind = rows.schema[label_col].dataType.simpleString()
    table = spark.createDataFrame([(x, i) for i, x in enumerate(order)], f"`{label_col}` {kind}, label_id int")
    return rows.join(sized(table), label_col, "left").select(*rows.columns, "label_id")


def question_context_pairs(questions: list | str, contexts: list | str) -> list[tuple[str, str]]:
    """One question for several contexts, several for one, or as many of both."""
    q, c = ([x] if isinstance(x, str) else list(x) for x in (questions, contexts))
    if len(q) == 1:
        q = q * len(c)
    elif len(c) == 1:
        c = c * len(q)
    if len(q) != len(c):
        raise UnsupportedType("questions and contexts go one to one, or one to all")
    return list(zip(q, c))


def chunks(rows: DataFrame, tokens: str = "tokens", taken: Column | None = None, max_length: int = 384, stride: int = 128, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(keep, chunk, start, tokens)``: windows over a token array that overlap by ``stride``; the last one reaches the end.

    ``taken`` is what of ``max_length`` a question and special tokens use; a
    row that leaves no more than the stride gets no chunk.
    """
    n = F.size(tokens)
    room = F.lit(max_length) - (F.lit(0) if taken is None else taken)
    step = room - stride
    count = F.when(n <= room, F.lit(1)).otherwise(F.ceil((n - room) / step).cast("int") + 1)
    at = rows.select(*keep, F.col(tokens).alias("tokens"), room.alias("_room"), step.alias("_step"), count.alias("_count")).where("_step > 0 and size(tokens) > 0")
    piece = F.transform(F.sequence(F.lit(0), F.col("_count") - 1), lambda i: F.struct(i.alias("chunk"), (i * F.col("_step")).alias("start"), F.slice("tokens", i * F.col("_step") + 1, F.col("_room")).alias("tokens")))
    return at.select(*keep, F.explode(piece).alias("c")).select(*keep, "c.chunk", "c.start", "c.tokens")


def answer_span(chunked: DataFrame, start: str = "answer_start", end: str = "answer_end") -> DataFrame:
    """Chunks with ``span_start`` and ``span_end`` of an answer's tokens (end included) within them; -1 where it isn't all inside."""
    a, b = F.col(start) - F.col("start"), F.col(end) - F.col("start")
    inside = (a >= 0) & (b < F.size("tokens"))
    return chunked.withColumn("span_start", F.when(inside, a).otherwise(-1)).withColumn("span_end", F.when(inside, b).otherwise(-1))


def best_choice(logits: DataFrame, key: Sequence[str] = ("example_id",)) -> DataFrame:
    """``(key, choice, score)``: of ``(key, choice, logit)`` the choice with the highest softmax score; of equal ones the first."""
    top = logits.groupBy(*key).agg(F.max("logit").alias("_m"))
    scored = logits.join(top, list(key)).withColumn("_e", F.exp(F.col("logit") - F.col("_m")))
    return scored.groupBy(*key).agg(F.min_by("choice", F.struct(-F.col("logit"), F.col("choice"))).alias("choice"), (F.max("_e") / F.sum("_e")).alias("score"))


def class_scores(logits: Column) -> Column:
    """Softmax of an array of logits."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def top_tokens(scores: Column, k: int) -> Column:
    """The k best of an array of scores as ``struct<id, score>``, the lowest id first among equals."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("n"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p.id.alias("id"), (-p.n).alias("score")))


def best_answers(logits: DataFrame, widest: int = 30, key: Sequence[str] = ("example_id",)) -> DataFrame:
    """``(key, chunk, start, end, score)``: of ``(key, chunk, start_logits, end_logits)`` the span of at most ``widest`` tokens with the highest sum.

    All chunks of an example compete; equal sums go by chunk, start, end.
    Each start meets the ends within its reach only.
    """
    n = F.size("start_logits")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def best(s: Column) -> Column:
        ends = F.slice("end_logits", s + 1, F.lit(widest))
        top = F.array_max(ends)
        return F.struct((-(F.get("start_logits", s) + top)).alias("loss"), s.alias("start"), (s + F.array_position(ends, top).cast("int") - 1).alias("end"))

    one = logits.select(*key, "chunk", F.array_min(F.transform(places, best)).alias("b")).where("b is not null")
    found = one.groupBy(*key).agg(F.min(F.struct("b.loss", "chunk", "b.start", "b.end")).alias("x"))
    return found.select(*key, "x.chunk", "x.start", "x.end", (-F.col("x.loss")).alias("score"))


def fill_mask(logits: DataFrame, vocab: DataFrame, k: int = 5, key: Sequence[str] = ("example_id",)) -> DataFrame:
    """``(key, rank, token, probability)``: the k likeliest tokens ``(token, id)`` of a masked place, from its array of ``logits``."""
    top = logits.select(*key, F.posexplode(top_tokens(class_scores(F.col("logits")), k)).alias("rank", "t"))
    named = top.select(*key, (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("id"), F.col("t.score").alias("probability"))
    return named.join(sized(vocab), "id").select(*key, "rank", "token", "probability")


# Coreference


def best_antecedents(scores: DataFrame) -> DataFrame:
    """``(doc_id, mention, antecedent)``: of ``(doc_id, mention, antecedent, score)`` the antecedent of the highest score, the nearest among equals; null where no score is above 0, that of having none."""
    best = F.min_by("antecedent", F.struct((-F.col("score")).alias("s"), (-F.col("antecedent")).alias("a")))
    found = scores.groupBy("doc_id", "mention").agg(best.alias("antecedent"), F.max("score").alias("top"))
    return found.select("doc_id", "mention", F.when(F.col("top") > 0, F.col("antecedent")).alias("antecedent"))


def bucket_distance(d: Column) -> Column:
    """0 to 4 as they are, then 5-7, 8-15, 16-31, 32-63, 64 and more as 5 to 9."""
    return F.when(d <= 4, d.cast("int")).otherwise(F.least(F.lit(9), (F.floor(F.log2(d.cast("double"))) + 3).cast("int")))


def spans(sentences: DataFrame, widest: int = 30) -> DataFrame:
    """``(doc_id, sent_id, start, end)``: all spans of up to ``widest`` tokens, ends included, within a sentence; positions from its begin."""
    at = sentences.select("doc_id", "sent_id", F.size("tokens").alias("n")).where("n > 0")
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    return at.select("doc_id", "sent_id", "start", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + widest, F.col("n")) - 1)).alias("end"))


def best_spans(scored: DataFrame, share: float = 0.4) -> DataFrame:
    """Of ``(doc_id, n_words, start, end, score)`` the ``share`` times words best spans of each document; equal scores go by place."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.floor(F.lit(share) * F.col("n_words"))).drop("_r")


def best_spans_by_place(sizes: DataFrame, widest: int, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], share: float = 0.4) -> DataFrame:
    """``(doc_id, starts, ends)``: ``best_spans`` of the spans of up to ``widest`` words, scored by document, start and end; one row a document that has any, spans by rank.

    ``sizes`` is ``(doc_id, n)``, the words of each sentence; several of one
    document compete, each up to its own share.  Spans are made, ranked and
    dropped within a task, so what is shuffled is one number a sentence.
    """
    kind = sizes.schema["doc_id"].dataType.simpleString()
    docs = sizes.groupBy("doc_id").agg(F.collect_list(F.col("n").cast("int")).alias("ns"))

    def run(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            # A slice holds flat.TOKENS // 4 words at most, or one longer document.
            values, at = flat.lists(flat.column(whole, "ns"))
            done = np.concatenate([[0], np.cumsum(values.to_numpy().astype(np.int64))])[at]
            cuts = [0]
            while cuts[-1] < whole.num_rows:
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(done, done[cuts[-1]] + flat.TOKENS // 4, "right")) - 1))
            for a, b in zip(cuts, cuts[1:]):
                yield from _ranked_spans(whole.slice(a, b - a), widest, score, share)

    return docs.mapInArrow(run, f"doc_id {kind}, starts array<int>, ends array<int>")


def _ranked_spans(batch: pa.RecordBatch, widest: int, score: Callable, share: float):
    ids = flat.column(batch, "doc_id")
    values, o = flat.lists(flat.column(batch, "ns"))
    n = values.to_numpy().astype(np.int64)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    reach = np.minimum(widest, n[word] - place)
    sentence, start = np.repeat(word, reach), np.repeat(place, reach)
    end = start + np.arange(len(start)) - np.repeat(np.cumsum(reach) - reach, reach)
    doc = np.repeat(np.arange(len(ids)), np.diff(o))[sentence]
    if len(n) > len(ids):  # spans come by place, but for those of several sentences
        by_place = np.lexsort((end, start, doc))
        sentence, start, end, doc = sentence[by_place], start[by_place], end[by_place], doc[by_place]
    # Without an id there is no score.
    points = np.where(ids.is_null().to_numpy(zero_copy_only=False)[doc], 0, score(ids.fill_null(0).to_numpy()[doc], start, end))
    order = np.lexsort((-points, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc, doc)  # documents stay in their order
    order = order[rank < np.floor(share * n[sentence[order]])]
    offsets = np.searchsorted(doc[order], np.arange(len(ids) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order].astype(np.int32))) for x in (start, end)]
    some = pa.array(np.diff(offsets) > 0)
    yield pa.RecordBatch.from_arrays([x.filter(some) for x in (ids, *lists)], ["doc_id", "starts", "ends"])


def merge_mentions(links: list[tuple[int, int]]) -> list[list[int]]:
    """Clusters from (mention, antecedent) pairs in order: a pair joins the first cluster with either of them; clusters are never joined."""
    clusters: list[set[int]] = []
    for pair in links:
        for c in clusters:
            if c.intersection(pair):
                c.update(pair)
                break
        else:
            clusters.append(set(pair))
    return [sorted(c) for c in clusters]


def coreference_clusters(links: DataFrame) -> DataFrame:
    """``(doc_id, cluster, mentions)`` from ``(doc_id, mention, antecedent)``; a null antecedent links nothing.

    The order of mentions matters, so a document is folded in one task.
    """
    kind = links.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        pairs = sorted(zip(t.column("mention").to_pylist(), t.column("antecedent").to_pylist()))
        found = merge_mentions(pairs)
        return pa.table({"doc_id": pa.array([t.column("doc_id")[0].as_py()] * len(found), t.schema.field("doc_id").type), "cluster": pa.array(range(len(found)), pa.int32()), "mentions": pa.array(found, pa.list_(pa.int32()))})

    at = links.where("antecedent is not null").select("doc_id", F.col("mention").cast("int").alias("mention"), F.col("antecedent").cast("int").alias("antecedent"))
    return at.groupBy("doc_id").applyInArrow(run, f"doc_id {kind}, cluster int, mentions array<int>")


def segments(sentences: list[tuple[list[int], list[bool], list[list[int]]]], max_length: int, first: int, last: int) -> dict[str, list]:
    """One document's segments of at most ``max_length`` sub-tokens, ``first`` and ``last`` around each.

    A sentence is its sub-tokens' ids, whether each begins a word, and the
    clusters of each.  Segments take whole sentences while they fit; a longer
    sentence is cut before a word.  Gold spans are runs of neighbours of one
    cluster, at places counted over all segments.
    """
    room = max_length - 2
    parts: list[list[tuple[int, int, list[int]]]] = []
    now: list[tuple[int, int, list[int]]] = []
    for j, (ids, begins, clusters) in enumerate(sentences):
        rest = [(x, j, c) for x, c in zip(ids, clusters)]
        starts = list(begins)
        if len(now) + len(rest) <= room:
            now += rest
            continue
        if now:
            parts.append(now)
        while len(rest) > room:
            cut = room
            while cut > 0 and not starts[cut]:
                cut -= 1
            cut = cut or room  # one word longer than a segment has to be cut
            parts.append(rest[:cut])
            rest, starts = rest[cut:], starts[cut:]
        now = rest
    parts.append(now)
    out: dict[str, list] = {"segments": [], "sentence_map": [], "starts": [], "ends": [], "clusters": []}
    gold, offset = [], 0
    for p in parts:
        out["segments"].append([first, *(x for x, _, _ in p), last])
        where = [j for _, j, _ in p] or [0]
        out["sentence_map"] += [where[0], *(j for _, j, _ in p), where[-1]]
        seen: dict[int, list[int]] = {}
        for k, (_, _, cs) in enumerate(p):
            for c in cs:
                seen.setdefault(c, []).append(k + 1)
        for c, at in seen.items():
            i = 0
            while i < len(at):
                e = i
                while e + 1 < len(at) and at[e + 1] == at[e] + 1:
                    e += 1
                gold.append((at[i] + offset, at[e] + offset, c))
                i = e + 1
        offset += len(p) + 2
    gold.sort(key=lambda g: g[0])
    out["starts"], out["ends"], out["clusters"] = ([g[i] for g in gold] for i in range(3))
    return out


def coreference_segments(docs: DataFrame, max_length: int = 256, first: int = 101, last: int = 102) -> DataFrame:
    """``segments`` of each row ``(doc_id, sentences)``, ``sentences`` being ``array<struct<ids:array<int>, begins:array<boolean>, clusters:array<array<int>>>>``."""
    if max_length < 3:
        raise NotAllowedValue("a segment holds at least one sub-token between its ends")
    slim = docs.select("doc_id", "sentences")

    def run(batches):
        for b in batches:
            got = [segments([(s["ids"], s["begins"], s["clusters"]) for s in x], max_length, first, last) for x in b.column(1).to_pylist()]
            ints = pa.list_(pa.int32())
            pick = lambda k, t=ints: pa.array([g[k] for g in got], t)
            yield pa.RecordBatch.from_arrays([b.column(0), pick("segments", pa.list_(ints)), pick("sentence_map"), pick("starts"), pick("ends"), pick("clusters")], ["doc_id", "segments", "sentence_map", "starts", "ends", "clusters"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, segments array<array<int>>, sentence_map array<int>, starts array<int>, ends array<int>, clusters array<int>")


def antecedents(spans_: DataFrame, most: int = 50) -> DataFrame:
    """``(doc_id, mention, antecedent, bucket)``: each span (numbered by place in its document) with up to ``most`` before it, the nearest first."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    at = spans_.withColumn("mention", (F.row_number().over(w) - 1).cast("int")).select("doc_id", "mention").where("mention > 0")
    pairs = at.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("mention") - most), F.col("mention") - 1)).alias("antecedent"))
    return pairs.select("doc_id", "mention", "antecedent", bucket_distance(F.col("mention") - F.col("antecedent")).alias("bucket"))


def antecedent_buckets(mentions: DataFrame, most: int = 50) -> DataFrame:
    """``(bucket, n)``: the pairs of ``antecedents`` by bucket, from the number of mentions ``(doc_id, n)`` of each document.

    n mentions make n - d pairs at each distance d, so pairs are never made.
    """
    sizes = mentions.groupBy(F.col("n").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs")).where("n > 1")
    at = sizes.select("n", "docs", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.col("n") - 1))).alias("d"))
    return at.groupBy(bucket_distance(F.col("d")).alias("bucket")).agg(F.sum(F.col("docs") * (F.col("n") - F.col("d"))).alias("n"))
