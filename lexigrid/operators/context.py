"""Context definitions: from sentences to ``(doc_id, sent_id, pos, word, ctx[, dist])`` rows.

Contexts of a token are built from its own sentence's array, so a context
definition shuffles nothing.  Windows are numpy passes over whole Arrow batches
of sentences (``functions.flat``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flat
from ..functions import text as T
from ..functions.errors import NotAllowedValue
from ..plans.store import listed, sized
from . import counts as K

Context = Callable[[DataFrame], DataFrame]


def _targets(rows: DataFrame, words: DataFrame | None) -> DataFrame:
    """Only rows whose word is a target; the vocabulary is counted and broadcast if it is small."""
    return rows if words is None else rows.join(_one(words, "word"), "word", "left_semi")


def _one(vocab: DataFrame, name: str) -> DataFrame:
    return sized(vocab.select(F.col("word").alias(name)))


def _contexts(rows: DataFrame, vocab: DataFrame | None) -> DataFrame:
    return rows if vocab is None else rows.join(_one(vocab, "ctx"), "ctx", "left_semi")


@dataclass(frozen=True)
class Window:
    """Tokens at most ``size`` places away, on both sides or (before, after).

    ``dirty``: words out of the vocabulary don't use up the window.
    ``dynamic``: each target draws its size from 1 to ``size`` (0 stays 0);
    equal sides share a draw, a hash of the token's place.  ``n_grams``: contexts are runs of n tokens that
    lie on one side, all of them in the vocabulary.  ``distance``: rows have
    the signed distance ``dist`` to the context's nearest token on the left
    and to its first on the right.
    """

    size: int | tuple[int, int] = 1
    dirty: bool = False
    dynamic: bool = False
    n_grams: int = 1
    distance: bool = False
    seed: int = 0

    def __post_init__(self):
        if min(self.sides) < 0 or self.n_grams < 1:
            raise NotAllowedValue("window sizes aren't negative and n-grams have at least one token")

    @property
    def sides(self) -> tuple[int, int]:
        return (self.size, self.size) if isinstance(self.size, int) else tuple(self.size)

    def _rows(self, sentences: DataFrame, words: DataFrame | None, vocab: DataFrame | None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Callable]:
        """Sentences as ``w``, tokens as targets (and ``c``, as contexts, where these differ), and a function from a batch of these to ``flat.around``'s parts.

        Vocabularies of a checked size are looked up in the workers; for
        others tokens are joined with them and gathered to sentences again.
        """
        targets, contexts = (None if v is None else listed(v, "word") for v in (words, vocab))
        wide = (words is not None and targets is None) or (vocab is not None and contexts is None)
        if wide:
            sentences = marked(sentences, words, vocab)
        else:
            sentences = sentences.withColumn("w", F.col("tokens"))
        bases = [T.draw_base("doc_id", "sent_id", F.lit(self.seed), F.lit(k)).alias(f"base{k}") for k in (0, 1)] if self.dynamic else []
        shared = sentences.sparkSession.sparkContext.broadcast(None if wide else (targets, contexts))
        sides, n, dirty, dynamic = self.sides, self.n_grams, self.dirty and vocab is not None, self.dynamic
        one_draw = sides[0] == sides[1]

        def parts(batch):
            listed_ = shared.value or (None, None)
            values, o = flat.lists(flat.column(batch, "w"))
            code, names = flat.codes(values)
            if wide:
                context, others = flat.codes(flat.lists(flat.column(batch, "c"))[0])
            else:
                (context, others), (code, names) = (flat.placed(code, names, None if x is None else pa.array(x, pa.string())) for x in (listed_[1], listed_[0]))
            reach = None
            if dynamic:
                base = [flat.column(batch, f"base{k}").to_numpy() for k in (0, 1)]

                def reach(place, row):
                    size = lambda k, b: 1 + flat.draws(b[row], place) % k if k else np.zeros(len(row), np.int64)
                    return size(sides[0], base[0]), size(sides[1], base[0 if one_draw else 1])

            items, found = flat.around(code, context, o, sides, n, dirty, reach)
            gram, named = flat.grams(context[items], others, n)
            return o, code, names, gram, named, found

        #: Whether codes are places in the two vocabularies, the same for all batches.
        parts.fixed = targets is not None and contexts is not None and n == 1
        #: The targets, if codes are places in them and contexts are whatever is found.
        parts.targets = targets if vocab is None and not wide else None
        return sentences.select(*keep, "w", *(["c"] if wide else []), *bases), parts

    def __call__(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        rows, parts = self._rows(sentences, words, vocab, ("doc_id", "sent_id"))
        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "sent_id")]

        def run(batches):
            for b in flat.slices(batches, "w"):
                o, code, names, gram, named, found = parts(b)
                for t, k, dist in found:
                    ok = gram[k] >= 0
                    t, k, dist = t[ok], k[ok], dist[ok]
                    row = pa.array(np.searchsorted(o, t, "right") - 1)
                    keys = [flat.column(b, c).take(row) for c in ("doc_id", "sent_id")]
                    pos = pa.array((t - o[row.to_numpy()]).astype(np.int32))
                    cols = [*keys, pos, names.take(pa.array(code[t])), named.take(pa.array(gram[k])), pa.array(dist.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sent_id", "pos", "word", "ctx", "dist"])

        out = rows.mapInArrow(run, f"{', '.join(kinds)}, pos int, word string, ctx string, dist int")
        return out if self.distance else out.drop("dist")

    def counted(self, sentences: DataFrame, words: DataFrame | None, vocab: DataFrame | None) -> DataFrame:
        """``(word, ctx[, dist], n)``: pairs are counted in the sentences' tasks first, so what is shuffled are partial counts."""
        rows, parts = self._rows(sentences, words, vocab)
        far, fixed = self.distance, parts.fixed
        if parts.targets is not None and not far:
            return self._discovered(rows, parts)

        def run(batches):
            total = None
            for b in flat.slices(batches, "w"):
                _, code, names, gram, named, found = parts(b)
                width, keys, size = max(1, len(named)), [], 0
                cells = len(names) * width
                if fixed and not far and cells <= flat.CELLS:
                    # Cells are added up as they are.
                    total = (np.zeros(cells, np.int64), names, named) if total is None else total
                    for t, k, _ in found:
                        ok = gram[k] >= 0
                        flat.add(total[0], code[t[ok]] * width + gram[k[ok]])
                    continue
                for t, k, dist in found:
                    ok = gram[k] >= 0
                    key = code[t[ok]] * width + gram[k[ok]]
                    if far:
                        yield from _distances(key, dist[ok], width, names, named)
                        continue
                    keys.append(key)
                    size += len(key)
                    if size > flat.PAIRS:
                        yield _tallied(keys, width, names, named)
                        keys, size = [], 0
                if keys:
                    yield _tallied(keys, width, names, named)
            if total is not None:
                yield from flat.cells(*total)

        out = rows.mapInArrow(run, f"word string, ctx string, {'dist int, ' if far else ''}n long")
        return out.groupBy("word", "ctx", *(["dist"] if far else [])).agg(F.sum("n").alias("n"))


    def _discovered(self, rows: DataFrame, parts: Callable) -> DataFrame:
        """``(word, ctx, n)`` of all contexts found with listed targets.

        What is shuffled and sorted is one row a context of some hundred thousand tokens, with its targets' places and counts, not one
        for each pair; rows of a context meet in a task and are added up there as they come by.
        """
        spark = rows.sparkSession
        names = spark.sparkContext.broadcast(parts.targets)

        def run(batches):
            for b in flat.slices(flat.gathered(batches, "w", flat.TOKENS), "w"):
                _, code, listed_, gram, named, found = parts(b)
                width, keys, size = max(1, len(listed_)), [], 0
                for t, k, _ in found:
                    ok = gram[k] >= 0
                    keys.append(gram[k[ok]] * width + code[t[ok]])
                    size += len(keys[-1])
                    if size > flat.PAIRS:
                        yield flat.nested(keys, width, named)
                        keys, size = [], 0
                if size:
                    yield flat.nested(keys, width, named)

        def total(batches):
            yield from flat.unnested(batches, pa.array(names.value, pa.string()))

        found = rows.mapInArrow(run, "ctx string, pairs binary")
        # A number of partitions that is given isn't changed at run time: all rows of a context stay in one.
        met = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ctx").sortWithinPartitions("ctx")
        return met.mapInArrow(total, "word string, ctx string, n long")


def _tallied(keys: list[np.ndarray], width: int, names: pa.Array, named: pa.Array) -> pa.RecordBatch:
    kinds, n = flat.tally(keys)
    return pa.RecordBatch.from_arrays([names.take(pa.array(kinds // width)), named.take(pa.array(kinds % width)), pa.array(n)], ["word", "ctx", "n"])


def _distances(key: np.ndarray, dist: np.ndarray, width: int, names: pa.Array, named: pa.Array):
    """Counts by pair and distance of one part."""
    if not len(key):
        return
    pair, at = np.unique(key, return_inverse=True)
    low, span = int(dist.min()), int(dist.max() - dist.min()) + 1
    kinds, n = np.unique(at * span + (dist - low), return_counts=True)
    both = pair[kinds // span]
    cols = [names.take(pa.array(both // width)), named.take(pa.array(both % width)), pa.array((kinds % span + low).astype(np.int32)), pa.array(n)]
    yield pa.RecordBatch.from_arrays(cols, ["word", "ctx", "dist", "n"])


def marked(sentences: DataFrame, words: DataFrame | None, vocab: DataFrame | None) -> DataFrame:
    """Sentences with ``w`` and ``c``: their tokens, null where they aren't in a vocabulary too large to be sent to every worker."""
    # Numbered before the tokens are exploded: an expression beside an explosion is evaluated for each of its rows.
    keyed = sentences.select("doc_id", "sent_id", "tokens", F.monotonically_increasing_id().alias("row"))
    at = keyed.select("row", "doc_id", "sent_id", F.posexplode_outer("tokens").alias("pos", "word"))
    for name, v in (("w", words), ("c", vocab)):
        at = at.withColumn(name, F.col("word")) if v is None else at.join(v.select("word", F.col("word").alias(name)), "word", "left")
    rows = at.groupBy("row", "doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "w", "c")))).alias("r"))
    return rows.select("doc_id", "sent_id", F.transform("r", lambda x: x.w).alias("w"), F.transform("r", lambda x: x.c).alias("c"))


@dataclass(frozen=True)
class Sentence:
    """All other tokens of the sentence, by place: a word that occurs again is its own context."""

    def __call__(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        at = _targets(K.tokens(sentences), words).where("word is not null")
        # Both sides are narrow; a sentence's pairs are joined where its tokens meet, so no row holds a sentence.
        other = _contexts(K.tokens(sentences).select("doc_id", "sent_id", F.col("pos").alias("at"), F.col("word").alias("ctx")).where("ctx is not null"), vocab)
        return at.join(other, ["doc_id", "sent_id"]).where("pos <> at").select("doc_id", "sent_id", "pos", "word", "ctx")


ALL = "all"


@dataclass(frozen=True)
class Dependency:
    """Words linked by dependency relations; each distinct context of a token counts once.

    Tokens are structs with id, form, head, dependency_relation.  ``entity``:
    the attribute that words and contexts are.  ``collapse``: prepositions
    become part of the relation.  ``labels``: contexts are ``word/relation``,
    with a ``-`` behind the relation if the context is the head.  ``depth``: 2
    adds the dependents of dependents, and each further step the reach of the
    step before.  ``directed``: no heads.  ``deprel_keep``: only these
    relations; ``pos_keep``: only contexts with these tags.
    """

    entity: str = "form"
    dependencies: str = "universal-dependencies"
    collapse: bool = False
    labels: bool = False
    depth: int = 1
    directed: bool = False
    deprel_keep: str | Iterable[str] = ALL
    pos_keep: str | Iterable[str] = ALL
    parser: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if self.depth < 1:
            raise NotAllowedValue("the depth is at least 1")
        if self.parser is None and self.dependencies not in ("universal-dependencies", "stanford-dependencies"):
            raise NotAllowedValue(f"no parser for {self.dependencies}")

    def _rows(self, sentences: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Callable, str]:
        """Sentences' attributes as lists of their own, a function from a batch of these to ``_tree``'s parts, and the type of words."""
        kind = next(f for f in sentences.schema["tokens"].dataType.elementType if f.name == self.entity).dataType.simpleString()
        text = lambda c: T.project(F.col("tokens"), c).cast("array<string>").alias(c)
        names = {"id", "head", "dependency_relation"} | ({"form"} if self.collapse else set()) | ({"POS"} if self.pos_keep != ALL else set())
        rows = sentences.select(*keep, T.project(F.col("tokens"), self.entity).alias("_name"), *[text(c) for c in sorted(names)])
        chosen = lambda x: None if x == ALL else [x] if isinstance(x, str) else list(x)
        relations, tags = chosen(self.deprel_keep), chosen(self.pos_keep)

        def parts(batch):
            return _tree(self, {c: flat.column(batch, c) for c in ("_name", *sorted(names))}, relations, tags)

        return rows, parts, kind

    def __call__(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        if self.parser:
            return self._joined(sentences, words, vocab)
        rows, parts, kind = self._rows(sentences, ("doc_id", "sent_id"))
        ids = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "sent_id")]

        def run(batches):
            for b in flat.slices(batches, "_name"):
                row, pos, word, names, ctx, named = parts(b)
                keys = [flat.column(b, c).take(pa.array(row)) for c in ("doc_id", "sent_id")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(pos.astype(np.int32)), flat.taken(names, word), flat.taken(named, ctx)], ["doc_id", "sent_id", "pos", "word", "ctx"])

        out = rows.mapInArrow(run, f"{', '.join(ids)}, pos int, word {kind}, ctx {'string' if self.labels else kind}")
        return _contexts(_targets(out, words), vocab)

    def counted(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        """``(word, ctx, n)``, counted in the sentences' tasks first."""
        if self.parser:
            return self._joined(sentences, words, vocab).groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))
        rows, parts, kind = self._rows(sentences)

        def run(batches):
            for b in flat.slices(batches, "_name"):
                _, _, word, names, ctx, named = parts(b)
                width = len(named) + 1
                kinds, n = np.unique((word + 1) * width + ctx + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([flat.taken(names, kinds // width - 1), flat.taken(named, kinds % width - 1), pa.array(n)], ["word", "ctx", "n"])

        out = rows.mapInArrow(run, f"word {kind}, ctx {'string' if self.labels else kind}, n long")
        return _contexts(_targets(out, words), vocab).groupBy("word", "ctx").agg(F.sum("n").alias("n"))

    def _joined(self, sentences: DataFrame, words: DataFrame | None, vocab: DataFrame | None) -> DataFrame:
        """Contexts by joins of tokens with the edges that a parser gives as a table."""
        key = ["doc_id", "sent_id"]
        at = sentences.select(*key, F.posexplode("tokens").alias("pos", "t"))
        down = self.parser(at)
        if self.deprel_keep != ALL:
            down = down.where(F.col("rel").isin([self.deprel_keep] if isinstance(self.deprel_keep, str) else list(self.deprel_keep)))
        both = down if self.directed else down.unionByName(down.select(*key, F.col("child").alias("head"), F.col("head").alias("child"), F.concat("rel", F.lit("-")).alias("rel")))
        tree = both
        for _ in range(self.depth - 1):
            a, b = tree.alias("a"), tree.alias("b")
            far = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.child") == F.col("b.head")]).where("a.head <> b.child")
            grown = far.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.head").alias("head"), F.col("b.child").alias("child"), F.concat_ws("_", "a.rel", "b.rel").alias("rel"))
            tree = tree.unionByName(grown).distinct()
        name = F.col(f"t.{self.entity}")
        head = at.select(*key, F.col("t.id").alias("head"), "pos", name.alias("word"))
        ctx = name if not self.labels else F.concat_ws("/", name, "rel")
        child = at.select(*key, F.col("t.id").alias("child"), "t")
        rows = tree.join(head, [*key, "head"]).join(child, [*key, "child"])
        if self.pos_keep != ALL:
            rows = rows.where(F.col("t.POS").isin([self.pos_keep] if isinstance(self.pos_keep, str) else list(self.pos_keep)))
        out = rows.select(*key, "pos", "word", ctx.alias("ctx")).distinct()
        return _contexts(_targets(out, words), vocab)


def _tree(d: Dependency, columns: dict[str, pa.Array], relations: list | None, tags: list | None):
    """``(row, pos, word, names, ctx, named)``: the distinct contexts of a batch's tokens, words and contexts as codes of ``names`` and ``named``.

    Edges are arrays of sentence, head, child and relation, heads and children by token id; a join of these is a search in a sorted array.
    """
    o = flat.lists(columns["_name"])[1]
    values = {c: flat.lists(a)[0] for c, a in columns.items()}
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))
    both, ids = flat.codes(pa.concat_arrays([values["id"], values["head"]]))
    own, up = both[: len(row)], both[len(row) :]
    none = np.isin(np.append(np.array(ids.to_pylist(), object), None), ["0", "_", None])
    rel, named = flat.codes(values["dependency_relation"])
    rels = named.to_pylist()
    width = len(ids) + 1
    tokens = np.flatnonzero(own >= 0)
    by_id = flat.Join((row * width + own)[tokens])

    def at(r, code):
        """Places of edges, and the tokens of that id in their sentences."""
        i, j = by_id((r * width + code))
        return i, tokens[j]

    is_root = np.array([x.lower() == "root" for x in rels] + [True])
    base = np.flatnonzero(~none[up] & ~is_root[rel] & (own >= 0))
    i, j = at(row[base], up[base])
    child = base[i]  # heads that aren't in the sentence give no edge
    r, h, c, k = row[child], up[child], own[child], rel[child]
    if d.collapse:
        forms, form_names = flat.codes(values["form"])
        form_names = form_names.to_pylist()

        def prefixed(prefix, form):
            known = {}
            for f in np.unique(form[form >= 0]).tolist():
                known[f] = len(rels)
                rels.append(prefix + form_names[f])
            return np.array([known.get(f, -1) for f in form.tolist()], np.int64)

        code = {name: x for x, name in enumerate(rels)}
        of = lambda *which: np.isin(k, [code[w] for w in which if w in code])
        if d.dependencies.startswith("universal"):
            # child --case--> preposition: the edge from child's head to child is labelled by the preposition.
            case = np.flatnonzero(of("case"))
            x, y = flat.Join(r * width + c)(r[case] * width + h[case])
            more = (r[y], h[y], c[y], prefixed("case_", forms[child[case[x]]]))
            kept = ~of("case", "nmod")
            edge = flat.dense(np.append(r, more[0]), np.append(h, more[1]), np.append(c, more[2]))
            kept &= ~np.isin(edge[: len(r)], edge[len(r) :])
        else:
            moved = np.flatnonzero(of("pobj") & ~none[up[j]])
            more = (r[moved], up[j[moved]], c[moved], prefixed("prep_", forms[j[moved]]))
            kept = ~of("prep", "pobj")
        r, h, c, k = (np.append(x[kept], y) for x, y in zip((r, h, c, k), more))
    if relations is not None:
        kept = np.isin(k, [x for x, name in enumerate(rels) if name in set(relations)])
        r, h, c, k = r[kept], h[kept], c[kept], k[kept]
    if not d.directed:
        n = len(rels)
        rels = rels + [f"{x}-" for x in rels]
        r, h, c, k = np.append(r, r), np.append(h, c), np.append(c, h), np.append(k, np.where(k < 0, -1, k + n))
    for _ in range(d.depth - 1):
        x, y = flat.Join(r * width + h)(r * width + c)
        ok = h[x] != c[y]
        x, y = x[ok], y[ok]
        pair, which = np.unique((k[x] + 1) * (len(rels) + 1) + k[y] + 1, return_inverse=True)
        known = {name: i for i, name in enumerate(rels)}
        text = [None, *rels]
        far = np.array([known.setdefault("_".join(t for t in (text[p // (len(rels) + 1)], text[p % (len(rels) + 1)]) if t is not None), len(known)) for p in pair.tolist()], np.int64)
        rels = list(known)
        r, h, c, k = np.append(r, r[x]), np.append(h, h[x]), np.append(c, c[y]), np.append(k, far[which])
        first = np.unique(flat.dense(r, h, c, k), return_index=True)[1]
        r, h, c, k = r[first], h[first], c[first], k[first]
    i, t = at(r, h)
    r, c, k = r[i], c[i], k[i]
    i, u = at(r, c)
    t, k = t[i], k[i]
    if tags is not None:
        tag, tag_names = flat.codes(values["POS"])
        ok = np.isin(tag[u], [x for x, name in enumerate(tag_names.to_pylist()) if name in set(tags)])
        t, u, k = t[ok], u[ok], k[ok]
    word, names = flat.codes(values["_name"])
    ctx, contexts = word[u], names
    if d.labels:
        pair, which = np.unique((ctx + 1) * (len(rels) + 1) + k + 1, return_inverse=True)
        # As concat_ws: what is null is left out.
        parts = flat.taken(names.cast(pa.string()), pair // (len(rels) + 1) - 1), flat.taken(pa.array(rels, pa.string()), pair % (len(rels) + 1) - 1)
        code, contexts = flat.codes(pc.binary_join_element_wise(*parts, "/", null_handling="skip"))
        ctx = code[which]
    once = np.unique(t * (len(contexts) + 1) + ctx + 1)
    t, ctx = once // (len(contexts) + 1), once % (len(contexts) + 1) - 1
    return row[t], t - o[row[t]], word[t], names, ctx, contexts


@dataclass(frozen=True)
class Custom:
    """Contexts by a Python function of a sentence's tokens that returns one list of contexts for each token.

    It runs in Arrow workers, on whole sentences.
    """

    function: Callable[[list], list]

    def _found(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The row and place of each context's token, and the contexts."""
        rows, places, found = [], [], []
        for i, s in enumerate(tokens.to_pylist()):
            for pos, (_, cs) in enumerate(zip(s or (), self.function(s) if s is not None else ())):
                cs = list(cs)
                found += cs
                rows += [i] * len(cs)
                places += [pos] * len(cs)
        return np.array(rows, np.int64), np.array(places, np.int64), pa.array(found, pa.string())

    def __call__(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        slim = sentences.select("doc_id", "sent_id", "tokens")
        ids = [slim.schema[c].dataType.simpleString() for c in ("doc_id", "sent_id")]

        def run(batches):
            for b in flat.slices(batches, "tokens"):
                row, pos, ctx = self._found(b.column(2))
                values, o = flat.lists(b.column(2))
                cols = [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32)), values.take(pa.array(o[row] + pos)).cast(pa.string()), ctx]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sent_id", "pos", "word", "ctx"])

        rows = slim.mapInArrow(run, f"doc_id {ids[0]}, sent_id {ids[1]}, pos int, word string, ctx string")
        return _contexts(_targets(rows, words), vocab)

    def counted(self, sentences: DataFrame, words: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
        """``(word, ctx, n)``, counted in the sentences' tasks first."""

        def run(batches):
            for b in flat.slices(batches, "tokens"):
                row, pos, ctx = self._found(b.column(0))
                values, o = flat.lists(b.column(0))
                word, names = flat.codes(values)
                code, named = flat.codes(ctx)
                width = len(named) + 1
                kinds, n = np.unique((word[o[row] + pos] + 1) * width + code + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([flat.taken(names, kinds // width - 1).cast(pa.string()), flat.taken(named, kinds % width - 1), pa.array(n)], ["word", "ctx", "n"])

        out = sentences.select("tokens").mapInArrow(run, "word string, ctx string, n long")
        return _contexts(_targets(out, words), vocab).groupBy("word", "ctx").agg(F.sum("n").alias("n"))
