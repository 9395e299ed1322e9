"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two, of ``BUCKETS`` each: one by the word's
hash and one by that of its beginning (its first ``BEGINNING`` characters), so
that forms of a stem which no labelled text holds are known by their stem, and
words that share one bucket seldom share the other.  Filters of several widths
slide over the words; the largest response of each filter over the whole text
goes through a logistic output.  In scoring, a filter's response is a sum of
rows of precomputed tables (embedding x filter tap), so a text costs a few
gathers per word.

Training reads every labelled document whole, as bucket numbers packed into
shards (by a hash of id and text, some ``SHARD_BYTES`` of text each), so
nothing depends on partitioning; each text of a labelled id is a document.  In
each of ``ROUNDS`` rounds, as many for a large table as for a small one, every
shard goes through its documents from the common model, and the changes are
averaged over the shards that made them (summed by Spark as whole numbers, so
that their order does not matter).  A
fifth of the documents (by hash of the id) is held back to choose the round,
to calibrate the score (Platt scaling) and to choose a threshold per language,
which gives ``flagged``; these are read off counts of logits to 1/``FINE``
over all documents held back.  The score itself sees the text only.

Defined results: null counts as empty; a text without words gets the score of
no response at all; several labels of one document count as toxic if any is;
repeated rows get the same result; with no labelled documents of both kinds the
score is the labelled rate (0.5 without labels); an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, keyed, unkeyed, written
from churnlens.llm.license_scan import ALNUM, LOWER

#: Buckets of words, and as many of beginnings; a word is one number of both.
BUCKETS = 1 << 16
ROWS = 2 * BUCKETS
BEGINNING = 4
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bytes of text (of all documents) per shard; its words are four bytes each.
SHARD_BYTES = 16 << 20
#: Rounds over all shards.
ROUNDS = 6
BATCH = 64
#: Logits are counted to 1/FINE, changes of the model summed to 1/STEP.
FINE = 64
STEP = float(1 << 30)
THRESHOLD = 0.3


def buckets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per word (its bucket, and its beginning's in the upper
    half), and where documents begin."""
    low = LOWER[raw]
    first, last, doc = K.words(low, off, ALNUM)
    lead = (low & 0xC0) != 0x80
    chars = np.append(np.flatnonzero(lead), len(low))
    begun = np.minimum((np.cumsum(lead) - 1)[first] + BEGINNING, len(chars) - 1)
    word, begin = (K.mix(K.word_hashes(low, first, end)) & np.uint64(BUCKETS - 1) for end in (last, np.minimum(chars[begun], last)))
    return (word | begin << np.uint64(16)).astype(np.uint32), doc


def rows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two embeddings of each word."""
    return (ids & np.uint32(BUCKETS - 1)).astype(np.int64), (ids >> np.uint32(16)).astype(np.int64) + BUCKETS


@dataclass
class Model:
    embedding: np.ndarray
    taps: list[np.ndarray]  # per width: width x dimensions x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ tap for tap in w] for w in self.taps]


def responses(tables, ids: np.ndarray, doc: np.ndarray, places: bool = False):
    """Largest response of each filter per (non-empty) document; with
    ``places``, also where."""
    sizes = np.diff(doc)
    some = np.flatnonzero(sizes)
    left = np.repeat(doc[1:], sizes) - np.arange(len(ids))  # words to the end of the text
    word, begin = rows_of(ids)
    best, where = [], []
    for taps in tables:
        r = taps[0][word]
        r += taps[0][begin]
        for j, tap in enumerate(taps[1:], 1):
            part = tap[word[j:]]
            part += tap[begin[j:]]
            part[left[:-j] <= j] = 0
            r[: len(ids) - j] += part
        top = np.maximum.reduceat(r, doc[some], axis=0) if len(some) else np.zeros((0, r.shape[1]), r.dtype)
        best.append(top)
        if places:
            at = np.empty(top.shape, np.int64)
            for i, d in enumerate(some):
                at[i] = doc[d] + r[doc[d] : doc[d + 1]].argmax(axis=0)
            where.append(at)
    return some, best, where


def logits(model: Model, tables, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    some, best, _ = responses(tables, ids, doc)
    z = np.full(len(doc) - 1, model.out_bias)
    z[some] += np.maximum(np.concatenate(best, axis=1) + model.bias, 0) @ model.out
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class State:
    """A model in training, with the squares of past gradients."""

    model: Model
    grown: np.ndarray
    moments: list

    def parts(self) -> list[np.ndarray]:
        m = self.model
        return [*m.taps, *self.moments[0], m.bias, self.moments[1], m.out, self.moments[2], np.array([m.out_bias, self.moments[3]])]

    def rows(self) -> np.ndarray:
        """All numbers: a row per embedding, then the rest in rows as long."""
        rest = np.concatenate([x.ravel() for x in self.parts()])
        width = DIMENSIONS + 1
        rest = np.concatenate([rest, np.zeros(-len(rest) % width)]).reshape(-1, width)
        return np.concatenate([np.concatenate([self.model.embedding, self.grown], axis=1), rest]).astype(np.float64)

    @staticmethod
    def of(rows: np.ndarray) -> State:
        state = start()
        state.model.embedding[:] = rows[:ROWS, :DIMENSIONS]
        state.grown[:] = rows[:ROWS, DIMENSIONS:]
        rest, at = rows[ROWS:].ravel(), 0
        for x in state.parts()[:-1]:
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        state.model.out_bias, state.moments[3] = float(rest[at]), float(rest[at + 1])
        return state


def start(seed: int = 5) -> State:
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (ROWS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    for w in model.taps:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.5
    model.out[:] = np.abs(model.out)
    moments = [[np.full_like(w, 1e-2) for w in model.taps], np.full_like(model.bias, 1e-2), np.full_like(model.out, 1e-2), 1e-2]
    return State(model, np.full((ROWS, 1), 1e-1, np.float32), moments)


def associate(model: Model, seen: np.ndarray, n: np.ndarray) -> None:
    """The first dimension starts from each bucket's association with the
    label: documents per bucket and label, documents per label.  It is the
    log odds ratio less two standard errors (or none), which does not grow
    with the number of documents, as a test's figure would."""
    x = seen + 0.5
    odds = np.log(x[:, 1] / (n[1] + 1 - x[:, 1]).clip(0.5)) - np.log(x[:, 0] / (n[0] + 1 - x[:, 0]).clip(0.5))
    sure = np.maximum(np.abs(odds) - 2 * np.sqrt((1 / x).sum(axis=1)), 0)
    model.embedding[:, 0] = np.sign(odds) * np.minimum(sure, 4) / 2


@dataclass
class Shard:
    """Documents as bucket numbers, in order of their ids' hashes."""

    number: int
    ids: np.ndarray
    doc: np.ndarray
    y: np.ndarray
    held: np.ndarray
    lang: list[str | None]

    def joined(self, rows) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.ids[self.doc[i] : self.doc[i + 1]] for i in rows]
        doc = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), doc


SHARD = "shard int, ids binary, sizes binary, y binary, held binary, lang array<string>"


def pack(group: pa.Table) -> pa.Table:
    """One row per shard."""
    key = group.column("key").to_numpy()
    mixed = K.mix(key.astype(np.uint64))
    group = group.take(pa.array(np.lexsort((group.column("hash").to_numpy(), key, mixed))))
    held = np.sort(mixed) % np.uint64(5) == 4
    ids = group.column("ids").to_pylist()
    cells = [group.column("shard")[0].as_py(), b"".join(ids), np.array([len(x) // 4 for x in ids], np.int64).tobytes(),
             group.column("toxic").to_numpy().astype(np.uint8).tobytes(), held.astype(np.uint8).tobytes(), group.column("lang").to_pylist()]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())]
    return pa.table([pa.array([c], k) for c, k in zip(cells, kinds)], names=["shard", "ids", "sizes", "y", "held", "lang"])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, ids, sizes, y, held = (batch.column(c)[i].as_py() for c in ("shard", "ids", "sizes", "y", "held"))
            doc = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))])
            yield Shard(number, np.frombuffer(ids, np.uint32), doc, np.frombuffer(y, np.uint8).astype(np.int64),
                        np.frombuffer(held, np.uint8) == 1, batch.column("lang")[i].as_py())


def numbers(first: str, rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of whole numbers under their indexes, for Spark to sum."""
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]],
                                      [first, *[f"v{i}" for i in range(rows.shape[1])]])


def summed(parts: DataFrame, emit, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes, sums of the rows ``emit`` gives for them, and how many they
    were: at most a row per number of the model comes back."""
    columns = [f"v{i}" for i in range(width)]
    rows = parts.mapInArrow(emit, "at int, " + ", ".join(f"{c} bigint" for c in columns))
    got = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n")).toArrow()
    return got.column("at").to_numpy(), np.stack([got.column(c).to_numpy() for c in columns], axis=1), got.column("n").to_numpy()


def descend(state: State, shard: Shard, balance: np.ndarray, seed) -> None:
    """One pass over the shard's documents, ``BATCH`` at a time."""
    model, moments, grown, y = state.model, state.moments, state.grown, shard.y
    order = np.flatnonzero(~shard.held & (np.diff(shard.doc) > 0))
    np.random.default_rng(seed).shuffle(order)
    tables = None
    for a in range(0, len(order), BATCH):
        rows = order[a : a + BATCH]
        flat, doc = shard.joined(rows)
        if a % (8 * BATCH) == 0:
            tables = model.tables()
        _, top, where = responses(tables, flat, doc, True)
        pre = np.concatenate(top, axis=1) + model.bias
        hidden = np.maximum(pre, 0)
        g = (sigmoid(hidden @ model.out + model.out_bias) - y[rows]) * balance[y[rows]] / len(rows)
        g_hidden = (g[:, None] * model.out) * (pre > 0)
        steps = [hidden.T @ g + 1e-3 * model.out, g_hidden.sum(axis=0)]
        for k, w in enumerate(WIDTHS):
            gw = g_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(model.taps[k])
            for j in range(w):
                at = where[k] + j
                ok = at < doc[1:, None]
                word = flat[np.minimum(at, len(flat) - 1)]
                both = rows_of(word)
                e = model.embedding[both[0]] + model.embedding[both[1]]  # documents x filters x dimensions
                gj = gw * ok
                grad[j] = np.einsum("nfd,nf->df", e, gj)
                ge = gj[:, :, None] * model.taps[k][j].T[None]
                rowsum = (ge**2).mean(axis=2)
                for row in both:
                    np.add.at(grown[:, 0], row.ravel(), rowsum.ravel())
                    np.add.at(model.embedding, row.ravel(), (-0.05 * ge / np.sqrt(grown[row])).reshape(-1, DIMENSIONS))
            grad += 1e-4 * model.taps[k]
            moments[0][k] += grad**2
            model.taps[k] -= 0.05 * grad / np.sqrt(moments[0][k])
        for i, (value, grad) in enumerate(((model.out, steps[0]), (model.bias, steps[1])), 1):
            moments[3 - i] += grad**2
            value -= (0.05 * grad / np.sqrt(moments[3 - i])).astype(np.float32)
        moments[3] += g.sum() ** 2
        model.out_bias -= 0.05 * g.sum() / np.sqrt(moments[3])


def held_back(parts: DataFrame, model: Model) -> DataFrame:
    """lang, toxic, bin (the logit in 1/FINE), n over the documents held back."""
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for shard in shards(batches):
            held = np.flatnonzero(shard.held)
            z = np.concatenate([np.zeros(0), *[logits(model, tables, *shard.joined(held[a : a + BATCH])) for a in range(0, len(held), BATCH)]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang[i] for i in held], pa.string()), pa.array(shard.y[held].astype(np.int32)),
                 pa.array(np.rint(np.clip(z, -30, 30) * FINE).astype(np.int32))], ["lang", "toxic", "bin"])

    rows = parts.mapInArrow(emit, "lang string, toxic int, bin int")
    return rows.groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n"))


def train(parts: DataFrame, rounds: int) -> tuple[Model, DataFrame | None]:
    """A model of all packed shards, and the threshold of each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            seen = np.zeros((ROWS + 1, 2), np.int64)  # the last row counts documents
            for i in np.flatnonzero(~shard.held):
                for row in rows_of(shard.ids[shard.doc[i] : shard.doc[i + 1]]):
                    seen[np.unique(row), shard.y[i]] += 1
                seen[ROWS, shard.y[i]] += 1
            at = np.flatnonzero(seen.any(axis=1))
            yield numbers("at", seen[at], at)

    at, found, _ = summed(parts, count, 2)
    seen = np.zeros((ROWS + 1, 2), np.int64)
    seen[at] = found
    n = np.maximum(1, seen[ROWS])
    balance = 0.5 / n * seen[ROWS].sum()
    state = start()
    associate(state.model, seen[:ROWS], n)

    best, best_loss, best_bins = None, np.inf, None
    for step in range(rounds):
        now = state.rows()
        shared = parts.sparkSession.sparkContext.broadcast(now)

        def change(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            for shard in shards(batches):
                own = State.of(shared.value)
                before = own.rows()
                descend(own, shard, balance, (step, shard.number))
                moved = np.rint((own.rows() - before) * STEP).astype(np.int64)
                at = np.flatnonzero(moved.any(axis=1))
                yield numbers("at", moved[at], at)

        at, moved, by = summed(parts, change, DIMENSIONS + 1)
        now[at] += moved / by[:, None] / STEP
        state = State.of(now)
        bins = written(held_back(parts, state.model), "toxicity-held-back")
        # a row per kind and bin
        got = bins.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).orderBy("toxic", "bin").toArrow()
        y, z, many = got.column("toxic").to_numpy(), got.column("bin").to_numpy() / FINE, got.column("n").to_numpy()
        p = sigmoid(z)
        loss = -(many * balance[y] * np.log(np.where(y == 1, p, 1 - p) + 1e-9)).sum() / max(1, many.sum())
        if loss <= best_loss:
            best, best_loss, best_bins, best_held = state.model, loss, bins, (y, z, many)
    y, z, many = best_held
    if not len(y):
        return best, None
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a weighted logistic fit
        p = sigmoid(a * z + b)
        r, h = many * (p - y) / many.sum(), many * p * (1 - p) / many.sum() + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, [(r * z).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b]).clip(-1, 1)
    best.scale = (float(max(a, 0.05)), float(b))
    return best, best_thresholds(best_bins, best.scale)


def best_thresholds(bins: DataFrame, scale: tuple[float, float]) -> DataFrame:
    """lang, limit: the threshold with the largest F1 (none where a language
    has no positive document)."""
    per = bins.where("lang is not null").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("hit"))
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    sofar = down.rowsBetween(Window.unboundedPreceding, 0)
    positive = F.sum("hit").over(Window.partitionBy("lang"))
    per = per.select("lang", "bin", F.lead("bin").over(down).alias("after"), positive.alias("positive"),
                     (F.sum("hit").over(sofar) / (F.sum("n").over(sofar) + positive)).alias("f1"))
    top = per.where("positive > 0").groupBy("lang").agg(F.max(F.struct("f1", "bin", "after")).alias("top"))

    def p(c: str):
        return 1 / (1 + F.exp(-(F.lit(scale[0]) * F.col(f"top.{c}") / FINE + F.lit(scale[1]))))

    return top.select(F.col("lang").alias("own_lang"), ((p("bin") + F.coalesce(p("after"), F.lit(0.0))) / 2).alias("limit"))


def fitted(base: DataFrame, labelled: DataFrame, lang_col: str | None) -> tuple[Model | float, DataFrame | None]:
    """A model and its thresholds, or the labelled rate where one kind of
    document is missing.

    labelled: (key, toxic), one row per id."""
    counts = {r.toxic: r.c for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts.get(0) or not counts.get(1):
        return (counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5), None
    if labelled.join(base.select("key"), "key", "left_semi").select("toxic").distinct().count() < 2:
        return counts[1] / sum(counts.values()), None
    lang = F.col("row")[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    texts = base.select("key", F.xxhash64("text").alias("hash"), lang.alias("lang"), "text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first().s or 0

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, off in K.slices(batch.column("text")):
                ids, doc = buckets(raw, off)
                offsets = pa.py_buffer((doc * 4).astype(np.int64))
                packed = pa.Array.from_buffers(pa.large_binary(), end - row, [None, offsets, pa.py_buffer(ids)])
                rest = [batch.column(x).slice(row, end - row) for x in ("key", "hash", "lang")]
                yield pa.RecordBatch.from_arrays([*rest, packed.cast(pa.binary())], ["key", "hash", "lang", "ids"])

    rows = texts.mapInArrow(emit, "key bigint, hash bigint, lang string, ids binary").join(labelled, "key")
    # every text of an id; map tasks drop repeats
    rows = rows.groupBy("key", "hash").agg(F.min(F.struct("ids", "lang", "toxic")).alias("one"))
    number = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("key", "hash"), F.lit(number)).cast("int")
    rows = rows.select(shard.alias("shard"), "key", "hash", "one.ids", "one.lang", "one.toxic").repartition(number, "shard")
    parts = written(rows.groupBy("shard").applyInArrow(pack, SHARD), "toxicity-shards")
    return train(parts, ROUNDS)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
             learn=None) -> DataFrame:
    """Every input row with ``score``, ``predicted`` (score of 0.3 or more)
    and ``flagged`` (by the language's own threshold).

    learn: condition on ``key`` (the id) of the rows whose labels are used."""
    base = keyed(docs, id_col, text_col)
    key = F.col(f"`{id_col}`").cast("bigint").alias("key")
    labelled = labels.select(key, F.col("toxic").cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)")
    labelled = labelled.groupBy("key").agg(F.max("toxic").alias("toxic"))
    if learn is not None:
        labelled = labelled.where(learn)
    lang_col = lang_col if lang_col in docs.columns else None
    model, limits = fitted(base, labelled, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: ROWS x DIMENSIONS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if isinstance(model, Model) else None
        for batch in batches:
            score = []
            for row, end, raw, off in K.slices(batch.column("text"), K.SLICE_BYTES // 4):
                if tables is None:
                    score.append(np.full(end - row, model))
                else:
                    score.append(sigmoid(model.scale[0] * logits(model, tables, *buckets(raw, off)) + model.scale[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())],
                ["row", "text", "score"])

    row = base.schema["row"].dataType.simpleString()
    out = base.select("row", "text").mapInArrow(emit, f"row {row}, text string, score double")
    limit = F.lit(THRESHOLD)
    if lang_col and limits is not None:
        out = out.join(written(limits, "toxicity-limits"), F.col("row")[lang_col].cast("string") == F.col("own_lang"), "left")
        limit = F.coalesce(F.col("limit"), limit)
    return unkeyed(out, docs, text_col, None, score=F.col("score"), predicted=(F.col("score") >= THRESHOLD).cast("int"),
                   flagged=F.col("score") >= limit)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels outside the held-out rows."""
    fold = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(4))
    out = toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), learn=fold != 2)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "flagged")
