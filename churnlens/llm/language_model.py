"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

Words fall into classes: the most frequent words are classes of their own,
the others share a class by their last two bytes.  The model predicts the
class of the next word from the classes of the two words before,

    logit(c | a, b) = (Q1[a] + Q2[b]) . R[c] + bias[c],

normalised over all classes by batched matrix products.  Within a class, a
word has its add-one share of the class's training tokens, so that the
probabilities of all words (with one unseen word per class) add up to 1.

* Chunks: each task cuts its documents into chunks of about ``CHUNK_BYTES``,
  in a written table, so that neither long texts nor repeated rows make a
  chunk large.
* Counts: every distinct word of every document, in the tasks per chunk of
  documents, then summed per word.  The table grows with the corpus and stays
  in Spark; the driver sees the top words and the sums per class only.
* Training: every task runs over all its training tokens once per round, from
  the same start; the token-weighted mean of the tasks' parameters (of fixed
  size) starts the next round.
* Scoring: chunks meet the counts of their own words (one row per distinct
  word and chunk, not per token).

Defined results: null counts as empty; every text has at least its end token;
rows with a null id are scored and not learnt from; repeated rows get the
same result; without training tokens every class is equally likely; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, keyed, unkeyed, written

#: Bytes of one chunk's documents (more by one document at most), and what a
#: row counts beside its text.
CHUNK_BYTES = 16 << 20
ROW_BYTES = 64
TOP_WORDS = 255
SUFFIX_CLASSES = 256
CLASSES = 1 + TOP_WORDS + SUFFIX_CLASSES  # class 0: the end of a text
BEGIN = CLASSES  # stands before a text, in contexts only
DIMENSIONS = 16
ROUNDS = 2
NOISE = 32
BATCH = 8192
RATE = 0.1

END = np.uint64(0xE0D0E0D0E0D0E0D1)
LOWER = K.lower_table()


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with one END per document, their suffix classes, and where
    documents begin."""
    low = LOWER[raw]
    first, last, doc = K.words(low, off)
    words = K.word_hashes(low, first, last)
    code = low[last - 1].astype(np.int64) * 31 + np.where(last - first > 1, low[np.maximum(last - 2, 0)], 0) if len(last) else np.zeros(0, np.int64)
    suffix = 1 + TOP_WORDS + code % SUFFIX_CLASSES
    return np.insert(words, doc[1:], END), np.insert(suffix, doc[1:], 0), doc + np.arange(len(doc))


class Vocabulary:
    """Classes of words: END, the top words, else by suffix."""

    def __init__(self, top: list[int]):
        self.top = np.array(sorted(np.array(top, dtype=np.int64).view(np.uint64).tolist()), dtype=np.uint64)

    def classes(self, words: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return suffix
        found = K.lookup(self.top, words)
        return np.where((found >= 0) & (words != END), found + 1, suffix)


def contexts(classes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the word before and of the one before that."""
    one, two = np.full(len(classes), BEGIN), np.full(len(classes), BEGIN)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    starts = doc[:-1]
    one[starts] = BEGIN
    two[starts] = BEGIN
    later = starts + 1
    two[later[later < doc[1:]]] = BEGIN
    return one, two


def start_parameters(share: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    size = (CLASSES + 1, DIMENSIONS)
    return {
        "q1": rng.normal(0, 0.1, size).astype(np.float32), "q2": rng.normal(0, 0.1, size).astype(np.float32),
        "r": rng.normal(0, 0.1, size).astype(np.float32),
        "bias": np.append(np.log(share), -30).astype(np.float32)[:, None] * np.ones((1, 1), np.float32),
    }


class Trainer:
    """NCE on one task's tokens, with Adagrad steps."""

    def __init__(self, start: dict[str, np.ndarray], share: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in start.items()}
        self.squares = {k: np.full_like(v, 1e-2) for k, v in start.items()}
        self.log_noise = np.log(share * NOISE).astype(np.float32)
        self.cumulated = np.cumsum(share)
        self.rng = np.random.default_rng(seed)
        self.n = 0

    def _step(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        d = grad.shape[1]
        at = (rows[:, None] * d + np.arange(d)).ravel()
        total = np.bincount(at, weights=grad.ravel(), minlength=self.p[name].size).reshape(self.p[name].shape).astype(np.float32)
        self.squares[name] += total**2
        self.p[name] -= RATE * total / np.sqrt(self.squares[name])

    def run(self, c: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for a in range(0, len(c), BATCH):
            w, x, y = c[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH]
            q = self.p["q1"][x] + self.p["q2"][y]
            r = self.p["r"][w]
            noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), CLASSES - 1)
            rn = self.p["r"][noise]
            good = (q * r).sum(axis=1) + self.p["bias"][w, 0] - self.log_noise[w]
            bad = q @ rn.T + self.p["bias"][noise, 0] - self.log_noise[noise]
            g = (1 / (1 + np.exp(-np.clip(good, -20, 20))) - 1) / len(w)  # of the data
            h = 1 / (1 + np.exp(-np.clip(bad, -20, 20))) / len(w)  # of the noise
            gq = g[:, None] * r + h @ rn
            self._step("r", np.concatenate([w, noise]), np.concatenate([g[:, None] * q, h.T @ q]))
            self._step("q1", x, gq)
            self._step("q2", y, gq)
            self._step("bias", np.concatenate([w, noise]), np.concatenate([g, h.sum(axis=0)])[:, None])
            self.n += len(w)


def trained(base: DataFrame, vocabulary: Vocabulary, share: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS passes over all training documents."""
    sc = base.sparkSession.sparkContext
    state = start_parameters(share)
    names = list(state)
    for turn in range(ROUNDS):
        sent = sc.broadcast((state, vocabulary, share))

        def emit(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            start, vocabulary, share = sent.value
            task = Trainer(start, share, turn)
            for batch in batches:
                for _, _, raw, off in K.slices(batch.column("text")):
                    words, suffix, doc = tokens(raw, off)
                    c = vocabulary.classes(words, suffix)
                    task.run(c, *contexts(c, doc))
            if task.n:
                rows = np.concatenate([task.p[k] for k in names], axis=1).astype(np.float64) * task.n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(rows))), pa.array([task.n] * len(rows)), pa.array(list(rows), pa.list_(pa.float64()))],
                    ["slot", "n", "p"])

        width = sum(v.shape[1] for v in state.values())
        local = base.where("train").select("text").mapInArrow(emit, "slot bigint, n bigint, p array<double>")
        means = local.groupBy("slot").agg(F.array(*[F.sum(F.get("p", F.lit(i))) / F.sum("n") for i in range(width)]).alias("p"))
        rows = sorted(means.collect(), key=lambda r: r.slot)  # CLASSES + 1 rows
        if not rows:
            break
        merged = np.array([r.p for r in rows], dtype=np.float32)
        edge = np.cumsum([0, *(state[k].shape[1] for k in names)])
        state = {k: merged[:, a:b].copy() for k, a, b in zip(names, edge[:-1], edge[1:])}
    return state


def class_log_probabilities(p: dict[str, np.ndarray], c, one, two) -> np.ndarray:
    """Normalised natural log-probability of each token's class; every
    distinct context is multiplied with all classes once."""
    key, inverse = np.unique(one * (CLASSES + 1) + two, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    edge = np.searchsorted(inverse[order], np.arange(0, len(key) + 4096, 4096))
    out = np.empty(len(c))
    r, bias = p["r"][:CLASSES], p["bias"][:CLASSES, 0]
    for i, a in enumerate(range(0, len(key), 4096)):
        k = key[a : a + 4096]
        logit = (p["q1"][k // (CLASSES + 1)] + p["q2"][k % (CLASSES + 1)]) @ r.T + bias
        top = logit.max(axis=1)
        logit -= (top + np.log(np.exp(logit - top[:, None]).sum(axis=1)))[:, None]
        at = order[edge[i] : edge[i + 1]]
        out[at] = logit[inverse[at] - a, c[at]]
    return out


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their chunk: neighbours in the task, by bytes."""
    before, first = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        size = np.diff(K.utf8(batch.column("text"))[1]) + ROW_BYTES
        chunk = first + (before + np.cumsum(size) - size) // CHUNK_BYTES
        before += int(size.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], [*batch.schema.names, "chunk"])


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, suffix, chunk, training tokens) of the distinct words of each
    chunk; a chunk that two tasks read gives a word twice."""
    seen, of = [], None

    def merged() -> pa.RecordBatch:
        words, suffix, n = (np.concatenate(x) for x in zip(*seen))
        values, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=n, minlength=len(values)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(K.signed(values)), pa.array(suffix[first].astype(np.int32)),
                                           pa.array(np.full(len(values), of, np.int64)), pa.array(n)], ["word", "suffix", "chunk", "n"])

    for batch in batches:
        chunk, train = batch.column("chunk").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for a, b in zip(edge[:-1], edge[1:]):
            if a == b:
                continue
            if seen and of != chunk[a]:
                yield merged()
                seen = []
            of = chunk[a]
            for row, end, raw, off in K.slices(batch.column("text").slice(a, b - a)):
                words, suffix, doc = tokens(raw, off)
                values, first, inverse = np.unique(words, return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=np.repeat(train[a + row : a + end], np.diff(doc)), minlength=len(values))
                seen.append((values, suffix[first], n))
    if seen:
        yield merged()


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score``, both log10.

    train: condition on ``key`` (the id) of the rows to learn from."""
    base = keyed(docs, id_col, text_col)
    base = base.withColumn("train", F.coalesce(train & (F.col("tag") < (1 << 33)), F.lit(False)))
    row = base.schema["row"].dataType.simpleString()
    base = written(base.select("row", "text", "train").mapInArrow(in_chunks, f"row {row}, text string, train boolean, chunk bigint"), "lm-chunks")
    per_chunk = base.select("chunk", "train", "text").mapInArrow(distinct_words, "word bigint, suffix int, chunk bigint, n bigint")
    counts = per_chunk.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("c")).where("c > 0")
    counts = written(counts, "lm-counts")
    end = int(np.array([END]).view(np.int64)[0])
    top = [r.word for r in counts.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(TOP_WORDS).collect()]
    vocabulary = Vocabulary(top)
    place = {int(np.array([w]).view(np.int64)[0]): i + 1 for i, w in enumerate(vocabulary.top)}
    kind = F.col("suffix")
    sums = counts.where(~F.col("word").isin(top) if top else F.lit(True)).groupBy(kind.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        n_class[r.k], v_class[r.k] = r.n, r.v
    for r in counts.where(F.col("word").isin(top)).select("word", "c").collect() if top else []:
        n_class[place[r.word]], v_class[place[r.word]] = r.c, 1
    total, kinds = int(n_class.sum()), int(v_class.sum())
    share = (n_class + 1) / (total + CLASSES)
    model = trained(base, vocabulary, share)
    sent = base.sparkSession.sparkContext.broadcast((model, vocabulary, n_class, v_class))  # of fixed size

    mine = per_chunk.select("word", "chunk").join(counts.select("word", "c"), "word").select("chunk", "word", "c")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        model, vocabulary, n_class, v_class = sent.value
        known = right.column("word").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, count = known[order], right.column("c").to_numpy()[order]
        single = np.zeros(CLASSES, dtype=bool)
        single[: 1 + len(vocabulary.top)] = True
        parts = []
        for _, _, raw, off in K.slices(left.column("text").cast(pa.large_string()).combine_chunks()):
            words, suffix, doc = tokens(raw, off)
            at = K.lookup(known, words) if len(known) else np.full(len(words), -1)
            c = np.where(at >= 0, count[at], 0) if len(known) else np.zeros(len(words), np.int64)
            k = vocabulary.classes(words, suffix)
            within = np.where(single[k], 0.0, np.log((c + 1) / (n_class[k] + v_class[k] + 1)))
            model_log = class_log_probabilities(model, k, *contexts(k, doc)) + within
            base_log = np.log10((c + 1) / (total + kinds + 1))
            begin = doc[:-1]
            parts.append((np.diff(doc), np.add.reduceat((c > 0).astype(np.int64), begin), np.add.reduceat(base_log, begin),
                          np.add.reduceat(model_log, begin) / math.log(10)))
        n_tokens, n_known, base_score, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0),) * 4
        return pa.table({"row": left.column("row"), "text": left.column("text"), "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()), "base_score": base_score, "score": score})

    out = base.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(
        scored, f"row {row}, text string, n_tokens bigint, n_known bigint, base_score double, score double")
    return unkeyed(out, docs, text_col, None, n_tokens=F.col("n_tokens"), n_known=F.col("n_known"),
                   train_tokens=F.lit(total).cast("bigint"), base_score=F.col("base_score"), score=F.col("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document's text."""
    fold = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(7))
    out = lm_scores(documents(spark, sf_dir), fold != 2)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
