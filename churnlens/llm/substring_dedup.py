"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors (:mod:`churnlens.llm.repeats`).  Documents meet on
a shared anchor, in groups and not in pairs: a match is extended left and
right from the anchor by comparing the run of all windows of ``min_words``
words around it at once, and, where runs differ (at the edges of a repeat),
the run's windows one by one.  Equal windows that overlap join up to the
maximal repeat, which may go on over many anchors.  Each word in a repeat that a document with a smaller id also
holds is removed; repeats are judged on the input.

Words are compared by 64-bit hashes of their bytes; a repeat needs equal
anchor *and* equal window (or run) hashes, 128 bits together.

Defined results: null or empty text and texts under ``min_words`` words lose
nothing; a row with a null id loses nothing and removes nothing; rows with the
same id never remove from each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm import repeats as R
from churnlens.llm.frames import documents, keyed, unkeyed, written

MIN_WORDS = 50
ANCHOR_WORDS = 8

SPANS = "array<struct<start:int,end:int>>"


def word_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last, doc = K.words(raw, off)
    return K.word_hashes(raw, first, last), doc


def edge_windows(docs_with_edges: DataFrame, min_words: int) -> DataFrame:
    """Windows of the listed runs: (anchor, window hash, key, tag, start)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_off, run = R.list_values(batch.column("edges"), "anchor", "start", "n")
            key, tag = batch.column("key"), batch.column("tag")
            for row, end, raw, off in K.slices(batch.column("text")):
                which = slice(list_off[row], list_off[end])
                if which.start == which.stop:
                    continue
                codes, word_off = word_codes(raw, off)
                doc = np.repeat(np.arange(end - row), np.diff(list_off[row : end + 1]))
                n = run["n"][which].astype(np.int64)
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(run["start"][which], n) + each
                at = np.repeat(word_off[doc], n) + start
                at_doc = pa.array(np.repeat(doc, n) + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(run["anchor"][which], n)),
                     pa.array(K.signed(K.span_hashes(codes, at, at + min_words))),
                     key.take(at_doc), tag.take(at_doc), pa.array(start.astype(np.int32))],
                    ["anchor", "win", "key", "tag", "start"])

    return docs_with_edges.mapInArrow(emit, "anchor bigint, win bigint, key bigint, tag bigint, start int")


def cut_words(docs_with_spans: DataFrame, min_words: int, separators: str) -> DataFrame:
    """Cut the covered words: kept text, counts and removed word spans."""

    def one(text: bytes, starts: np.ndarray, n: np.ndarray):
        parts = text.split()
        if not len(starts):
            return (text if separators == "keep" else b" ".join(parts)), len(parts), 0, []
        gone = R.covered(len(parts), starts, starts + n + min_words - 1)
        lo, hi = R.true_runs(gone)
        spans = [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())]
        if separators == "keep":
            raw = np.frombuffer(text, dtype=np.uint8)
            first, _, _ = K.words(raw, np.array([0, len(raw)]))
            edge = np.append(first, len(raw))
            kept, at = [], 0
            for a, b in zip(lo, hi):
                kept.append(text[at : edge[a]])
                at = edge[b]
            kept.append(text[at:])
            return b"".join(kept), len(parts), int(gone.sum()), spans
        return b" ".join([w for w, g in zip(parts, gone.tolist()) if not g]), len(parts), int(gone.sum()), spans

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_off, run = R.list_values(batch.column("spans"), "start", "n")
            texts = batch.column("text").cast(pa.binary())
            out = []
            for i, text in enumerate(texts):
                a, b = list_off[i], list_off[i + 1]
                out.append(one(text.as_py(), run["start"][a:b].astype(np.int64), run["n"][a:b].astype(np.int64)))
            kept, n, gone, spans = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), K.string_column(list(kept)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["row", "text", "n_words", "n_removed", "spans"])

    row = docs_with_spans.schema["row"].dataType.simpleString()
    return docs_with_spans.select("row", "text", "spans").mapInArrow(
        emit, f"row {row}, text string, n_words bigint, n_removed bigint, spans {SPANS}")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    anchor_words: int = ANCHOR_WORDS, separators: str = "keep") -> DataFrame:
    """Every input row with repeated passages cut out of its text, and
    ``n_words``, ``n_removed``, ``removed_spans`` (word positions).

    separators: "keep" leaves the white space between kept words as it is;
    "space" joins kept words by one space."""
    base = keyed(docs, id_col, text_col)
    whole, edges = R.classified(R.runs_of(base, word_codes, min_words, anchor_words), within=False)
    lists = R.by_document(edges, "edges", "anchor", "start", "n")
    windows = edge_windows(base.join(lists, ["key", "tag"]).select("key", "tag", "text", "edges"), min_words)
    windows = written(windows, "windows")
    least = windows.groupBy("anchor", "win").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    least = written(least.select("anchor", "win", "lo"), "least")
    repeated = windows.join(least, ["anchor", "win"]).where("key > lo").select("key", "tag", "start", F.lit(1).alias("n"))
    spans = R.by_document(whole.unionByName(repeated), "spans", "start", "n")
    cut = cut_words(base.join(spans, ["key", "tag"], "left"), min_words, separators)
    return unkeyed(cut, docs, text_col, None, n_words=F.col("n_words"), n_removed=F.col("n_removed"),
                   removed_spans=F.col("spans"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document, as the digest of its kept words."""
    out = substring_dedup(documents(spark, sf_dir), separators="space")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "removed_spans")
