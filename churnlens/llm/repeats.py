"""Anchored repeats: what substring dedup (words) and suffix-array dedup
(bytes) share.

A *window* is ``length`` neighbouring symbols of one document.  Its anchor is
the smallest hash among its ``k``-grams (leftmost on ties), so equal windows
have equal anchors at the same place.  Neighbouring windows with the same
anchor position form a *run*; one row per run is shuffled instead of one per
window (about ``2 / (length - k + 2)`` rows per symbol).

* An anchor that occurs once cannot be part of a repeat; its runs go.
* Runs of one anchor with the same content form a *class*.  All but the
  first run of a class repeat it entirely.
* Only the first runs of anchors that have several classes (the edges of
  repeats, where contexts differ) are looked at window by window.

Nothing here emits pairs: a group of any size costs one row per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import has_id, written

HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0x00000000FFFFFFFF)

RUNS = "anchor bigint, cls bigint, key bigint, tag bigint, start int, n int"


def anchor_runs(codes: np.ndarray, off: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of a slice: document index, first window (relative to the
    document), number of windows, anchor hash, place of the anchor in the
    first window, content hash.

    codes: one 64-bit code per symbol; off: where documents begin."""
    n = len(codes)
    if n < length:
        empty = np.zeros(0, np.int64)
        return {"doc": empty, "start": empty, "n": empty, "shift": empty, "anchor": empty.view(np.uint64), "cls": empty.view(np.uint64)}
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * K.powers(K.BASE, n), out=prefix[1:])
    grams = K.mix((prefix[k:] - prefix[:-k]) * K.powers(K.BASE_INV, n)[: n - k + 1])
    least = K.sliding_min((grams & HIGH) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    at = (least & LOW).astype(np.int64)
    del least
    sizes = np.diff(off)
    long = np.flatnonzero(sizes >= length)
    edge = np.zeros(len(at) + 1, dtype=np.int8)
    edge[off[long]] += 1
    edge[off[long] + sizes[long] - length + 1] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    step = np.empty(len(at) + 1, dtype=bool)
    step[0] = step[-1] = True
    step[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(step[:-1] & valid)
    end = np.flatnonzero(step[1:] & valid) + 1
    doc = np.searchsorted(off, first, side="right") - 1
    last = end - 1 + length
    spans = (prefix[last] - prefix[first]) * K.powers(K.BASE_INV, n + 1)[first]
    cls = K.mix(spans ^ ((end - first).astype(np.uint64) << np.uint64(40)))
    return {"doc": doc, "start": first - off[doc], "n": end - first, "shift": at[first] - first, "anchor": grams[at[first]], "cls": cls}


def runs_of(base: DataFrame, symbols: Callable, length: int, k: int) -> DataFrame:
    """One row per run of every document that has an id.

    symbols(bytes, offsets) -> (codes, offsets in symbols)"""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tag = batch.column("key"), batch.column("tag")
            for row, end, raw, off in K.slices(batch.column("text")):
                r = anchor_runs(*symbols(raw, off), length, k)
                if len(r["doc"]):
                    at = pa.array(r["doc"] + row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(K.signed(r["anchor"])), pa.array(K.signed(r["cls"])), key.take(at), tag.take(at),
                         pa.array(r["start"].astype(np.int32)), pa.array(r["n"].astype(np.int32))],
                        ["anchor", "cls", "key", "tag", "start", "n"])

    return base.where(has_id()).select("key", "tag", "text").mapInArrow(emit, RUNS)


def classified(runs: DataFrame, within: bool) -> tuple[DataFrame, DataFrame]:
    """(runs that repeat an earlier one entirely, first runs to look at
    window by window).  Each step is a written table: a lost executor costs
    a re-read, and both sides of a join are then plain shuffles, which AQE
    can split where an anchor is hot.  The group-bys reduce before they
    shuffle.

    within: whether an earlier place in the same document counts; rows that
    share an id but not a text are then documents in the order of their
    tags."""
    stats = [F.min("cls").alias("c0"), F.max("cls").alias("c1")]
    if within:
        shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *stats).where("c > 1")
        order = F.struct("key", "tag", "start")
    else:
        shared = runs.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), *stats).where("lo < hi")
        order = F.col("key")
    shared = written(shared.select("anchor", (F.col("c0") != F.col("c1")).alias("several")), "shared")
    hits = written(runs.join(shared, "anchor"), "hits")
    first = written(hits.groupBy("anchor", "cls").agg(F.min(order).alias("first")), "first")
    repeats = order > F.col("first")
    placed = hits.join(first, ["anchor", "cls"]).where(repeats | F.col("several"))
    placed = written(placed.select("anchor", "key", "tag", "start", "n", repeats.alias("whole")), "placed")
    return placed.where("whole").select("key", "tag", "start", "n"), placed.where("not whole").drop("whole")


def by_document(spans: DataFrame, name: str, *columns: str) -> DataFrame:
    """The distinct spans of each document as one list: bounded by its
    length, however often its row is repeated."""
    return spans.groupBy("key", "tag").agg(F.collect_set(F.struct(*columns)).alias(name))


def list_values(column, *names: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A list<struct> Arrow column as offsets and flat arrays; null: empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten()
    return off, {x: flat.field(x).to_numpy(zero_copy_only=False) for x in names}


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` symbols lie in any of the spans."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def true_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
