"""Suffix-array dedup over bytes: hash-compared suffix sort.

Every byte of a 100-byte string that also starts earlier (smaller id, or same
document and earlier place) is removed; strings never cross documents.

1. Anchored runs (:mod:`churnlens.llm.repeats`) find the runs whose content
   occurs earlier as a whole, and the *fragments* at the edges of repeats.
2. Fragments are dealt by anchor.  In a task, the suffixes of at least
   ``length`` bytes are sorted with a bottom-up mergesort; equal strings have
   the same anchor at the same place, so they are merged within (anchor,
   place) only, and one whose hash no other there has equals none and is left
   out.  Two suffixes are compared by their first eight bytes, then through
   prefix polynomial hashes: a binary search finds their common extension in
   log2(length) hash comparisons, and the byte after it decides.
3. Neighbours in sorted order with a common extension of ``length`` are equal
   strings; their bytes are compared too, so a hash collision cannot join
   two different strings.  All but the earliest of a class repeat it.
4. An anchor with more fragments than ``SPLIT`` is dealt to several tasks by
   a hash; each sorts its share and passes on one representative per string,
   with its bytes, and a window over (anchor, bytes) settles which is earliest.

Fragments are thus compared byte by byte on either side of ``SPLIT``.  Whole
runs (step 1) are compared by anchor and content hash, 128 bits together.

Defined results: null text counts as empty and loses nothing, as do texts
under ``length`` bytes; a row with a null id loses nothing and removes
nothing; rows equal in id and text are one document and get the same result;
rows equal in id only are documents in the order of their texts' CRC-32, so a
string that both hold stays in one of them; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm import repeats as R
from churnlens.llm.frames import documents, keyed, unkeyed, written

LENGTH = 100
ANCHOR_BYTES = 24
#: Fragments of one anchor sorted by one task; more are dealt to several.
SPLIT = 2048
#: Strings of split anchors passed on at once.
OPEN_ROWS = 1 << 14
#: Bytes of fragments sorted at once (whole anchors, or shares of them).
SORT_BYTES = 1 << 20

FOUND = "anchor bigint, win bigint, content binary, key bigint, tag bigint, start int, n int, open boolean"


def byte_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_CODE[raw], off


class PrefixHashes:
    """Compares places of a byte array through prefix polynomial hashes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length = raw, length
        self.prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(K.BYTE_CODE[raw] * K.powers(K.BASE, len(raw)), out=self.prefix[1:])
        self.back = K.powers(K.BASE_INV, len(raw) + 1)
        #: Hash of the string of ``length`` bytes at each place.
        self.whole = (self.prefix[length:] - self.prefix[:-length]) * self.back[: max(0, len(raw) - length + 1)]
        #: The eight bytes at each place, as a number in the order of the bytes.
        eight = np.ndarray(len(raw), ">u8", np.append(raw, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        self.eight = eight.astype(np.uint64) if length >= 8 else None

    def equal(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        return (self.prefix[a + size] - self.prefix[a]) * self.back[a] == (self.prefix[b + size] - self.prefix[b]) * self.back[b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair, at most ``length``."""
        low = np.where(self.whole[a] == self.whole[b], self.length, 0)
        rest = np.flatnonzero(low == 0)
        if len(rest):
            x, y = a[rest], b[rest]
            lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), self.length, np.int64)  # equal at lo, not at hi
            while (hi - lo).max() > 1:
                mid = (lo + hi) // 2
                same = self.equal(x, y, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
            low[rest] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a < b, a == b) for strings of ``length`` bytes: by their first
        eight bytes, and by hashes where these are equal."""
        if self.eight is None:
            return self.extended(a, b)
        x, y = self.eight[a], self.eight[b]
        less, tie = x < y, np.zeros(len(a), dtype=bool)
        near = np.flatnonzero(x == y)
        if len(near):
            less[near], tie[near] = self.extended(a[near], b[near])
        return less, tie

    def extended(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.common(a, b)
        tie = size == self.length
        at = np.where(tie, 0, size)
        return ~tie & (self.raw[a + at] < self.raw[b + at]), tie

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves are equal."""
        out = np.zeros(len(a), dtype=bool)
        if len(a):
            strings = np.lib.stride_tricks.sliding_window_view(self.raw, self.length)
            for i in range(0, len(a), 8192):
                out[i : i + 8192] = (strings[a[i : i + 8192]] == strings[b[i : i + 8192]]).all(axis=1)
        return out


def merge_sorted(hashes: PrefixHashes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Stable mergesort of string starts within groups (``group`` is
    ascending).  Every merge of a level is done at once: an element's new
    place is its place in its own half plus its rank in the other half, found
    by binary search."""
    n = len(at)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, n))
    g_begin, g_size = np.repeat(begin, size), np.repeat(size, size)
    within = np.arange(n) - g_begin
    order, width = at.copy(), 1
    active = np.flatnonzero(g_size > 1)
    while len(active):
        i = within[active]
        block = i // (2 * width) * (2 * width)
        left = i - block < width
        mid = np.minimum(block + width, g_size[active])
        top = np.minimum(block + 2 * width, g_size[active])
        lo = np.where(left, mid, block) + g_begin[active]
        hi = np.where(left, top, mid) + g_begin[active]
        base, mine = lo.copy(), order[active]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            probe = (lo[open_] + hi[open_]) // 2
            less, tie = hashes.less(order[probe], mine[open_])
            # from the right half, equal elements of the left half come first
            further = less | (tie & ~left[open_])
            lo[open_] = np.where(further, probe + 1, lo[open_])
            hi[open_] = np.where(further, hi[open_], probe)
        rank = lo - base
        place = g_begin[active] + np.where(left, i, i - (mid - block)) + rank
        merged = order.copy()
        merged[place] = mine
        order, width = merged, width * 2
        active = active[g_size[active] > width]
    return order


def shared(x: np.ndarray) -> np.ndarray:
    """Indexes of the values that occur more than once."""
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    return np.sort(order[np.append(same, False) | np.append(False, same)]) if len(x) else order


def repeated_strings(raw, off, group, shift, n, length):
    """Suffix sort of fragments (in the order of their places): for each
    string start, whether an equal string stands earlier.  A string whose hash
    no other string of its anchor and place has is not equal to any of them
    and need not be sorted."""
    total = int(n.sum())
    frag = np.repeat(np.arange(len(n)), n)
    each = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    at = off[frag] + each
    # equal strings have one anchor at one place
    key = group[frag] * (2 * length) + (shift[frag] - each) + length
    hashes = PrefixHashes(raw, length)
    by = shared(K.mix(hashes.whole[at] + K.mix(key.astype(np.uint64))))
    by = by[np.argsort(key[by], kind="stable")]
    order = merge_sorted(hashes, at[by], key[by])
    sorted_key = key[by]
    near = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    a, b = order[near], order[near + 1]
    same = hashes.whole[a] == hashes.whole[b]
    same[same] = hashes.verified(a[same], b[same])
    later = np.zeros(len(raw) + 1, dtype=bool)
    later[b[same]] = True
    return frag, each, at, later[at], hashes


def anchor_places(raw: np.ndarray, first: np.ndarray, anchor: np.ndarray, length: int, k: int) -> np.ndarray:
    """Where the (leftmost) anchor stands in the string at each of ``first``."""
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(K.BYTE_CODE[raw] * K.powers(K.BASE, len(raw)), out=prefix[1:])
    back, every = K.powers(K.BASE_INV, len(raw) + 1), np.arange(length - k + 1)
    out = np.empty(len(first), dtype=np.int64)
    for i in range(0, len(first), 4096):
        at = first[i : i + 4096, None] + every
        out[i : i + 4096] = (K.mix((prefix[at + k] - prefix[at]) * back[at]) == anchor[i : i + 4096, None]).argmax(axis=1)
    return out


def fragments(docs_with_edges: DataFrame, length: int, k: int) -> DataFrame:
    """The bytes of the listed runs, and where their anchor stands."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_off, run = R.list_values(batch.column("edges"), "anchor", "start", "n", "parts")
            key, tag = batch.column("key"), batch.column("tag")
            for row, end, raw, off in K.slices(batch.column("text")):
                which = slice(list_off[row], list_off[end])
                if which.start == which.stop:
                    continue
                doc = np.repeat(np.arange(end - row), np.diff(list_off[row : end + 1]))
                first = off[doc] + run["start"][which]
                shift = anchor_places(raw, first, run["anchor"][which].view(np.uint64), length, k)
                n = run["n"][which].astype(np.int64)
                data = raw.tobytes()
                at_doc = pa.array(doc + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run["anchor"][which]), pa.array(run["parts"][which]), key.take(at_doc), tag.take(at_doc),
                     pa.array(run["start"][which]), pa.array(run["n"][which]), pa.array(shift.astype(np.int32)),
                     pa.array([data[a:b] for a, b in zip(first.tolist(), (first + n + length - 1).tolist())], pa.binary())],
                    ["anchor", "parts", "key", "tag", "start", "n", "shift", "content"])

    return docs_with_edges.mapInArrow(
        emit, "anchor bigint, parts int, key bigint, tag bigint, start int, n int, shift int, content binary")


def sorted_fragments(frags: DataFrame, length: int) -> DataFrame:
    """Repeated strings of each task's fragments, as ranges; and, of anchors
    that several tasks share, the first of each string (``open``)."""

    def one(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        # a repeated row gives the same fragment again: one of them stands for both
        same = np.ones(batch.num_rows, dtype=bool)
        same[:1] = False
        for x in ("anchor", "key", "tag", "start"):
            values = batch.column(x).to_numpy()
            same[1:] &= values[1:] == values[:-1]
        if same.any():
            batch = batch.filter(pa.array(~same))
        content = batch.column("content").combine_chunks().cast(pa.large_binary())
        _, o, data = content.buffers()
        off = np.frombuffer(o, np.int64)[content.offset : content.offset + len(content) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
        col = {x: batch.column(x).to_numpy() for x in ("anchor", "parts", "start", "n", "shift")}
        group = np.cumsum(np.concatenate([[False], col["anchor"][1:] != col["anchor"][:-1]]))
        n = col["n"].astype(np.int64)
        frag, each, at, later, hashes = repeated_strings(raw, off - off[0], group, col["shift"].astype(np.int64), n, length)
        # neighbouring repeated strings of a fragment: one range
        edge = np.concatenate([[True], frag[1:] != frag[:-1], [True]])
        begin = later & (edge[:-1] | ~np.concatenate([[False], later[:-1]]))
        stop = later & (edge[1:] | ~np.concatenate([later[1:], [False]]))
        b, s = np.flatnonzero(begin), np.flatnonzero(stop)
        yield rows(batch, frag[b], each[b], s - b + 1, None, None)
        open_ = np.flatnonzero(~later & (col["parts"][frag] > 1))
        if len(open_):
            win = K.mix(hashes.whole[at[open_]])
            strings = np.lib.stride_tricks.sliding_window_view(raw, length)
            for i in range(0, len(open_), OPEN_ROWS):
                some = open_[i : i + OPEN_ROWS]
                content = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(some), [None, pa.py_buffer(strings[at[some]].tobytes())])
                yield rows(batch, frag[some], each[some], np.ones(len(some), np.int64), win[i : i + OPEN_ROWS], content.cast(pa.binary()))

    def rows(batch, frag, each, n, win, content) -> pa.RecordBatch:
        open_ = content is not None
        take = pa.array(frag)
        get = lambda x: batch.column(x).combine_chunks().take(take)
        start = (batch.column("start").to_numpy()[frag] + each).astype(np.int32)
        # a settled range needs no partner: a key of its own spreads it evenly
        key = [get("anchor"), pa.array(K.signed(win))] if open_ else [get("key"), pa.array(start.astype(np.int64))]
        return pa.RecordBatch.from_arrays(
            [*key, content if open_ else pa.nulls(len(frag), pa.binary()), get("key"), get("tag"), pa.array(start), pa.array(n.astype(np.int32)),
             pa.array([open_] * len(frag), pa.bool_())], ["anchor", "win", "content", "key", "tag", "start", "n", "open"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            while held.num_rows and (cut := whole_anchors(held)):
                yield from one(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from one(held)

    def whole_anchors(held: pa.Table) -> int:
        """Rows up to the end of the first anchor that reaches SORT_BYTES,
        or 0 if that anchor may go on in the next batch."""
        size = np.cumsum(held.column("n").to_numpy().astype(np.int64) + length - 1)
        full = int(np.searchsorted(size, SORT_BYTES))
        if full >= held.num_rows:
            return 0
        anchor = held.column("anchor").to_numpy()
        after = np.flatnonzero(anchor[full + 1 :] != anchor[full])
        return full + 1 + int(after[0]) if len(after) else 0

    salt = F.pmod(F.xxhash64("key", "start"), F.col("parts"))
    dealt = frags.repartition("anchor", salt).sortWithinPartitions("anchor", "key", "tag", "start")
    return dealt.mapInArrow(emit, FOUND)


def cut_bytes(docs_with_spans: DataFrame, length: int) -> DataFrame:
    """Cut the covered bytes: kept bytes, counts and removed byte spans."""

    def one(text: bytes, starts: np.ndarray, n: np.ndarray):
        if not len(starts):
            return text, len(text), 0, []
        lo, hi = R.true_runs(R.covered(len(text), starts, starts + n + length - 1))
        kept, at = [], 0
        for a, b in zip(lo.tolist(), hi.tolist()):
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        return b"".join(kept), len(text), int((hi - lo).sum()), [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_off, run = R.list_values(batch.column("spans"), "start", "n")
            out = []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                a, b = list_off[i], list_off[i + 1]
                out.append(one(text.as_py(), run["start"][a:b].astype(np.int64), run["n"][a:b].astype(np.int64)))
            kept, size, gone, spans = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["row", "kept", "n_bytes", "n_removed", "spans"])

    row = docs_with_spans.schema["row"].dataType.simpleString()
    return docs_with_spans.select("row", "text", "spans").mapInArrow(
        emit, f"row {row}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 anchor_bytes: int = ANCHOR_BYTES, split: int = SPLIT) -> DataFrame:
    """Every input row with its kept bytes (binary, in place of the text:
    a cut can fall inside a character), ``n_bytes``, ``n_removed`` and
    ``removed_spans`` (byte positions)."""
    base = keyed(docs, id_col, text_col)
    whole, edges = R.classified(R.runs_of(base, byte_codes, length, anchor_bytes), within=True)
    sizes = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > split)
    parts = written(sizes.select("anchor", F.ceil(F.col("c") / split).cast("int").alias("parts")), "split")
    edges = edges.join(parts, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    lists = R.by_document(edges, "edges", "anchor", "start", "n", "parts")
    frags = fragments(base.join(lists, ["key", "tag"]).select("key", "tag", "text", "edges"), length, anchor_bytes)
    found = sorted_fragments(frags, length)
    earliest = F.row_number().over(Window.partitionBy("anchor", "win", "content", "open").orderBy("key", "tag", "start"))
    found = found.withColumn("place", earliest).where("not open or place > 1").select("key", "tag", "start", "n")
    spans = R.by_document(whole.unionByName(written(found, "found")), "spans", "start", "n")
    cut = cut_bytes(base.join(spans, ["key", "tag"], "left"), length)
    return unkeyed(cut, docs, text_col, F.col("kept"), n_bytes=F.col("n_bytes"), n_removed=F.col("n_removed"),
                   removed_spans=F.col("spans"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes kept of every document, as their digest."""
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("bigint").alias("n_spans"),
                      F.sha2("text", 256).alias("kept_sha256"), "removed_spans")
