"""Best-fit packing: documents into as few token sequences as possible.

1. One pass over the texts turns every document into pieces of at most
   ``capacity`` tokens (its ids, then the end id; only longer documents are
   cut, and the shortest piece comes first).  Each task numbers its pieces of
   one length from 0, so that (slice, length, place) names a piece.
2. Pieces of one length are interchangeable, so the packing is decided on the
   histogram of lengths: at most ``capacity`` rows, whatever the input.
   Best-two-fit builds one sequence after another: fill greedily with the
   longest piece that fits; then replace the sequence's shortest piece by the
   two unpacked pieces that fill its place and the gap most tightly, if they
   fill more.  A sequence that would be built again in the same way is built
   as often as the histogram allows in one step, so the plan has few steps for
   any number of documents.
3. A window over (slice, length) counts numbers the pieces of a length across
   slices.  Each piece looks up its number in the plan (one row per step and
   length, at most ``capacity`` times a small factor), which gives its
   sequence and its place there.

No document's tokens are shuffled, only one short row per piece, dealt by
(slice, length): a length that a third of all pieces have is spread over its
slices.

Ids are those of the library ``tokenizers`` for the vocabulary file, without
special tokens (a special token's name in a text is ordinary text).  They are
computed by ``tiktoken`` with the same vocabulary, four times as fast; the
tests compare both on every code point and every vocabulary entry.

Defined results: null counts as empty; an empty text is the end id alone;
rows with a null id and repeated rows are packed as documents of their own; an
empty table gives an empty table.  Of the input's columns only the id is
returned.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm.frames import documents, written

CAPACITY = 2048
END_ID = 0


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes bytes:
    printable Latin-1 characters stand for themselves, the other bytes follow
    from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a byte-level BPE vocabulary file (its content)."""
    letters = byte_letters()
    parsed = json.loads(vocabulary)
    special = {x["content"] for x in parsed.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in parsed["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def piece_bounds(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    pieces = -(-size // capacity)
    first = size - (pieces - 1) * capacity
    return [(0, first), *((first + i * capacity, capacity) for i in range(pieces - 1))]


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: pieces}) of the sequences, in building order."""
    left = {x: n for x, n in histogram.items() if n > 0}
    have = sorted(left)
    plan = []
    while have:
        used: dict[int, int] = {}

        def fill(gap: int) -> int:
            at = bisect_right(have, gap)
            while at:
                x = have[at - 1]
                n = min(left[x] - used.get(x, 0), gap // x)
                if n:
                    used[x] = used.get(x, 0) + n
                    gap -= n * x
                at = min(at - 1, bisect_right(have, gap))
            return gap

        gap = fill(capacity)
        out = 0
        if sum(used.values()) > 1:
            least = min(used)
            pair = tightest_pair(have, left, used, gap + least)
            if sum(pair) > least:
                out = least
                used[least] -= 1
                for x in pair:
                    used[x] = used.get(x, 0) + 1
                fill(gap + least - sum(pair))
                used = {x: n for x, n in used.items() if n}
        # the piece that was replaced must be there each time
        times = min((left[x] - (x == out)) // n or 1 for x, n in used.items())
        plan.append((times, used))
        for x, n in used.items():
            left[x] -= times * n
        have = [x for x in have if left[x]]
    return plan


def tightest_pair(have: list[int], left: dict[int, int], used: dict[int, int], room: int) -> tuple[int, ...]:
    """The two unpacked pieces that fill ``room`` most, or nothing."""
    free = [x for x in have[: bisect_right(have, room - 1)] if left[x] > used.get(x, 0)]
    if not free:
        return ()
    x = np.array(free)
    single = np.array([left[v] - used.get(v, 0) == 1 for v in free])
    other = np.searchsorted(x, room - x, side="right") - 1
    other = np.where((other == np.arange(len(x))) & single, other - 1, other)
    total = np.where(other >= 0, x + x[other], 0)
    best = int(np.argmax(total))
    return (int(x[best]), int(x[other[best]])) if total[best] else ()


class Plan:
    """Where the pieces of a length go, by their number."""

    def __init__(self, steps: list[tuple[int, dict[int, int]]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for times, used in steps:
            offset = 0
            for x in sorted(used, reverse=True):
                rows.append((x, taken.get(x, 0), used[x], sequence, offset))
                taken[x] = taken.get(x, 0) + times * used[x]
                offset += x * used[x]
            sequence += times
        rows.sort()
        self.length, self.first, self.copies, self.sequence, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            low, high = np.searchsorted(self.length, [x, x + 1])
            mine = np.flatnonzero(length == x)
            step = low + np.searchsorted(self.first[low:high], number[mine], side="right") - 1
            since = number[mine] - self.first[step]
            sequence[mine] = self.sequence[step] + since // self.copies[step]
            offset[mine] = self.offset[step] + since % self.copies[step] * x
        return sequence, offset


def pieces(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int,
           with_ids: bool) -> DataFrame:
    """One row per piece, with the number that its task gave it among the
    pieces of its length."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(shared.value, pattern)
        slice_id, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, place, ids = ([] for _ in range(7))
            for i, text in enumerate(batch.column("text")):
                tokens = own.encode_to_numpy(text.as_py() or "", disallowed_special=())
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for k, (begin, size) in enumerate(piece_bounds(len(tokens), capacity)):
                    part = tokens[begin : begin + size]
                    row.append(i), piece.append(k), start.append(begin), length.append(size)
                    crc.append(zlib.crc32(part.tobytes()))
                    place.append(int(seen[size]))
                    seen[size] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = {"id": batch.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64()), "slice": pa.array([slice_id] * len(row), pa.int32()),
                       "place": pa.array(place, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = base.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, slice int, place bigint{ids}"
    return base.mapInArrow(emit, schema)


def best_fit_packing(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: the id, ``piece``, ``start``,
    ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and with
    ``with_ids`` the piece's token ids.

    vocabulary: content of a byte-level BPE vocabulary file; pattern: what
    splits a text before the merges."""
    cut = written(pieces(docs, vocabulary, pattern, id_col, text_col, capacity, end_id, with_ids), "pieces")
    counts = cut.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(Plan(best_two_fit(histogram, capacity)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, place, earlier = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place", "before"))
            sequence, offset = plan.value.place(length, place + earlier)
            kept = [c for c in batch.schema.names if c not in ("slice", "place", "before")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                                             [*kept, "sequence_id", "offset"])

    # the counts grow with the slices: never broadcast them
    numbered = cut.join(counts.select("slice", "length", "before").hint("merge"), ["slice", "length"])
    kept = [f for f in cut.schema.fields if f.name not in ("slice", "place")]
    numbered = numbered.select(*[f.name for f in kept], "place", "before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(emit, schema).withColumnRenamed("id", id_col)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        vocabulary = f.read()
    packed = best_fit_packing(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
