"""Target-distribution importance resampling over hashed word runs.

1. Bucket counts of all documents and of the target texts: each task adds up
   an array of ``buckets`` counts, so at most that many rows per task are
   shuffled.  A bucket's gain is the log ratio of its smoothed shares; the
   gains are one array, and a document's weight is the sum of its features'
   entries.
2. The score is the weight plus Gumbel noise hashed from (seed, id), so the
   highest scores are a sample without replacement, and a row's score depends
   on nothing but the row and the counts.
3. The cutoff key (score, id, row) is found exactly by weighted
   median-of-medians: every part of the keys reports the median of what
   remains in it, with its size; the median of these medians, weighted by the
   sizes, is the pivot.  At least a quarter of the remaining keys lies on
   either side, so each round discards that much for certain.  The next
   round's medians come from the job that counts around the pivot.  The driver
   sees two rows per part and round; keys that still remain are written anew
   once they are an eighth of the table that is read.
4. Only the winners are sorted, by range partitions, and numbered by the
   counts of the partitions before theirs.

Defined results: null text has no words; a document without features has
weight 0; a null id is an empty string in the noise and comes last on ties;
repeated rows are drawn as rows of their own, tied ones in the order of the
written table; an empty table gives an empty table, and without target texts
all of their counts are 0.  Of the input's columns only the id is returned.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, written

BUCKETS = 10_000
LONGEST_RUN = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10

#: Stands for a null id in orders.
NULL_LAST = (1 << 63) - 1
#: Keys are written anew once at most this share of those read remains.
REWRITE = 8
#: Bytes of a span that are hashed for all spans at once; the rest of a longer
#: span is hashed by itself.
WIDE = 64

LOWER, ALNUM = K.lower_table(), K.alnum_table()


def crc_table() -> np.ndarray:
    """CRC-32 of the 256 byte values (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table.astype(np.uint32)


CRC = crc_table()


def span_crc32(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of each span [first, last)."""
    size = np.minimum(last - first, WIDE + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")[::-1]
    begin = first[order]
    longer = len(size) - np.cumsum(np.bincount(size, minlength=WIDE + 2))
    crc = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(WIDE):
        n = longer[i]
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ raw[begin[:n] + i]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(size > WIDE).tolist():
        out[i] = zlib.crc32(raw[first[i] + WIDE : last[i]].tobytes(), int(out[i]))
    return out


def joined(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other with a space between, and their spans."""
    size = last - first
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    inside = np.repeat(begin - first, size)
    source = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[source + inside] = raw[source]
    return out, begin, begin + size


def feature_buckets(raw: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, their documents, words per document) of a
    slice."""
    low = LOWER[raw]
    first, last, doc = K.words(low, off, ALNUM)
    n_words = np.diff(doc)
    which = np.repeat(np.arange(len(n_words)), n_words)
    if longest > 1:
        low, first, last = joined(low, first, last)
    found, of = [], []
    for n in range(1, longest + 1):
        at = np.arange(len(first) - n + 1)
        at = at[which[at] == which[at + n - 1]] if len(at) else at[:0]
        found.append(span_crc32(low, first[at], last[at + n - 1]) % np.uint32(buckets))
        of.append(which[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), n_words


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, off in K.slices(batch.column("text")):
                counts += np.bincount(feature_buckets(raw, off, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    found = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(emit, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: str, row_id) -> int:
    """Gumbel noise of a row, in thousandths, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: str, id_col: str, text_col: str, longest: int) -> DataFrame:
    """id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n_words, n_features, weight = ([np.zeros(0, np.int64)] for _ in range(3))
            for _, _, raw, off in K.slices(batch.column("text")):
                bucket, which, words = feature_buckets(raw, off, longest, len(own))
                n_words.append(words)
                n_features.append(np.bincount(which, minlength=len(words)))
                sums = np.zeros(len(words), np.int64)
                np.add.at(sums, which, own[bucket])
                weight.append(sums)
            weight = np.concatenate(weight)
            score = weight + np.array([noise(seed, x) for x in batch.column("id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_features)), pa.array(weight), pa.array(score)],
                ["id", "n_words", "n_features", "weight", "score"])

    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(emit, "id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


class Key(NamedTuple):
    """A row's place in the order of scores; the least key comes first."""

    loss: int  # the negative score
    id: int
    row: int


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key at which half of the weight is reached."""
    medians.sort()
    half, weight = sum(n for _, n in medians), 0
    for key, n in medians:
        weight += 2 * n
        if weight >= half:
            return key
    raise ValueError("no keys remain")


def before(key: Key, columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which keys, given as columns, come before ``key``."""
    loss, ids, row = columns
    return (loss < key.loss) | ((loss == key.loss) & ((ids < key.id) | ((ids == key.id) & (row < key.row))))


def key_at(keys: DataFrame, place: int) -> Key:
    """The key at a place (from 1) of the order, of the columns ``loss``,
    ``id``, ``row`` (all keys distinct), without sorting them."""
    low, high, pivot = None, None, None
    remaining = read = None
    while True:
        def emit(batches: Iterator[pa.RecordBatch], low=low, high=high, pivot=pivot) -> Iterator[pa.RecordBatch]:
            parts = [[b.column(c).to_numpy() for c in Key._fields] for b in batches]
            columns = tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in Key._fields)
            inside = np.ones(len(columns[0]), dtype=bool)
            for edge, sign in ((low, False), (high, True)):
                if edge is not None:
                    inside &= before(edge, columns) if sign else ~(before(edge, columns) | (columns[2] == edge.row))
            columns = tuple(c[inside] for c in columns)
            first = before(pivot, columns) if pivot is not None else np.zeros(len(columns[0]), dtype=bool)
            rest = ~first & (columns[2] != pivot.row) if pivot is not None else ~first
            rows = []
            for side, mine in ((0, first), (1, rest)):
                own = tuple(c[mine] for c in columns)
                if len(own[0]):
                    middle = np.lexsort(own[::-1])[(len(own[0]) - 1) // 2]
                    rows.append((side, len(own[0]), *(int(c[middle]) for c in own)))
            names = ["side", "n", *Key._fields]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

        found = keys.mapInArrow(emit, "side bigint, n bigint, loss bigint, id bigint, row bigint").collect()
        sides = [[(Key(r.loss, r.id, r.row), r.n) for r in found if r.side == side] for side in (0, 1)]
        if pivot is None:
            side = 1
        else:
            ahead = sum(n for _, n in sides[0])
            if place == ahead + 1:
                return pivot
            side = int(place > ahead)
            if side:
                place, low = place - ahead - 1, pivot
            else:
                high = pivot
        remaining = sum(n for _, n in sides[side])
        read = remaining if read is None else read
        if remaining * REWRITE <= read:
            keys, read = written(keys.where(between(low, high)), "keys"), remaining
        pivot = weighted_median(sides[side])


def key_before(key: Key) -> Column:
    """Whether a row's key comes before ``key``."""
    loss, ids, row = (F.col(c) for c in Key._fields)
    return (loss < key.loss) | ((loss == key.loss) & ((ids < key.id) | ((ids == key.id) & (row < key.row))))


def between(low: Key | None, high: Key | None) -> Column:
    """Whether a row's key lies strictly between the two."""
    out = F.lit(True)
    if low is not None:
        out &= ~key_before(low) & (F.col("row") != low.row)
    if high is not None:
        out &= key_before(high)
    return out


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``rank`` (from 1) in a total order: sorted by range
    partitions, numbered by the sizes of the partitions before."""
    ordered = written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    out = ordered.withColumn("part", part).join(F.broadcast(sizes), "part")
    return out.withColumn(name, F.col("earlier") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "earlier", "at")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      target_text_col: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: str = SEED,
                      min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document's id, ``n_features``, ``weight``, ``score``, and
    ``rank`` if it is among the ``percent`` % drawn of the documents with at
    least ``min_words`` words."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    rows = scored(docs, gain, seed, id_col, text_col, longest).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scored")
    fit = F.col("n_words") >= min_words
    keys = rows.where(fit).select((-F.col("score")).alias("loss"), F.coalesce("id", F.lit(NULL_LAST)).alias("id"), "row")
    draw = keys.count() * percent // 100
    columns = ["id", "n_features", "weight", "score"]
    if not draw:
        out = rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    else:
        last = key_at(written(keys, "keys"), draw)
        shown = rows.select("*", F.struct("id").alias("own")).withColumns({"loss": -F.col("score"), "id": F.coalesce("id", F.lit(NULL_LAST))})
        drawn = fit & (key_before(last) | (F.col("row") == last.row))
        ranked = numbered(shown.where(drawn), [F.col(c) for c in Key._fields], "rank")
        rest = shown.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
        out = ranked.unionByName(rest).select(F.col("own.id").alias("id"), *columns[1:], "rank")
    return out.withColumnRenamed("id", id_col)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the rank of the tenth that is drawn towards the
    benchmark's words."""
    return importance_sample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


#: The registered query in DuckDB SQL.  CRC-32 is computed per distinct word.
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))),
doc_words AS (
  SELECT d.row_id, w FROM (
    SELECT row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM (SELECT row_number() OVER () AS row_id, text FROM documents)) d),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
word_bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))::BIGINT),
                  lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words), crc_table),
totals AS (SELECT (SELECT count(*) FROM doc_words) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM (SELECT unnest(range(10000)) AS bucket) b CROSS JOIN totals
  LEFT JOIN (SELECT bucket, count(*) AS n FROM doc_words JOIN word_bucket USING (w) GROUP BY bucket) s USING (bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n FROM target_words JOIN word_bucket USING (w) GROUP BY bucket) t USING (bucket)),
weights AS (
  SELECT row_id, count(*) AS n_features, sum(g)::BIGINT AS weight
  FROM doc_words JOIN word_bucket USING (w) JOIN gain USING (bucket) GROUP BY row_id),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) LEFT JOIN weights USING (row_id)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS draw
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM ranked
"""
