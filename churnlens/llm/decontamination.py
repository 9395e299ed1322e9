"""Benchmark decontamination: a BM25 index of test items, queried with every
training passage under block-max pruning.

1. Items become an inverted index (term, item, BM25 impact).  Impacts are
   divided by the item's own score, so that 1 means a passage holding every
   term of the item, and one threshold serves all items.
2. A document is cut into segments as long as the longest item; every two
   neighbouring segments form a passage, so an item that occurs lies whole
   within one.  Terms whose largest impacts add up to at most ``SLACK`` are
   not looked up (they cannot lift a passage over the threshold alone); for
   the others, the largest impact per block of items bounds each block's
   scores.  Only blocks whose bound reaches the threshold are scored.
3. Every item at or over the threshold is verified: the share of the n-grams
   of its question (all but its last line) and of its answer (the last line,
   if there are several) that stand in the passage.

The collection's size, mean length and document frequencies are counted over
all items by Spark.  An index holds the postings of at most ``MAX_ITEMS``
items, so its size is bounded; more items make several indexes, each queried
with all passages, with the same scores as one.

Defined results: null and empty texts match nothing, nor do items without
words; an item of fewer than ``NGRAM`` words is one n-gram of its own length;
items with a null id are searched for and reported with a null id, and ids may
be of any type; repeated rows and repeated items give repeated matches;
without items or documents there are no matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from churnlens.llm import kernels as K
from churnlens.llm.frames import documents, keyed, unkeyed, written
from churnlens.llm.license_scan import lower_words

NGRAM = 5
THRESHOLD = 0.6
OVERLAP = 0.8
SLACK = 0.2
BLOCK = 32
K1, B = 1.2, 0.75
MAX_ITEMS = 20_000


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes of one word sequence."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return np.unique(K.span_hashes(words, at, at + n))


def item_words(text: str) -> np.ndarray:
    raw, off = K.utf8(pa.array([text], pa.large_string()))
    return lower_words(raw[off[0] : off[1]], off - off[0])[0]


class Collection(NamedTuple):
    """Items with words, their mean length, and that of the longest."""

    n: int
    mean: float
    longest: int


class ItemIndex:
    """Postings with normalised impacts, block maxima and n-gram sets."""

    def __init__(self, items: list[tuple], collection: "Collection", df: dict[int, int]):
        sequences, self.ids, parts = [], [], []
        for item, text in items:
            words = [w for w in map(item_words, text.split("\n")) if len(w)]
            whole = np.concatenate(words) if words else np.zeros(0, np.uint64)
            if not len(whole):
                continue
            short = len(whole) < NGRAM
            question = np.concatenate(words[:-1]) if len(words) > 1 and not short else whole
            answer = words[-1] if len(words) > 1 and not short else np.zeros(0, np.uint64)
            sequences.append(whole)
            self.ids.append(item)
            parts.append([(min(NGRAM, len(p)), grams(p, min(NGRAM, len(p)))) if len(p) else (0, p) for p in (question, answer)])
        self.parts = parts
        self.longest = collection.longest
        counts = [Counter(s.tolist()) for s in sequences]
        n = len(sequences)
        self.vocabulary = np.array(sorted({t for c in counts for t in c}), dtype=np.uint64)
        place = {t: i for i, t in enumerate(self.vocabulary.tolist())}
        rows = []
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(sequences[i]) / collection.mean)
            impact = {t: math.log(1 + (collection.n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(impact.values())
            rows += [(place[t], i, x / own) for t, x in impact.items()]
        rows.sort()
        self.item = np.array([r[1] for r in rows], dtype=np.int64)
        self.impact = np.array([r[2] for r in rows])
        term = np.array([r[0] for r in rows], dtype=np.int64)
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.blocks = (n + BLOCK - 1) // BLOCK
        pair = term * max(1, self.blocks) + self.item // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        self.top = np.maximum.reduceat(self.impact, begin) if len(begin) else np.zeros(0)
        self.top_block = pair[begin] % max(1, self.blocks) if len(begin) else begin
        self.top_first = np.searchsorted(term[begin], np.arange(len(self.vocabulary) + 1))
        # terms that need no look-up: together at most SLACK, whatever the passage
        largest = np.maximum.reduceat(self.impact, self.first[:-1]) if len(rows) else np.zeros(0)
        order = np.argsort(largest, kind="stable")
        self.essential = np.ones(len(largest), dtype=bool)
        self.essential[order[np.cumsum(largest[order]) <= SLACK]] = False
        self.slack = float(largest[~self.essential].sum())
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where vocabulary words stand, and which."""
        at = np.flatnonzero(self.filter[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = K.lookup(self.vocabulary, words[at])
        return at[term >= 0], term[term >= 0]

    def candidates(self, at, term, doc, segment_words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, block) pairs whose passage may reach the threshold; a
        passage is a segment and the next one of the same document."""
        sizes = np.diff(doc)
        per_doc = np.maximum(1, -(-sizes // segment_words))
        seg_first = np.concatenate([[0], np.cumsum(per_doc)])
        which = np.searchsorted(doc, at, side="right") - 1
        seg = seg_first[which] + (at - doc[which]) // segment_words
        use = self.essential[term]
        pairs = np.unique(seg[use] * len(self.vocabulary) + term[use])
        s, t = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        n = self.top_first[t + 1] - self.top_first[t]
        post = np.repeat(self.top_first[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(s, n) * self.blocks + self.top_block[post]
        # a block's bound in a passage: of its segment and of the next
        used, inverse = np.unique(slot, return_inverse=True)
        bound = np.bincount(inverse, weights=self.top[post], minlength=len(used))
        seg_doc = np.repeat(np.arange(len(sizes)), per_doc)
        before = used - self.blocks
        before = before[(used >= self.blocks)]
        before = before[seg_doc[before // self.blocks] == seg_doc[before // self.blocks + 1]]
        starts = np.union1d(used, before)
        get = lambda x: np.where(K.lookup(used, x) >= 0, bound[K.lookup(used, x)], 0.0)
        total = get(starts)
        after = starts + self.blocks
        last = after // self.blocks >= seg_first[-1]
        same = ~last & (seg_doc[np.minimum(after // self.blocks, len(seg_doc) - 1)] == seg_doc[starts // self.blocks])
        total = total + np.where(same, get(after), 0.0)
        found = starts[total + self.slack >= THRESHOLD - 1e-9]
        return found // self.blocks, found % self.blocks, seg_first

    def scored(self, at, term, doc, seg_first, segs, blocks) -> Iterator[tuple[int, int, float]]:
        """(segment, item, score) of the candidate blocks' items that reach
        the threshold; a passage's distinct terms meet their postings."""
        windows, place = np.unique(segs, return_inverse=True)
        which = np.searchsorted(doc, at, side="right") - 1
        seg = seg_first[which] + (at - doc[which]) // self.longest
        # a word counts for the passage of its segment and of the one before
        earlier = np.flatnonzero(seg > seg_first[which])
        seg, term = np.concatenate([seg, seg[earlier] - 1]), np.concatenate([term, term[earlier]])
        window = K.lookup(windows, seg) if len(windows) else np.full(len(seg), -1)
        use = window >= 0
        pairs = np.unique(window[use] * len(self.vocabulary) + term[use])
        window, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        chunk = max(1, (1 << 22) // max(1, len(self.ids)))
        for low in range(0, len(windows), chunk):
            size = min(chunk, len(windows) - low)
            wanted = np.zeros((size, self.blocks), dtype=bool)
            mine = (place >= low) & (place < low + size)
            wanted[place[mine] - low, blocks[mine]] = True
            a, b = np.searchsorted(window, [low, low + size])
            n = self.first[term[a:b] + 1] - self.first[term[a:b]]
            post = np.repeat(self.first[term[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, item = np.repeat(window[a:b] - low, n), self.item[post]
            keep = wanted[row, item // BLOCK]
            score = np.bincount(row[keep] * len(self.ids) + item[keep], weights=self.impact[post[keep]], minlength=size * len(self.ids))
            for hit in np.flatnonzero(score >= THRESHOLD - 1e-9).tolist():
                yield int(windows[low + hit // len(self.ids)]), hit % len(self.ids), float(score[hit])

    def matches(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float, int, float, float]]:
        """(document, item, score, first word, question and answer overlap)
        of verified items; the best passage of each document and item."""
        at, term = self.terms(words)
        if not len(at):
            return
        segs, blocks, seg_first = self.candidates(at, term, doc, self.longest)
        best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
        for s, item, score in self.scored(at, term, doc, seg_first, segs, blocks):
            d = int(np.searchsorted(seg_first, s, side="right")) - 1
            begin = int(doc[d]) + (s - int(seg_first[d])) * self.longest
            window = words[begin : min(begin + 2 * self.longest, int(doc[d + 1]))]
            share = [float(np.isin(g, grams(window, n)).mean()) if n else 1.0 for n, g in self.parts[item]]
            if min(share) >= OVERLAP - 1e-9:
                found = (score, begin - int(doc[d]), share[0], share[1])
                if found > best.get((d, item), (-1.0,)):
                    best[d, item] = found
        for (d, item), (score, begin, question, answer) in sorted(best.items()):
            yield d, self.ids[item], score, begin, question, answer


def numbered_items(items: DataFrame, id_col: str, text_col: str, max_items: int) -> tuple[DataFrame, int]:
    """``item``, ``text``, ``part`` of every item with a text, and the number
    of parts; a part holds about ``max_items`` / 2 items at most."""
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    n = rows.count()
    parts = 1 if n <= max_items else -(-2 * n // max_items)
    return rows.select("item", "text", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")), parts


def item_statistics(items: DataFrame) -> tuple[Collection, DataFrame]:
    """The collection, and ``part``, ``term``, ``df`` of each part's terms
    with their document frequency over all items."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            for row, end, raw, off in K.slices(batch.column("text")):
                words, doc = lower_words(raw, off)
                size = np.diff(doc)
                which = np.repeat(np.arange(end - row), size)
                vocabulary, term = np.unique(words, return_inverse=True)
                pairs = np.unique(which * max(1, len(vocabulary)) + term)
                of, term = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
                terms = pa.array(K.signed(vocabulary[term]) if len(term) else np.zeros(0, np.int64))
                ones, zeros = np.ones(len(term), np.int64), pa.array(np.zeros(len(term), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part[row:end][of].astype(np.int32)), terms, pa.array(ones), zeros, zeros], names)
                total = [int((size > 0).sum()), int(size.sum()), int(size.max())]
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), *[pa.array([x]) for x in total]], names)

    names = ["part", "term", "n", "words", "longest"]
    counts = items.select("part", "text").mapInArrow(emit, "part int, term bigint, n bigint, words bigint, longest bigint")
    counts = counts.groupBy("part", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    counts = written(counts, "item-terms")
    total = counts.where("term is null").first()
    collection = Collection(total.n, total.words / max(1, total.n), max(1, total.longest)) if total else Collection(0, 0.0, 1)
    df = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    return collection, counts.where("term is not null").select("part", "term").join(df, "term")


def item_indexes(items: DataFrame, id_col: str, text_col: str, max_items: int) -> list:
    """The broadcast index of each part.  One part is gathered at a time."""
    rows, parts = numbered_items(items, id_col, text_col, max_items)
    collection, df = item_statistics(rows)
    out = []
    for part in range(parts):
        mine = [(r["item"], r["text"]) for r in rows.where(F.col("part") == part).orderBy("row").collect()]
        terms = {r.term & ((1 << 64) - 1): r.df for r in df.where(F.col("part") == part).collect()}
        out.append(rows.sparkSession.sparkContext.broadcast(ItemIndex(mine, collection, terms)))
    return out


def matched(base: DataFrame, index, item_type) -> DataFrame:
    """``row``, ``text`` and ``matches`` of every document with one index."""
    row = base.schema["row"].dataType.simpleString()
    match = f"array<struct<item:{item_type.simpleString()},score:double,first_word:int,question:double,answer:double>>"
    kind = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("score", pa.float64()), ("first_word", pa.int32()),
                               ("question", pa.float64()), ("answer", pa.float64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, _, raw, off in K.slices(batch.column("text")):
                if own.ids:
                    for d, item, score, begin, question, answer in own.matches(*lower_words(raw, off)):
                        found[first + d].append({"item": item, "score": score, "first_word": begin, "question": question, "answer": answer})
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(found, kind)], ["row", "text", "matches"])

    return base.select("row", "text").mapInArrow(emit, f"row {row}, text string, matches {match}")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """(id, item, score, first_word, question, answer): every verified match
    of a document and a test item."""
    base = keyed(docs, id_col, text_col)
    item_type = items.schema[item_id_col].dataType
    out = None
    for index in item_indexes(items, item_id_col, item_text_col, max_items):
        found = matched(base, index, item_type).select(F.col("row")[id_col].alias(id_col), F.inline("matches"))
        one = found.withColumnRenamed("item", item_id_col)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """The input's rows without the documents that hold a test item.  Further
    indexes are queried with what the one before left, a written table, so
    that a task holds one index."""
    item_type = items.schema[item_id_col].dataType
    rest = docs
    for i, index in enumerate(item_indexes(items, item_id_col, item_text_col, max_items)):
        rest = written(rest, "clean") if i else rest
        found = matched(keyed(rest, id_col, text_col), index, item_type)
        rest = unkeyed(found.where(F.size("matches") == 0), docs, text_col, None)
    return rest


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified matches of all documents with all benchmark items."""
    found = leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "question", "answer")
