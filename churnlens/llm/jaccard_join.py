"""N-gram Jaccard join: MinHash banding, then exact verification.

1. Per document: its set of word n-grams (64-bit hashes; a text of fewer
   words is one n-gram), a 128-bit fingerprint of the set, MinHash bands.
   Band and row counts follow from the target recall at the threshold.
2. Documents with the same set are one *class*; its smallest document stands
   for it from here on.
3. Representatives are shuffled on band hashes.  A bucket contributes one edge
   per member (to its smallest), never pairs; components of these edges are
   the candidate groups.
4. Each group's n-gram sets meet in blocks of ``BLOCK`` classes: one task
   compares two blocks, keeps pairs that share a band and verifies them on
   the full sets with one matrix product.  It returns one row per class and
   block pair (number of linked documents, local root), not pairs.  Every
   candidate pair is verified exactly once, however large the group.
5. Components of the verified links give the class id.

Comparing m different texts of one group takes m * m / 2 verifications: each
is counted, spread over (m / BLOCK) ** 2 / 2 tasks.

Defined results: a text without words has no links and is its own class; a
row with a null id has no links and a null class id; repeated rows count as
copies of each other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import kernels as K
from churnlens.llm.components import components
from churnlens.llm.frames import documents, has_id, keyed, unkeyed, written

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 160
#: Classes of one side of a comparison.
BLOCK = 128
WORD = r"[^\x20\x09-\x0D]"


def choose_bands(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes
    that finds a pair at the threshold with the target recall."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def ngram_sets(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, ascending, and offsets."""
    first, last, doc = K.words(raw, off)
    codes = K.word_hashes(raw, first, last)
    sizes = np.diff(doc)
    grams = np.maximum(sizes - n + 1, (sizes > 0).astype(np.int64))
    which = np.repeat(np.arange(len(sizes)), grams)
    begin = doc[which] + np.arange(len(which)) - np.repeat(np.cumsum(grams) - grams, grams)
    hashes = K.span_hashes(codes, begin, begin + np.minimum(sizes, n)[which])
    order = np.lexsort((hashes, which))
    which, hashes = which[order], hashes[order]
    new = np.ones(len(which), dtype=bool)
    new[1:] = (which[1:] != which[:-1]) | (hashes[1:] != hashes[:-1])
    which, hashes = which[new], hashes[new]
    return hashes, np.searchsorted(which, np.arange(len(sizes) + 1))


def band_hashes(hashes: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of each (non-empty) set: an array documents x bands."""
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(off) - 1, bands), dtype=np.uint64)
    for b in range(bands):
        total = np.full(len(off) - 1, b + 1, dtype=np.uint64)
        for r in range(rows):
            total = K.mix(total + np.minimum.reduceat(hashes * mult[b, r], off[:-1]))
        out[:, b] = total
    return out


def signatures(base: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(key, tag, c1, c2, bands) of every document that has words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, off in K.slices(batch.column("text")):
                hashes, begin = ngram_sets(raw, off, n)
                some = np.flatnonzero(np.diff(begin))
                if not len(some):
                    continue
                edge = np.append(begin[some], len(hashes))
                c1 = np.add.reduceat(K.mix(hashes + np.uint64(1)), edge[:-1])
                c2 = np.add.reduceat(K.mix(hashes * K.BASE + np.uint64(2)), edge[:-1])
                at = pa.array(some + row)
                band = band_hashes(hashes, edge, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(at), batch.column("tag").take(at), pa.array(K.signed(c1)), pa.array(K.signed(c2)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(K.signed(band.ravel())))],
                    ["key", "tag", "c1", "c2", "bands"])

    return base.where(has_id()).select("key", "tag", "text").mapInArrow(
        emit, "key bigint, tag bigint, c1 bigint, c2 bigint, bands array<bigint>")


def with_sets(members: DataFrame, n: int) -> DataFrame:
    """The n-gram set of each member, in place of its text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, raw, off in K.slices(batch.column("text")):
                hashes, begin = ngram_sets(raw, off, n)
                sets += [hashes[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
            rest = [batch.column(x) for x in ("id", "root", "parts", "copies", "bands")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], ["id", "root", "parts", "copies", "bands", "set"])

    pair = "struct<key:bigint,tag:bigint>"
    return members.mapInArrow(emit, f"id {pair}, root {pair}, parts int, copies bigint, bands array<bigint>, set binary")


def linked(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of verified links.  side: 0, 1, or 2 where both sides
    are the same block; only pairs across sides count."""
    m = len(sets)
    near = np.zeros((m, m), dtype=bool)
    for b in range(bands.shape[1]):
        near |= bands[:, b, None] == bands[None, :, b]
    near &= (side[:, None] != side[None, :]) | (side == 2)[:, None]
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return near
    sizes = np.array([len(x) for x in sets])
    values, inverse, count = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    keep = common[inverse]
    r, c = np.repeat(np.arange(len(rows)), sizes[rows])[keep], column[inverse[keep]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    both = np.zeros((len(rows), len(rows)), dtype=np.float64)
    for low in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(c, [low, low + 4096])
        one = np.zeros((len(rows), 4096), dtype=np.float32)
        one[r[a:b], c[a:b] - low] = 1
        both += one @ one.T
    union = sizes[rows][:, None] + sizes[rows][None, :] - both
    near[np.ix_(rows, rows)] &= both >= threshold * union - 1e-9
    return near


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a boolean matrix."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """One row per class and block pair: linked documents, local root."""

    def one(table: pa.Table) -> pa.Table:
        # the smaller class first, so that a local root is the smallest
        ids = table.column("id").combine_chunks()
        order = np.lexsort((ids.field("tag").to_numpy(), ids.field("key").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        ids, side = table.column("id").chunk(0), table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        bands = table.column("bands").chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        links = linked(sets, bands, side, threshold)
        root = pa.array(local_roots(links))
        return pa.table({"id": ids, "links": pa.array((links @ copies).astype(np.int64)), "to": ids.take(root)})

    pair = "struct<key:bigint,tag:bigint>"
    return blocks.groupBy("root", "i", "j").applyInArrow(one, f"id {pair}, links bigint, to {pair}")


def joined(base: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """(key, tag, class_id, n_links) of every document with words and id."""
    bands, rows = choose_bands(threshold, recall)
    sigs = written(signatures(base, n, bands, rows), "signatures")
    classes = written(sigs.groupBy("c1", "c2").agg(F.min(F.struct("key", "tag")).alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    rep = sigs.select(F.struct("key", "tag").alias("id"), "bands").dropDuplicates(["id"])
    rep = written(rep.join(classes.select("id", "copies"), "id"), "representatives")
    slots = rep.select("id", F.explode("bands").alias("slot"))
    buckets = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("v")).where("c > 1").select("slot", "v")
    stars = slots.join(written(buckets, "buckets"), "slot").where("id != v").select(F.col("id").alias("u"), "v").distinct()
    roots = components(stars)
    groups = roots.unionByName(roots.select(F.col("v").alias("u"), "v").distinct())
    sizes = written(groups.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "sizes")
    members = groups.join(sizes, "v").select(F.col("u").alias("id"), F.col("v").alias("root"), "parts")
    members = members.join(rep, "id").withColumns({"key": F.col("id.key"), "tag": F.col("id.tag")})
    text = base.dropDuplicates(["key", "tag"]).select("key", "tag", "text")
    members = text.join(members, ["key", "tag"]).select("id", "root", "parts", "copies", "bands", "text")
    block = F.pmod(F.xxhash64("id"), "parts").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least(x, block).alias("i"), F.greatest(x, block).alias("j"),
        F.when(x == block, 2).when(x > block, 0).otherwise(1).alias("side")))
    blocks = with_sets(members, n).withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair", "parts")
    found = written(verified(blocks, threshold), "verified")
    roots = components(found.select(F.col("id").alias("u"), F.col("to").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    links = links.join(roots.select(F.col("u").alias("id"), F.col("v").alias("to")), "id", "left")
    result = classes.join(links, "id", "left").select(
        "c1", "c2", F.coalesce("to.key", "id.key").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("to", "id").alias("stays"))
    result = written(result, "class-links")
    return sigs.select("key", "tag", "c1", "c2").join(result, ["c1", "c2"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links): each row's near-duplicate class, named by its
    smallest id, and the number of rows at the threshold or above."""
    base = keyed(docs, id_col, text_col)
    found = joined(base, n, threshold, recall)
    every = base.where(~has_id() | ~F.col("text").rlike(WORD)).select(
        F.when(has_id(), F.col("key")).alias(id_col), F.when(has_id(), F.col("key")).alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return found.select(F.col("key").alias(id_col), "class_id", "n_links").unionByName(every)


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM,
                  threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The input's rows with all but the smallest document of each
    near-duplicate class removed; rows without words or id stay."""
    base = keyed(docs, id_col, text_col)
    found = joined(base, n, threshold, recall)
    gone = found.where(F.col("stays") != F.struct("key", "tag")).select("key", "tag").distinct()
    left = base.join(gone, ["key", "tag"], "left_anti")
    # repeated rows of the document that stays are copies too
    worded = has_id() & F.col("text").rlike(WORD)
    kept = left.where(worded).dropDuplicates(["key", "tag"]).unionByName(left.where(~worded))
    return unkeyed(kept, docs, text_col, None)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id and number of links of every document."""
    return jaccard_join(documents(spark, sf_dir))
