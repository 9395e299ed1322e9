"""Vector code compression: product codes by member-resident Lloyd rounds.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook.  The first shuffle deals each part to its owner, the
partition of (position, entry, salt).  From then on a round is

* update: each task adds up the members that reside with it, one row per
  owner; their sums over salts, one number per codebook component, are the
  next codebook (floored means; unused entries stay);
* assign: each task assigns its resident members anew, without a shuffle;
* migrate: only the parts that change their entry are shuffled, to their new
  owner.

Members reside in files of the shared folder, since Spark keeps no state in
executors that could be lost.  The codebooks (``entries`` times the vector's
length) are all that the driver sees and sends.  The salt spreads an entry
that many equal vectors share; there are more salts the more vectors there
are.

Distances are sums of integer products in doubles, which are exact up to
2**53; components so large that this bound could be passed are an error, as
are vectors of different lengths or of a length that cannot be cut.

Defined results: null vectors and those with null, NaN or infinite components
are dropped; with fewer vectors than entries the codebooks are shorter; rows
with a null id come last in the first codebook, rows that share an id in the
order of their vectors; repeated rows are members each; an empty table gives
an empty table.  Of the input's columns only id is returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.frames import documents, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Vectors per salt, and the least number of salts.
SALT_ROWS = 1 << 16
SALTS = 64

#: Parts whose distances to all entries are held at once.
CHUNK = 4096

MEMBERS = "row bigint, position int, entry int, part array<int>"


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """row, id, label and the integer components of the vectors kept."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(vector.isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("id"),
                       F.col(f"`{label_col}`").alias("label"), whole.alias("whole"))


def nearest(book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; ties go to the lower entry."""
    entry, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    norms = (book * book).sum(axis=1)
    for low in range(0, len(parts), CHUNK):
        own = parts[low : low + CHUNK]
        to = norms - 2.0 * (own @ book.T)
        best = to.argmin(axis=1)
        entry[low : low + CHUNK] = best
        distance[low : low + CHUNK] = to[np.arange(len(own)), best] + (own * own).sum(axis=1)
    return entry, distance


def matrix(column, width: int) -> np.ndarray:
    """A list column of equal sizes as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of integers as a list column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1).astype(np.int32)))


def dealt(members: DataFrame, salts: int) -> DataFrame:
    """Parts sent to their owners, the partitions of (position, entry, salt)."""
    return members.repartition("position", "entry", F.pmod("row", F.lit(salts)))


def split_parts(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """One member per vector and position, with its first entry."""
    parts, _, width = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column("whole"), parts * width)
            for position, book in enumerate(shared.value):
                own = whole[:, position * width : (position + 1) * width]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(np.full(len(own), position, np.int32)),
                     pa.array(nearest(book, own)[0].astype(np.int32)), lists(own)], ["row", "position", "entry", "part"])

    return kept.select("row", "whole").mapInArrow(emit, MEMBERS)


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Resident members with their ``entry`` by the present codebooks, the one
    they reside with (``home``) and their distance."""
    width = books.shape[2]
    shared = members.sparkSession.sparkContext.broadcast(books)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            part = matrix(batch.column("part"), width)
            entry, distance = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in np.unique(position).tolist():
                mine = np.flatnonzero(position == p)
                entry[mine], distance[mine] = nearest(shared.value[p], part[mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("position"), pa.array(entry.astype(np.int32)), batch.column("part"),
                 batch.column("entry"), pa.array(distance)], ["row", "position", "entry", "part", "home", "distance"])

    return members.mapInArrow(emit, MEMBERS + ", home int, distance bigint")


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: owners' floored means of their members."""
    parts, entries, width = books.shape

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            owner = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            part = matrix(batch.column("part"), width)
            order = np.argsort(owner, kind="stable")
            own, first = np.unique(owner[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(part[order].astype(np.int64), first, axis=0)
                counts += np.bincount(owner, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]),
             pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].reshape(-1)))],
            ["owner", "n", "sums"])

    partial = members.select("position", "entry", "part").mapInArrow(emit, "owner bigint, n bigint, sums array<bigint>")
    each = partial.select("owner", "n", F.posexplode("sums").alias("at", "total"))
    out = books.reshape(parts * entries, width).copy()
    for r in each.groupBy("owner", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.owner, r["at"]] = r.total // r.n  # one row per codebook component
    return out.reshape(books.shape)


def first_books(kept: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the least ids."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    whole = np.array([r.whole for r in first], dtype=np.float64).reshape(len(first), parts, width)
    return np.ascontiguousarray(whole.transpose(1, 0, 2))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, ``code``, ``error``, ``label_error`` of every vector kept; the
    codebooks: part by entry by component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's part has two hex digits: 1 to 256 entries")
    kept = written(scaled(vectors, id_col, vector_col, label_col, scale), "vectors")
    size = F.size("whole")
    reach = F.greatest(F.abs(F.array_max("whole")), F.abs(F.array_min("whole")))
    stats = kept.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.max(reach).alias("reach")).first()
    if not stats.n:
        empty = kept.select("id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
        return empty.withColumnRenamed("id", id_col), np.zeros((parts, 0, 0))
    if stats.least != stats.most or stats.most % parts:
        raise ValueError(f"vectors of {stats.least} to {stats.most} components cannot be cut into {parts} equal parts")
    width = stats.most // parts
    if 4 * width * (stats.reach or 0) ** 2 >= 1 << 53:
        raise ValueError(f"components up to {stats.reach} (scaled) have squared distances beyond 2**53")
    salts = max(SALTS, -(-stats.n // SALT_ROWS))
    books = first_books(kept, parts, entries, width)
    members = written(dealt(split_parts(kept, books), salts), "members")
    for _ in range(rounds):
        books = updated(members, books)
        seen = written(assigned(members, books), "assigned")
        moved = seen.where("entry != home")
        migrated = written(dealt(moved.select(members.columns), salts), "migrated")
        members = seen.where("entry = home").select(members.columns).unionByName(migrated)
    code = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("entry"))))), 2, "0") for p in range(parts)]
    codes = seen.groupBy("row").agg(F.concat(*code).alias("code"), F.sum("distance").alias("error"))
    codes = written(kept.select("row", "id", "label").join(codes, "row").drop("row"), "codes")
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = codes.alias("c").join(labels.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.astype(np.int64).reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with their errors and the codebooks' digest."""
    codes, books = vector_codes(documents(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _op13_sql() -> str:
    """The registered query in DuckDB SQL: a chain of rounds.  An entry and
    its distance are found as one number, distance * 256 + entry."""
    near = """near_{i} AS MATERIALIZED (
  SELECT row, pos, (m - 256 * floor(m / 256))::BIGINT AS e, (floor(m / 256) + pp)::BIGINT AS d FROM (
    SELECT p.row, p.pos, any_value(p.pp) AS pp, min(256 * (b.cc - 2 * list_inner_product(p.part, b.part)) + b.e) AS m
    FROM parts p JOIN book_{i} b USING (pos) GROUP BY p.row, p.pos))"""
    book = """book_{j} AS MATERIALIZED (
  SELECT pos, e, part, list_inner_product(part, part) AS cc FROM (
    SELECT b.pos, b.e, coalesce(u.part, b.part) AS part FROM book_{i} b LEFT JOIN (
      SELECT pos, e, list(x ORDER BY k) AS part FROM (
        SELECT pos, e, k, floor(sum(x) / count(*)) AS x FROM (
          SELECT pos, e, unnest(part) AS x, unnest(range(len(part))) AS k FROM parts JOIN near_{i} USING (row, pos)) GROUP BY pos, e, k)
      GROUP BY pos, e) u USING (pos, e)))"""
    steps = [x.format(i=i, j=i + 1) for i in range(ROUNDS) for x in (near, book)] + [near.format(i=ROUNDS)]
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT *, list_inner_product(part, part) AS pp FROM (
    SELECT row, pos, v[pos * len(v) // {PARTS} + 1 : (pos + 1) * len(v) // {PARTS}] AS part FROM (SELECT row, v, unnest(range({PARTS})) AS pos FROM kept))),
book_0 AS MATERIALIZED (
  SELECT pos, e, part, pp AS cc FROM parts JOIN (
    SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (row)),
{", ".join(steps)},
codes AS (
  SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM near_{ROUNDS} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY pos, e, k)) AS codebooks_sha256
  FROM (SELECT pos, e, unnest(part) AS x, unnest(range(len(part))) AS k FROM book_{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row) CROSS JOIN digest"""


OP13_SQL = _op13_sql()
