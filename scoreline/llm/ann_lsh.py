"""Nearest neighbours by multiprobe p-stable hashing, reranked exactly.

Each of ``TABLES`` tables hashes a vector by ``HASHES`` Gaussian projections,
cut into cells of one width.  A query visits, in every table, its own bucket
and then perturbed ones (a neighbouring cell in some projections) in the order
of their expected success.  The order over ranks of a query's 2 * HASHES
distances to cell borders is worked out once, from the expected distances.

Fitting uses a bounded sample (``SAMPLE`` rows, ``SAMPLE_QUERIES`` of them as
queries): the cell width follows its neighbour distances, and the number of
probes is the least that finds ``target`` of its true neighbours.  All rows
are indexed and all queries searched.  A query that meets fewer than ``k``
rows in its buckets is searched against all rows, in blocks.

Buckets are dealt to parts of about ``PART_ROWS`` rows, and a bucket of more
than ``SALT_ROWS`` rows is cut into several that its queries all visit.  Inside
a part distances are taken in bounded blocks and only each query's ``k`` best
leave it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import stored

TABLES, HASHES, TARGET = 8, 8, 0.985
SAMPLE, SAMPLE_QUERIES = 20_000, 200
PART_ROWS, SALT_ROWS = 20_000, 4_000
BLOCK = 1 << 22                       # numbers in one block of differences


def probe_order(hashes: int) -> np.ndarray:
    """Every perturbation, best first, as rows of 0/1 over the ranks of a query's
    border distances; rank r and rank 2 * hashes - 1 - r are one projection."""
    m, n = hashes, 2 * hashes
    j = np.arange(1, n + 1, dtype=float)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, far)
    heap, out = [(cost[0], (0,))], [np.zeros(n, np.int8)]
    while heap:
        score, ranks = heapq.heappop(heap)
        if all(n - 1 - r not in ranks for r in ranks):
            row = np.zeros(n, np.int8)
            row[list(ranks)] = 1
            out.append(row)
        last = ranks[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            if all(n - 1 - r not in ranks for r in ranks):
                heapq.heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
    return np.array(out)


class Tables:
    """The fitted projections: what a worker needs to hash rows and queries."""

    def __init__(self, dim: int, width: float, probes: int, tables: int = TABLES, hashes: int = HASHES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(tables, hashes, dim))
        self.shift = rng.uniform(0, 1, size=(tables, hashes))
        self.salt = rng.integers(1, 2**62, size=(tables, hashes), dtype=np.int64) | 1
        self.width, self.order = width, probe_order(hashes)[:probes].astype(np.int64)

    def cells(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and places inside the cells, from 0 to 1."""
        at = vectors @ self.lines[table].T / self.width + self.shift[table]
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def key(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (cells * self.salt[table]).sum(-1) + (table + 1) * np.int64(0x5851F42D4C957F2D)
            mixed ^= mixed >> 29
            return mixed * np.int64(0x369DEA0F31A53F85)

    def steps(self, place: np.ndarray) -> np.ndarray:
        """(queries, probes, hashes) moves of -1, 0 or 1 cell, best first."""
        h = place.shape[1]
        border = np.concatenate([place, 1 - place], 1)             # to the cell below, to the one above
        order = np.argsort(border, 1, kind="stable")
        sign = np.where(order < h, -1, 1)
        move = np.zeros((len(place), 2 * h, h), np.int64)
        np.put_along_axis(move, (order % h)[:, :, None], sign[:, :, None], 2)
        return self.order @ move

    def query_keys(self, vectors: np.ndarray) -> np.ndarray:
        keys = []
        for t in range(len(self.lines)):
            cell, place = self.cells(vectors, t)
            keys.append(self.key(cell[:, None, :] + self.steps(place), t))
        return np.concatenate(keys, 1)

    def row_keys(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([self.key(self.cells(vectors, t)[0], t) for t in range(len(self.lines))], 1)


def fit(sample: np.ndarray, k: int, target: float = TARGET) -> Tables:
    """Cell width and number of probes from a sample of vectors."""
    dim = sample.shape[1]
    asked = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    if len(sample) < 3:
        return Tables(dim, 1.0, 1)
    square = (asked**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * asked @ sample.T
    near = np.argsort(square, 1)[:, 1:k + 1]                         # the nearest is the query itself
    dist = np.sqrt(np.maximum(np.take_along_axis(square, near, 1), 0))
    width = 1.35 * float(np.median(dist[:, -1])) or 1.0
    every = len(probe_order(HASHES))
    while True:
        tables = Tables(dim, width, every)
        rank = np.full(near.shape, every)
        for t in range(TABLES):
            cell, place = tables.cells(asked, t)
            own = tables.key(cell[:, None, :] + tables.steps(place), t)
            theirs = tables.key(tables.cells(sample, t)[0], t)[near]
            for q in range(len(asked)):
                order = np.argsort(own[q])
                at = np.minimum(np.searchsorted(own[q][order], theirs[q]), every - 1)
                hit = own[q][order][at] == theirs[q]
                rank[q] = np.minimum(rank[q], np.where(hit, order[at], every))
        need = int(np.sort(rank.ravel())[math.ceil(target * rank.size) - 1]) + 1
        if need <= every:
            return Tables(dim, width, need)
        width *= 1.25


def nearest(ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray,
            q_keys: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance): each query's ``k`` nearest rows among those with
    one of its keys, rows of the query's own id left out."""
    order = np.lexsort((ids, keys))
    ids, vectors, keys = ids[order], vectors[order], keys[order]
    asked = np.repeat(np.arange(len(q_ids)), [len(x) for x in q_keys])
    flat = np.concatenate(q_keys) if q_keys else np.empty(0, np.int64)
    order = np.argsort(flat, kind="stable")
    asked, flat = asked[order], flat[order]
    buckets, lo = np.unique(flat, return_index=True)
    hi = np.append(lo[1:], len(flat))
    a, b = np.searchsorted(keys, buckets), np.searchsorted(keys, buckets, "right")
    found = []
    for i in np.flatnonzero(b > a):
        rows = vectors[a[i]:b[i]]
        items, first = np.unique(ids[a[i]:b[i]], return_index=True)
        step = max(1, BLOCK // rows.size)
        for s in range(lo[i], hi[i], step):
            q = asked[s:min(s + step, hi[i])]
            dist = np.sqrt(((q_vectors[q][:, None, :] - rows) ** 2).sum(2))
            if len(items) < len(rows):                               # one column for an id: its smallest distance
                dist = np.minimum.reduceat(dist, first, 1)
            dist[q_ids[q][:, None] == items] = np.inf
            if dist.shape[1] > 4 * k:                                # all up to the k-th distance, ties too
                cut = np.partition(dist, k, 1)[:, k]
                x, y = np.nonzero((dist <= cut[:, None]) & np.isfinite(dist))
            else:
                x, y = np.nonzero(np.isfinite(dist))
            found.append((q[x], items[y], dist[x, y]))
    if not any(len(x[0]) for x in found):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, row, dist = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((dist, row, q))                               # one row for an id: its smallest distance
    q, row, dist = q[order], row[order], dist[order]
    once = np.append(True, (q[1:] != q[:-1]) | (row[1:] != row[:-1]))
    q, row, dist = q[once], row[once], dist[once]
    order = np.lexsort((row, dist, q))
    q, row, dist = q[order], row[order], dist[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    best = place < k
    return q_ids[q[best]], row[best], dist[best]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(rows: DataFrame, probes: DataFrame, dim: int, k: int) -> DataFrame:
    """``rows``: part, key, id, vector; ``probes``: part, keys, query_id, vector."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("keys").combine_chunks()
        cuts = keys.offsets.to_numpy()
        flat = keys.values.to_numpy()
        q, row, dist = nearest(left.column("id").to_numpy(), _matrix(left.column("vector"), dim), left.column("key").to_numpy(),
                               right.column("query_id").to_numpy(), _matrix(right.column("vector"), dim),
                               [flat[cuts[i]:cuts[i + 1]] for i in range(len(keys))], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(row, pa.int64()), "score": pa.array(dist, pa.float64())})

    return rows.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def _usable(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): for each row
    that ``is_query`` holds for, its ``k`` nearest found among all other ids.

    Left out: null ids, null, empty or zero vectors, vectors with null or
    non-finite components or of another length than most (ties: the shorter).
    Rows that share an id act as one item at its smallest distance.  Ties go to
    the smaller id.  With fewer than ``k`` other items all are returned; no rows
    give none; extra columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    lengths = base.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = most.dim, most.n
    base = base.where(F.size("vector") == dim)
    drawn = base.select("vector").orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).toArrow()
    tables = fit(_matrix(drawn.column("vector"), dim), k, target)
    parts = max(8, math.ceil(n * TABLES / PART_ROWS))

    def keys(batches, asks: bool):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), dim)
            own = tables.query_keys(matrix) if asks else tables.row_keys(matrix)
            flat = pa.array(own.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), lists], ["id", "vector", "keys"])

    kind = base.schema["vector"].dataType.simpleString()
    schema = f"id bigint, vector {kind}, keys array<bigint>"
    rows = base.select("id", "vector").mapInArrow(lambda b: keys(b, False), schema)
    asked = base.where("asks").select("id", "vector").mapInArrow(lambda b: keys(b, True), schema)
    rows = rows.select("id", "vector", F.explode("keys").alias("key"))
    large = stored(rows.groupBy("key").count().where(F.col("count") > SALT_ROWS)
                   .select("key", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts")), "ann-large")
    part = F.pmod(F.xxhash64("key", "salt"), F.lit(parts)).alias("part")
    salted = rows.join(large, "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    salted = salted.select(part, "key", "id", "vector")
    visits = asked.select(F.col("id").alias("query_id"), F.explode("keys").alias("key")).distinct()
    visits = visits.join(large, "key", "left").select(
        "query_id", "key", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    visits = visits.groupBy("query_id", part).agg(F.collect_list("key").alias("keys"))
    probes = visits.join(base.where("asks").select(F.col("id").alias("query_id"), "vector"), "query_id")
    found = stored(_search(salted, probes, dim, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "ann-found")

    # queries whose buckets hold too few: against all rows, in blocks
    counts = found.groupBy("query_id").count()
    short = base.where("asks").select(F.col("id").alias("query_id"), "vector").join(counts, "query_id", "left")
    short = stored(short.where(F.coalesce("count", F.lit(0)) < k).drop("count"), "ann-short")
    lacking = short.count()
    if lacking:
        blocks, groups = max(1, math.ceil(n / PART_ROWS)), max(1, math.ceil(lacking / 1000))
        at = lambda block, group: (block * groups + group).alias("part")
        all_rows = base.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
                               F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        all_rows = all_rows.select(at(F.col("block"), F.col("group")), F.lit(0).cast("bigint").alias("key"), "id", "vector")
        each = short.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        each = each.select(at(F.col("block"), F.col("group")), F.array(F.lit(0).cast("bigint")).alias("keys"), "query_id", "vector")
        whole = _search(all_rows, each, dim, k)
        found = (found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)
                 .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
