"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. Fingerprint every text (one Arrow pass; bit counts over its shingles).
2. Equal fingerprints are one class with its smallest id.
3. A vantage-point tree, grown on a bounded sample of fingerprints, cuts all
   fingerprints into shards: at each node those at most ``m`` bits from the
   vantage point go in, those further go out, and the ones less than ``radius``
   beyond ``m`` go both ways.  By the triangle inequality two fingerprints
   within ``radius`` of each other then share a shard.
4. Inside a shard the tree goes on to small leaves, whose pairs are compared
   exactly, in blocks.  Only a spanning forest of the links leaves the shard,
   so a tight group of n fingerprints gives n - 1 links, not n * n.
5. Links between classes are merged to components by repeated minimum and
   pointer jumping; each round is written to the shared folder.

The sample only shapes the tree (balance), never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import UPPER, partitions, plain, small_batches, stored

SHINGLE, RADIUS, SEED = 3, 2, 42
#: fingerprints drawn to grow the shard tree; fingerprints aimed at in a shard;
#: fingerprints compared all with all in a leaf
SAMPLE, SHARD, LEAF = 100_000, 20_000, 512
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_BITS = 64


def text_fingerprint(raw: bytes, shingle: int = SHINGLE, block: int = 1 << 15) -> int:
    """The SimHash of UTF-8 bytes as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest
    words = raw.translate(_LOWER).split()      # bytes.split cuts at exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    a, b = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:][:n].tolist()
    counts = np.zeros(_BITS, np.int64)
    for k in range(0, n, block):
        hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a[k:k + block], b[k:k + block])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint, tie bigint: a hash of the text) of every row, over the whole
    text; null text is empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64)), batch.column("tie")], ["id", "fp", "tie"])

    text = F.encode(F.coalesce(plain(text_col), F.lit("")), "UTF-8")
    rows = docs.select(plain(id_col).alias("id"), text.alias("text"), _text_hash(text_col).alias("tie"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, tie bigint")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(plain(text_col), F.lit("")))


def _vantage(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int, np.ndarray] | None:
    """Of a few candidates the vantage point whose two sides are smallest when
    counted with their overlap; None if no cut makes both smaller."""
    best = None
    for at in np.linspace(0, len(points) - 1, tries).astype(int):
        dist = np.bitwise_count(points ^ points[at])
        have = np.bincount(dist, minlength=_BITS + 1)
        upto = np.cumsum(have)
        inside = upto[np.minimum(np.arange(_BITS + 1) + RADIUS, _BITS)]
        outside = len(points) - upto
        cost = inside.astype(float) ** 1.5 + outside.astype(float) ** 1.5
        m = int(np.argmin(cost))
        if inside[m] < len(points) and outside[m] < len(points) and (best is None or cost[m] < best[0]):
            best = (cost[m], points[at], m, dist)
    return best and best[1:]


def grow_tree(sample: np.ndarray, leaf: int, shard: int = 0) -> tuple:
    """Nodes ``(vantage, m, inside, outside)`` with shard numbers as leaves."""
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray):
        cut = _vantage(points) if len(points) > leaf else None
        if cut is None:
            return next(numbers)
        point, m, dist = cut
        return point, m, grow(points[dist <= m + RADIUS]), grow(points[dist > m])

    return grow(sample)


def route(tree, fps: np.ndarray, index: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in ``fps``) for all shards that ``fps`` belong to."""
    index = np.arange(len(fps)) if index is None else index
    if not len(index):
        return
    if not isinstance(tree, tuple):
        yield tree, index
        return
    point, m, inside, outside = tree
    dist = np.bitwise_count(fps[index] ^ point)
    yield from route(inside, fps, index[dist <= m + RADIUS])
    yield from route(outside, fps, index[dist > m])


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def shard_links(points: np.ndarray, leaf: int = LEAF, radius: int = RADIUS) -> np.ndarray:
    """A spanning forest, as pairs of positions, of the graph that links distinct
    ``points`` at most ``radius`` bits apart."""
    parent = np.arange(len(points))
    links: list[tuple[int, int]] = []
    todo = [np.arange(len(points))]
    while todo:
        index = todo.pop()
        cut = _vantage(points[index], 4) if len(index) > leaf else None
        if cut is not None:
            _, m, dist = cut
            todo += [index[dist <= m + RADIUS], index[dist > m]]
            continue
        own = points[index]
        for k in range(0, len(own), leaf):                # in blocks: leaf x n at a time
            near = np.bitwise_count(own[k:k + leaf, None] ^ own[None, k:]) <= radius
            a, b = np.nonzero(np.triu(near, 1))
            for i, j in zip(index[a + k].tolist(), index[b + k].tolist()):
                p, q = _find(parent, i), _find(parent, j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((i, j))
    return np.array(links, np.int64).reshape(-1, 2)


def class_links(classes: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``, a spanning forest of
    each shard's links."""
    total = classes.count()
    drawn = classes.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect()
    points = np.array([r.fp for r in drawn], np.int64).view(np.uint64)
    tree = grow_tree(points, max(32, math.ceil(shard * len(points) / max(total, 1))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, at in route(tree, fps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int64)),
                                                  pa.array(fps[at].view(np.int64))], ["shard", "fp"])

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(rows["fp"].to_numpy(np.int64))
        pairs = shard_links(fps.view(np.uint64))
        return pd.DataFrame({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})

    return (classes.select("fp").mapInArrow(spread, "shard bigint, fp bigint")
            .groupBy("shard").applyInPandas(links, "a bigint, b bigint").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node
    that can be reached."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "simhash-links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "simhash-roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = roots.join(near, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        # pointer jumping: the root's own new root, and the old root learns it too
        told = low.groupBy(F.col("was").alias("node")).agg(F.min("low").alias("told"))
        hop = stored(low.join(told, "node", "left").select(
            "node", "was", F.least("low", F.coalesce("told", "low")).alias("low")), "simhash-hop")
        jump = hop.select(F.col("node").alias("low"), F.col("low").alias("far"))
        after = stored(hop.join(jump, "low").select("node", "was", F.col("far").alias("root")), "simhash-roots")
        roots = after.select("node", "root")
        if after.where("root != was").isEmpty():
            return roots


def _with_component(prints: DataFrame) -> DataFrame:
    """``prints`` (id, fp, ...) with the component_id of each fingerprint."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    linked = components(class_links(classes))
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    heads = named.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(named.join(heads, "root").select("fp", "root", "component_id"), "simhash-named")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id in the component of texts linked by
    fingerprints that differ in at most two bits.  Rows without words have the
    fingerprint zero and link like any other.  Null ids get their component's
    id but never name one (a component of null ids alone: null).  Repeated rows
    come back as often as they came; extra columns are ignored; no rows give
    none.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle).select("id", "fp"), "simhash-prints")
    return _with_component(prints).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id, of rows with
    that id the one of the smallest text hash, once if it is repeated.  Rows with
    a null id stay, each.  Null text is empty; texts without words are alike.
    All columns stay, of any type and name; no rows give none."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    named = _with_component(prints).where("id is not null")
    heads = named.groupBy("root").agg(F.min(F.struct("id", "tie")).alias("head")).select("head.id", "head.tie")
    rows = docs.select(F.struct(*map(plain, docs.columns)).alias("row"), plain(id_col).alias("id"), _text_hash(text_col).alias("tie"))
    left = rows.join(heads, ["id", "tie"], "left_semi")
    again = F.row_number().over(Window.partitionBy("id", "tie").orderBy("id"))
    left = left.withColumn("again", again).where(F.col("again") == 1).select("row.*")
    return left.union(docs.where(plain(id_col).isNull()))
