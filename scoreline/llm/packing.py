"""Packing into optimal length buckets.

1. One aggregation gives the histogram of the lengths themselves over all rows:
   one entry for each distinct length.
2. Dynamic programming over the histogram chooses the bucket boundaries with
   the least padding: with bucket ends e, sum(count * (e - length)).  The best
   last bucket for each end is the lowest of a set of lines, kept as a hull, so
   a round over D lengths costs D steps.
3. Rows are batched inside their bucket: a batch holds as many rows as the
   token budget has room for at the bucket's end (one, if a row is longer).
   A bucket of many rows is dealt into groups by a hash of the row first, as
   many as the histogram says it needs, and each group is numbered by itself.
"""

from __future__ import annotations

import math
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import hashable, plain

BUCKETS, TOKEN_BUDGET = 16, 65_536
GROUP_ROWS = 8_192


def word_tokens(text: Column) -> Column:
    """Words of a text and one end mark."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def best_ends(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """At most ``buckets`` ends out of the ascending lengths of ``histogram``
    (length, count) with the least padding; of equal ones those with later
    starts of the last buckets."""
    lengths = [x for x, _ in histogram]
    n = len(lengths)
    if n <= buckets:
        return lengths
    count, total = [0], [0]
    for x, c in histogram:
        count.append(count[-1] + c)
        total.append(total[-1] + c * x)
    best = [0] + [math.inf] * n                        # rows up to i, in the buckets so far
    came: list[array] = []
    for _ in range(buckets):
        now, via = [math.inf] * (n + 1), array("q", bytes(8 * n + 8))
        hull: list[tuple[int, float, int]] = []        # lines slope * x + offset, steepest fall last
        at = 0
        for j in range(1, n + 1):
            i = j - 1                                  # the last bucket may start after i
            if best[i] < math.inf:
                line = (-count[i], best[i] + total[i], i)
                while len(hull) > at + 1 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if hull:
                now[j] = x * count[j] - total[j] + hull[at][0] * x + hull[at][1]
                via[j] = hull[at][2]
        best = now
        came.append(via)
    ends, j = [], n
    for via in reversed(came):
        if j:
            ends.append(lengths[j - 1])
            j = via[j]
    return ends[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Every row of ``docs`` with all its columns and: n_tokens (``length``, null
    as 0), bucket (from 0), pad_to (the bucket's end), batch_id, slot (from 0).

    Rows follow each other by id (nulls first) and a hash of the row.  Rows of
    equal length share a bucket; a row longer than the budget is a batch alone;
    repeated rows are packed each.  Columns may be of any type and name; those
    that carry one of the new names are replaced; no rows give none.  The
    histogram on the driver has one entry for each distinct length, so at most
    as many as the longest text has tokens.
    """
    new = ("n_tokens", "bucket", "pad_to", "batch_id", "slot")
    keep = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*map(plain, keep)).alias("row"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n"),
                       plain(id_col).alias("id"), F.xxhash64(*hashable(docs, keep)).alias("tie"))
    histogram = [(r.size, r.rows) for r in rows.groupBy(F.col("n").alias("size"))
                 .agg(F.count("*").alias("rows")).orderBy("size").collect()]
    ends = best_ends(histogram, buckets) or [0]
    held = [sum(c for x, c in histogram if x <= e and (i == 0 or x > ends[i - 1])) for i, e in enumerate(ends)]
    groups = F.array(*[F.lit(max(1, math.ceil(c / GROUP_ROWS))) for c in held])
    sizes = F.array(*[F.lit(e).cast("bigint") for e in ends])
    # the length is an argument, so that it is not worked out again for each end
    below = F.transform(F.array("n"), lambda n: F.size(F.filter(sizes, lambda e: e < n)))
    rows = rows.withColumn("bucket", F.coalesce(F.get(below, F.lit(0)), F.lit(0)))
    rows = rows.withColumn("group", F.pmod(F.col("tie"), F.get(groups, F.col("bucket"))).cast("int"))
    number = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("id", "tie")).cast("bigint") - 1
    numbered = rows.withColumn("number", number)
    if max(held, default=0) > GROUP_ROWS:
        before = Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("bucket", "group").agg(F.count("*").alias("held")).select(
            "bucket", "group", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
        numbered = numbered.join(starts, ["bucket", "group"], "left").withColumn("number", F.col("number") + F.col("start"))
    pad = F.get(sizes, F.col("bucket"))
    room = F.greatest(F.floor(F.lit(token_budget) / F.greatest(pad, F.lit(1))), F.lit(1)).cast("int")
    batch = F.concat_ws("-", F.col("bucket"), F.floor(F.col("number") / room))
    return numbered.select("row.*", F.col("n").alias("n_tokens"), "bucket", pad.alias("pad_to"), batch.alias("batch_id"),
                       F.pmod(F.col("number"), room).cast("int").alias("slot"))
