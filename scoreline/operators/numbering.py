"""Distributed numbering: a total order, and positions inside groups, without an
unpartitioned window.

Rows are dealt into ranges of (group, order) by one range exchange, sorted
inside each range and written once with their place in the range.  The rows of
each range (and of each group in it) are counted, the counts are added up
along the ranges, and a row's number is what lies before its range plus its
place.  A group that holds a third of all rows is cut into as many ranges as
it needs; only rows that are equal in every order column stay together, so give
a last column that tells them apart where a key may be hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scoreline.session import scratch_path

_PART, _AT = "__range", "__place"


def _plain(name: str) -> Column:
    return F.col(f"`{name}`")


def number_rows(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "number",
                total: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number from 1 in ``order``, over all rows
    or inside its group of ``by`` columns (null is a group like any other).
    With ``total`` that column holds the rows of the group (``by`` only).

    ``order`` is a list of sort columns (``F.col("x").desc()`` and the like).
    Rows equal in all of them are numbered in some order.  No rows give none.
    Columns called like ``name`` or ``total`` are replaced.
    """
    spark = df.sparkSession
    by = by or []
    df = df.drop(*[c for c in (name, total) if c])
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*[_plain(c).asc_nulls_first() for c in by], *order]
    path = scratch_path(spark, "numbered")
    (df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
       .withColumn(_PART, F.spark_partition_id())
       .withColumn(_AT, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).write.parquet(path))
    placed = StructType([*df.schema.fields, StructField(_PART, IntegerType()), StructField(_AT, LongType())])
    rows = spark.read.schema(placed).parquet(path)
    if not by:
        # one count for each range, so the list is as short as the range exchange is wide
        held = sorted((r[_PART], r["n"]) for r in rows.groupBy(_PART).agg(F.count("*").alias("n")).collect())
        starts, before = [], 0
        for part, n in held:
            starts.append((part, before))
            before += n
        starts = spark.createDataFrame(starts, f"{_PART} int, __before bigint")
        return (rows.join(F.broadcast(starts), _PART)
                    .select(*map(_plain, df.columns), (F.col("__before") + F.col(_AT) + 1).alias(name)))
    groups = [_plain(c).alias(f"__by{i}") for i, c in enumerate(by)]
    slots = [f"__by{i}" for i in range(len(by))]
    parts = rows.groupBy(F.col(_PART).alias("__part"), *groups).agg(F.count("*").alias("__n"), F.min(_AT).alias("__first"))
    along = Window.partitionBy(*slots)
    earlier = along.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *slots, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                         F.sum("__n").over(along).alias("__total"))
    same = reduce(lambda a, b: a & b, [_plain(c).eqNullSafe(F.col(s)) for c, s in zip(by, slots)],
                  F.col(_PART) == F.col("__part"))
    number = (F.col(_AT) - F.col("__first") + F.col("__before") + 1).alias(name)
    out = [F.col("__total").alias(total)] if total else []
    return rows.join(parts, same).select(*map(_plain, df.columns), number, *out)
