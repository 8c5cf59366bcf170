"""Shared helpers of the training-data operators: tables, scratch folders,
Arrow batch bounds and skew-proof range buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return scratch_path(spark, label)


def plain(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def hashable(df: DataFrame, names: list[str]) -> list[Column]:
    """The named columns as a hash takes them: those that hold a map as JSON."""
    return [F.to_json(F.struct(plain(c).alias("v"))) if _holds_map(df.schema[c].dataType) else plain(c) for c in names]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once into the shared folder and read back: cuts the lineage, and a
    lost executor costs no recomputation."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that one Arrow batch hands to a Python worker; whole
    texts would otherwise come 10,000 at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def range_bounds(df: DataFrame, cols: list[str], buckets: int, per_bucket: int = 20) -> list[tuple]:
    """Rows of ``df`` that cut it into about equal ranges by ``cols`` (nulls
    first).  Drawn from a sample of ``buckets * per_bucket`` rows; the sample
    only balances the work, it decides no result.  A heavy key is cut wherever
    a later column differs."""
    order = F.xxhash64(*cols, F.monotonically_increasing_id())
    rows = df.select(*cols).orderBy(order).limit(buckets * per_bucket).collect()
    keys = sorted({tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows},
                  key=lambda t: [(v is not None, v if v is not None else 0) for v in t])
    step = max(1, len(keys) / buckets)
    picked = [keys[int(i * step)] for i in range(1, buckets) if int(i * step) < len(keys)]
    return list(dict.fromkeys(picked))


def range_bucket(df: DataFrame, cols: list[str], bounds: list[tuple]) -> Column:
    """How many of ``bounds`` are not above the row's ``cols``: a binary search
    written with column functions."""
    if not bounds:
        return F.lit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    cut = F.array(*[F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(cols, b)])
                    for b in bounds])
    key = F.struct(*cols)

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a.lo + a.hi, 1)
        step = F.when(F.get(cut, mid) <= key, F.struct((mid + 1).alias("lo"), a.hi.alias("hi"))) \
            .otherwise(F.struct(a.lo.alias("lo"), mid.alias("hi")))
        return F.when(a.lo >= a.hi, a).otherwise(step)

    steps = math.ceil(math.log2(len(bounds) + 1))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve).lo
