"""Readers for the driver's parquet tables and the contest adapter over them.

The adapter turns ``lineitem`` into a match feed and ``customer`` into pool
picks (one pick per customer).  Only the columns used are selected so the
parquet scan prunes everything else; the adapter is a pure projection plus
one filter, so it stays inside one whole-stage-codegen span with no shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Fixed values of the adapter: competition codes by key residue and the
# number of team slots per competition.
ADAPTER_CODES = ("UCL", "UEL", "UECL")   # l_orderkey % 3 = 0, 1, 2
ADAPTER_TEAM_SLOTS = 36
ADAPTER_NULL_GOAL_EVERY = 97
ADAPTER_PICK_SLOTS = 40


#: session setting: partitions to deal small scans out to (absent: as scanned)
SCAN_PARTITIONS = "scoreline.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out to as many partitions as the session's
    ``scoreline.scan.partitions`` says, for CPU-heavy row-wise work on a file
    that one task would read alone (one large row group).  Without the setting,
    as on any large input, the scan stays as it is and no shuffle is added."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def dealt_out(df: DataFrame) -> DataFrame:
    """``spread``, and without the setting into as many partitions as the optimizer
    makes of the rows' size, by the hash of their values: a large file may be one
    row group, which one task would read and work on alone."""
    return spread(df) if df.sparkSession.conf.get(SCAN_PARTITIONS, None) else df.repartition(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _text(c: Column) -> Column:
    return c.cast("string")


def match_feed_columns(li: DataFrame) -> DataFrame:
    """Adapter projection, keeping the lineitem keys for ordering/tie-breaks."""
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    comp = (F.when(ok % 3 == 0, F.lit(ADAPTER_CODES[0]))
             .when(ok % 3 == 1, F.lit(ADAPTER_CODES[1]))
             .otherwise(F.lit(ADAPTER_CODES[2])))
    return (
        li.where((sk % ADAPTER_TEAM_SLOTS) != (pk % ADAPTER_TEAM_SLOTS))
        .select(
            F.concat(_text(ok), F.lit("-"), _text(F.col("l_linenumber"))).alias("match_id"),
            comp.alias("competition"),
            F.col("l_shipdate").cast("date").alias("match_date"),
            F.concat(F.lit("T"), _text(sk % ADAPTER_TEAM_SLOTS)).alias("home_team"),
            F.concat(F.lit("T"), _text(pk % ADAPTER_TEAM_SLOTS)).alias("away_team"),
            F.when(ok % ADAPTER_NULL_GOAL_EVERY == 0, F.lit(None).cast("int"))
             .otherwise(F.col("l_quantity").cast("int") % 6).alias("home_goals"),
            ((pk + F.col("l_linenumber")) % 5).cast("int").alias("away_goals"),
            ok.alias("l_orderkey"), F.col("l_linenumber"), pk.alias("l_partkey"),
            sk.alias("l_suppkey"),
        )
    )


def matches(spark: SparkSession, sf_dir: str, keep_keys: bool = False,
            balanced: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Typed match table derived from ``lineitem`` (``balanced``: through
    ``dealt_out``; for CPU-heavy row-wise plans, not for aggregations; ``by``: dealt
    out by these columns while rows are narrow, which a grouping by them reuses)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    if balanced:
        li = dealt_out(li)
    if by:
        li = li.repartition(*by)
    df = match_feed_columns(li)
    if keep_keys:
        return df
    return df.drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool picks ``(jugador, team)`` derived from ``customer``."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.select(
        F.concat(F.lit("J"), _text(F.col("c_nationkey"))).alias("jugador"),
        F.concat(F.lit("T"), _text(F.col("c_custkey") % ADAPTER_PICK_SLOTS)).alias("team"),
    )
