"""URL filter: a sort-merge range join of urls with host and path rules.

A rule fits its host and every subdomain of it, where the url's path starts
with the rule's path.  Host labels are reversed and ended by ``#`` (which
neither host nor path can hold), so a rule is a prefix of canonical keys and
becomes the interval [key, key + 0xFF).  Every url gives one key for each
trailing host it could match (no more labels than the longest rule has).
Keys and interval ends are sorted together, and a sweep keeps the stack of
open rules: a running sum gives the depth, and the latest rule opened at that
depth is the stack's top.  Both are window functions.

Sweeps run side by side in ranges of (key, row hash), so a host or a url that
holds a third of all rows is cut as well; a rule is put into every range that
its interval touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import lower_ascii, partitions, range_bounds, range_bucket


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("#"), path).cast("binary")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default_verdict: str = "allow", ranges: int | None = None) -> DataFrame:
    """Judge every row of ``pages``: ``id_col, url, host, path, rule, verdict``.

    ``rules``: host, path, verdict (``allow`` or ``block``).  The longest rule
    (characters of host and path) wins; then the longer host; of two verdicts
    for one (host, path) ``block`` wins.  No rule: ``rule`` is null and the
    verdict ``default_verdict``.

    Null or malformed urls have empty host and path.  Null ids, repeated rows
    and extra columns are fine: each input row gives one output row with the
    named columns only.  Empty pages give no rows; without rules every row
    gets the default.  Null rule fields count as empty, null verdicts as block.
    """
    spark = pages.sparkSession
    ranges = ranges or 2 * partitions(spark)
    clean = (rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"),
                          F.coalesce("verdict", F.lit("block")).alias("verdict"))
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    # two numbers bound what of a url can matter
    deep, far = clean.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    deep, far = deep or 1, far or 0

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.groupBy("id", "url").agg(F.count("*").alias("copies"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    points = (rows.select("*", F.slice(labels, 1, deep).alias("tail"))
              .select("*", F.explode(F.sequence(F.lit(1), F.size("tail"))).alias("n"))
              .select("id", "url", "host", "path", "copies",
                      _key(F.slice("tail", F.lit(1), F.col("n")), F.substring("path", 1, far)).alias("key"),
                      F.xxhash64("id", "url").alias("tie")))
    bounds = range_bounds(points, ["key", "tie"], ranges)
    points = points.select(range_bucket(points, ["key", "tie"], bounds).alias("bucket"), "key",
                           F.lit(1).alias("kind"), "id", "url", "host", "path", "copies",
                           F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias("rule"))

    edge = F.lit(None).cast("bigint")          # nulls sort first: before every point of that key
    opened = clean.select(
        _key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("lo"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("rule"))
    opened = opened.select("lo", F.concat("lo", F.lit(b"\xff")).alias("hi"), "rule")
    first = opened.select(F.col("lo").alias("key"), edge.alias("tie"), "lo", "hi", "rule")
    first = first.select("lo", "hi", "rule", range_bucket(first, ["key", "tie"], bounds).alias("b0"))
    last = first.select("*", F.col("hi").alias("key"), edge.alias("tie"))
    spans = last.select("lo", "hi", "rule", F.explode(F.sequence("b0", range_bucket(last, ["key", "tie"], bounds))).alias("bucket"))
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("id", "url", "host", "path", "copies")]
    ends = spans.select("bucket", F.explode(F.array(
        F.struct(F.col("lo").alias("key"), F.lit(0).alias("kind")),
        F.struct(F.col("hi").alias("key"), F.lit(2).alias("kind")))).alias("e"), "rule")
    ends = ends.select("bucket", F.col("e.key").alias("key"), F.col("e.kind").alias("kind"), *none, "rule")

    order = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("bucket", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (points.unionByName(ends)
             .withColumn("depth", F.sum(1 - F.col("kind")).over(order))
             .withColumn("top", F.last(F.when(F.col("kind") == 0, F.col("rule")), ignorenulls=True).over(slot))
             .where("kind = 1")
             .withColumn("top", F.when(F.col("depth") > 0, F.col("top"))))
    best = swept.groupBy("id", "url", "host", "path", "copies").agg(F.max("top").alias("top"))
    return best.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path",
                       F.col("top.rule").alias("rule"),
                       F.coalesce("top.verdict", F.lit(default_verdict)).alias("verdict"),
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
