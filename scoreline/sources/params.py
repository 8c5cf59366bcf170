"""Scraper parameters (S14): one season and one date window per competition,
kept in a flat JSON object such as::

    {"SEASON": "2025/2026",
     "UCL_LEAGUE_PHASE_INITIAL_DATE": "2025-09-16",
     "UCL_LEAGUE_PHASE_END_DATE": "2026-01-28", ...}

They are turned into rows ``(competition, season, window_start, window_end)``
with ``stack`` so windows join to matches like any other small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions.ids import COMPETITION_NAMES

START_KEY = "{code}_LEAGUE_PHASE_INITIAL_DATE"
END_KEY = "{code}_LEAGUE_PHASE_END_DATE"


def _unpivot(raw: DataFrame, codes) -> DataFrame:
    cols = raw.columns
    parts = []
    for code in codes:
        lo, hi = START_KEY.format(code=code), END_KEY.format(code=code)
        lo_c = F.col(f"`{lo}`") if lo in cols else F.lit(None).cast("string")
        hi_c = F.col(f"`{hi}`") if hi in cols else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(code).alias("competition"),
                              lo_c.alias("lo"), hi_c.alias("hi")))
    season = F.col("SEASON") if "SEASON" in cols else F.lit(None).cast("string")
    return raw.select(season.alias("season"), F.inline(F.array(*parts))).select(
        "competition", "season", _bound("lo").alias("window_start"), _bound("hi").alias("window_end"),
        ((_given("lo") & _bound("lo").isNull()) | (_given("hi") & _bound("hi").isNull())).alias("window_malformed"))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _bound(name: str) -> Column:
    """A window bound; month and day may have one digit.  A text of another
    form is no date, and its window is malformed, not absent."""
    return F.when(F.col(name).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(name, "y-M-d"))


def read_params(spark: SparkSession, path: str, codes=tuple(COMPETITION_NAMES)) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    return _unpivot(raw, codes)


def params_from_dict(spark: SparkSession, params: dict, codes=tuple(COMPETITION_NAMES)) -> DataFrame:
    keys = sorted(params)
    raw = spark.createDataFrame([tuple(str(params[k]) for k in keys)],
                                ", ".join(f"`{k}` string" for k in keys))
    return _unpivot(raw, codes)
