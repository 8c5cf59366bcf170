"""League standings (P1, A1-A3, U1, O1) and the one-pass rewrite.

``outcomes`` is the consolidated per-match view.  ``home_table`` /
``away_table`` / ``total_rows`` / ``league_table_chain`` keep the stacked
view shapes as public outputs; ``league_table`` is the production plan: each
match becomes two side rows with ``inline`` and is grouped once, giving one
scan and one hash exchange (with map-side partial aggregation, so a hot team
or competition never lands whole in one reducer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions.outcomes import draw_flag, points, win_flag
from scoreline.operators.contest import DEFAULT, ContestSpec


def outcomes(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """Base columns plus points and result flags per match."""
    hs, as_ = F.col(spec.home_score), F.col(spec.away_score)
    w, d, l = spec.win_points, spec.draw_points, spec.loss_points
    return m.select(
        spec.group, spec.home, spec.away, spec.home_score, spec.away_score,
        points(hs, as_, w, d, l).alias("home_points"),
        points(as_, hs, w, d, l).alias("away_points"),
        win_flag(hs, as_).alias("home_win_games"),
        draw_flag(hs, as_).alias("draw_games"),
        win_flag(as_, hs).alias("away_win_games"),
    )


def _side_table(o: DataFrame, spec: ContestSpec, side: str) -> DataFrame:
    home = side == "home"
    team = spec.home if home else spec.away
    own_w, opp_w = ("home_win_games", "away_win_games") if home else ("away_win_games", "home_win_games")
    gf, ga = (spec.home_score, spec.away_score) if home else (spec.away_score, spec.home_score)
    pts = "home_points" if home else "away_points"
    return o.groupBy(team, spec.group).agg(
        F.count(F.lit(1)).alias("pj"),
        F.sum(own_w).cast("bigint").alias("wins"),
        F.sum("draw_games").cast("bigint").alias("draws"),
        F.sum(opp_w).cast("bigint").alias("loses"),
        F.sum(gf).cast("bigint").alias("gf"),
        F.sum(ga).cast("bigint").alias("ga"),
        F.sum(pts).cast("bigint").alias(f"{side}_pts"),
    )


def home_table(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """A1: per (home team, group) record of home matches."""
    return _side_table(outcomes(m, spec), spec, "home")


def away_table(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """A2: per (away team, group) record of away matches."""
    return _side_table(outcomes(m, spec), spec, "away")


def total_rows(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """Home and away records stacked by position (names of the home
    branch), each with its own goal difference."""
    cols = ["pj", "wins", "draws", "loses", "gf", "ga"]
    h = home_table(m, spec)
    a = away_table(m, spec)
    h = h.select(spec.home, spec.group, *cols, (F.col("gf") - F.col("ga")).alias("gd"), "home_pts")
    a = a.select(F.col(spec.away).alias(spec.home), spec.group, *cols,
                 (F.col("gf") - F.col("ga")).alias("gd"), F.col("away_pts").alias("home_pts"))
    return h.unionByName(a)


def league_table_chain(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """A3 in the stacked-view form (two groupings, a union and a third)."""
    t = total_rows(m, spec)
    return t.groupBy(spec.group, F.col(spec.home).alias("team")).agg(
        F.sum("pj").cast("bigint").alias("mp"),
        F.sum("wins").cast("bigint").alias("w"),
        F.sum("draws").cast("bigint").alias("d"),
        F.sum("loses").cast("bigint").alias("l"),
        F.sum("gf").cast("bigint").alias("gf"),
        F.sum("ga").cast("bigint").alias("ga"),
        F.sum("gd").cast("bigint").alias("gd"),
        F.sum("home_pts").cast("bigint").alias("pts"),
    )


def side_rows(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """Each match as two rows, one per side: (group, team, side, gf, ga,
    win, draw, loss, pts).  Narrow: no shuffle."""
    hs, as_ = F.col(spec.home_score), F.col(spec.away_score)
    w, d, l = spec.win_points, spec.draw_points, spec.loss_points

    def side(tag, team, own, other):
        return F.struct(
            F.col(team).alias("team"), F.lit(tag).alias("side"),
            own.alias("gf"), other.alias("ga"),
            win_flag(own, other).alias("win"), draw_flag(own, other).alias("draw"),
            win_flag(other, own).alias("loss"),
            points(own, other, w, d, l).alias("pts"),
        )

    return m.select(
        spec.group,
        F.inline(F.array(side("H", spec.home, hs, as_), side("A", spec.away, as_, hs))),
    )


def league_table(m: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """A3 in one pass (one scan, one shuffle), equal to the stacked form,
    including its NULL rules: goal difference is taken per side and a side
    whose goals sum to NULL contributes nothing."""
    s = side_rows(m, spec)
    is_h, is_a = F.col("side") == "H", F.col("side") == "A"
    gd_h = F.sum(F.when(is_h, F.col("gf"))) - F.sum(F.when(is_h, F.col("ga")))
    gd_a = F.sum(F.when(is_a, F.col("gf"))) - F.sum(F.when(is_a, F.col("ga")))
    gd = (F.when(gd_h.isNull() & gd_a.isNull(), F.lit(None).cast("bigint"))
           .otherwise(F.coalesce(gd_h, F.lit(0)) + F.coalesce(gd_a, F.lit(0))))
    return s.groupBy(spec.group, "team").agg(
        F.count(F.lit(1)).alias("mp"),
        F.sum("win").cast("bigint").alias("w"),
        F.sum("draw").cast("bigint").alias("d"),
        F.sum("loss").cast("bigint").alias("l"),
        F.sum("gf").cast("bigint").alias("gf"),
        F.sum("ga").cast("bigint").alias("ga"),
        gd.cast("bigint").alias("gd"),
        F.sum("pts").cast("bigint").alias("pts"),
    )


def ranked(table: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """O1: presentation order as ``place`` within the group: points, goal
    difference, goals for, all descending with nulls last, then the name."""
    order = Window.partitionBy(spec.group).orderBy(
        F.desc_nulls_last("pts"), F.desc_nulls_last("gd"), F.desc_nulls_last("gf"), "team")
    return table.withColumn("place", F.row_number().over(order).cast("bigint"))
