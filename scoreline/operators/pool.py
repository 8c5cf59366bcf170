"""Prediction pool: pool table (W1), leaderboard (J1, A4), player views.

Two point systems coexist: the league's (3-1-0) orders the positions, while
the pool scores picks with 2 per win and 1 per draw.  Inside the plan they
are named ``league_pts`` and ``pts``; only the pool points are published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions.outcomes import round2, safe_ratio, whole_number
from scoreline.operators.contest import DEFAULT, ContestSpec
from scoreline.operators.numbering import number_rows


def pool_table(league: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """Competition, team, mp, w, d, l, pool pts, and ``pos`` ranked by
    league points (ties share a position, no tie-break)."""
    t = league.select(
        spec.group, "team", "mp", "w", "d", "l",
        ((F.col("w") * spec.pool_win_points) + F.col("d") * spec.pool_draw_points)
        .cast("bigint").alias("pts"),
        F.col("pts").alias("league_pts"),
    )
    # one row per (group, team): the rank window sorts a small frame once
    w = Window.partitionBy(spec.group).orderBy(F.col("league_pts").desc_nulls_last())
    ranked = t.withColumn("pos", F.rank().over(w).cast("bigint"))
    return ranked.select(spec.group, "team", "mp", "w", "d", "l", "pts", "pos")


def leaderboard(picks: DataFrame, pool: DataFrame) -> DataFrame:
    """J1 + A4: every pick joined to the pool table on team only (a team
    entered in several competitions contributes once per competition);
    unmatched picks stay and add nothing.  ``avg`` is points per match over
    all picks (ratio of sums)."""
    joined = picks.join(pool.select("team", "mp", "pts"), "team", "left")
    return joined.groupBy("jugador").agg(
        F.sum("pts").cast("bigint").alias("pts"),
        safe_ratio(F.sum("pts"), F.sum("mp")).alias("avg"),
    )


def leaderboard_report(board: DataFrame) -> DataFrame:
    """The dashboard's leaderboard, with the rounded average."""
    return board.select("jugador", "pts", "avg", round2(F.col("avg")).alias("avg_rounded"))


def leaderboard_ordered(board: DataFrame) -> DataFrame:
    """O2: the leaderboard with its order as ``place``: points, then average, both
    descending with nulls last; the player's name settles ties.  Players are
    numbered in ranges of that order."""
    order = [F.desc_nulls_last("pts"), F.desc_nulls_last("avg"), F.col("jugador").asc_nulls_first()]
    return number_rows(leaderboard_report(board), order, name="place")


def player_view(pool: DataFrame, picks: DataFrame, jugador: str, spec: ContestSpec = DEFAULT) -> DataFrame:
    """P2 + O3: one player's detail in its order (competition, position, team)."""
    order = Window.orderBy(spec.group, "pos", "team")
    return player_detail(pool, picks, jugador, spec).withColumn("place", F.row_number().over(order).cast("bigint"))


def player_detail(pool: DataFrame, picks: DataFrame, jugador: str | None = None,
                  spec: ContestSpec = DEFAULT) -> DataFrame:
    """J2 + P2: pool rows of the teams a player picked (inner join on team).
    With ``jugador=None`` the detail of every player is returned, keyed by
    ``jugador``; the equality filter is pushed to the picks side."""
    p = picks.where(F.col("jugador").isNotNull())
    if jugador is not None:
        p = p.where(F.col("jugador") == F.lit(jugador))
    return pool.join(p, "team", "inner").select(
        "jugador", spec.group, "team", "mp", "w", "d", "l", "pts", "pos")


def competition_summary(detail: DataFrame, spec: ContestSpec = DEFAULT) -> DataFrame:
    """A5: per player and competition, totals of mp, w, d, l and points.
    Rows with a NULL competition are dropped (as a pandas group-by does)."""
    return (detail.where(F.col(spec.group).isNotNull())
            .groupBy("jugador", spec.group).agg(
                F.sum("mp").cast("bigint").alias("total_mp"),
                F.sum("w").cast("bigint").alias("total_w"),
                F.sum("d").cast("bigint").alias("total_d"),
                F.sum("l").cast("bigint").alias("total_l"),
                F.sum("pts").cast("bigint").alias("total_points")))


def headline_numbers(board: DataFrame) -> DataFrame:
    """Player count, total points, mean points per player (NULLs are
    skipped by the mean, counted by the player count)."""
    return board.agg(
        F.count(F.lit(1)).alias("n_players"),
        whole_number(F.sum("pts")).alias("total_points"),
        safe_ratio(F.sum("pts"), F.count("pts")).alias("mean_points"),
    )


def player_list(board: DataFrame) -> DataFrame:
    """Distinct non-NULL players, their order as ``place``, numbered in ranges."""
    names = board.select("jugador").where(F.col("jugador").isNotNull()).distinct()
    return number_rows(names, [F.col("jugador")], name="place")


def player_summary(board: DataFrame, jugador: str) -> DataFrame:
    """The leaderboard row of one player."""
    return board.where(F.col("jugador") == F.lit(jugador)).limit(1)


# Display headers of the dashboard tables (P5).
LEADERBOARD_HEADERS = {"jugador": "Jugador", "pts": "Points", "avg": "Average",
                       "avg_rounded": "Avg (Rounded)"}
DETAIL_HEADERS = {"competition": "Competition", "team": "Team", "mp": "Matches Played",
                  "w": "Wins", "d": "Draws", "l": "Losses", "pts": "Points", "pos": "Position"}
SUMMARY_HEADERS = {"competition": "Competition", "total_mp": "Total MP", "total_w": "Total W",
                   "total_d": "Total D", "total_l": "Total L", "total_points": "Total Points"}


def for_display(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """P5: rename columns to their display headers (others keep their name)."""
    return df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})
