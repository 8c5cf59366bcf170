"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each starts from the driver's tables (via the adapter in
``scoreline.sources.tables``).  The extraction and loading queries write files
under the shared folder while they are built; the others are lazy plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreline.operators import pool, standings
from scoreline.sources import tables

ONE_PLAYER = "J7"
Query = Callable[[SparkSession, str], DataFrame]


def _league(spark, sf):
    return standings.league_table(tables.matches(spark, sf))


def q_match_outcomes(spark, sf):
    return standings.outcomes(tables.matches(spark, sf))


def q_home_table(spark, sf):
    return standings.home_table(tables.matches(spark, sf))


def q_away_table(spark, sf):
    return standings.away_table(tables.matches(spark, sf))


def q_total_rows(spark, sf):
    return standings.total_rows(tables.matches(spark, sf))


def q_league_table(spark, sf):
    return _league(spark, sf)


def q_league_table_ranked(spark, sf):
    return standings.ranked(_league(spark, sf))


def q_leaderboard_ordered(spark, sf):
    return pool.leaderboard_ordered(_board(spark, sf))


def q_player_row(spark, sf):
    return pool.player_summary(pool.leaderboard_report(_board(spark, sf)), ONE_PLAYER)


def q_player_view(spark, sf):
    return pool.player_view(pool.pool_table(_league(spark, sf)), tables.participants(spark, sf), ONE_PLAYER)


def q_league_table_one_pass(spark, sf):
    return _league(spark, sf)


def q_pool_table(spark, sf):
    return pool.pool_table(_league(spark, sf))


def q_pool_leaderboard(spark, sf):
    board = pool.leaderboard(tables.participants(spark, sf), pool.pool_table(_league(spark, sf)))
    return pool.leaderboard_report(board)


def q_player_detail(spark, sf):
    return pool.player_detail(pool.pool_table(_league(spark, sf)), tables.participants(spark, sf))


def q_player_competition_summary(spark, sf):
    return pool.competition_summary(q_player_detail(spark, sf))


def _board(spark, sf):
    return pool.leaderboard(tables.participants(spark, sf), pool.pool_table(_league(spark, sf)))


def q_leaderboard_totals(spark, sf):
    return pool.headline_numbers(_board(spark, sf))


def q_player_list(spark, sf):
    return pool.player_list(_board(spark, sf))


QUERIES: dict[str, Query] = {
    "match_outcomes": q_match_outcomes,
    "home_table": q_home_table,
    "away_table": q_away_table,
    "total_rows": q_total_rows,
    "league_table": q_league_table,
    "league_table_one_pass": q_league_table_one_pass,
    "league_table_ranked": q_league_table_ranked,
    "leaderboard_ordered": q_leaderboard_ordered,
    "player_row": q_player_row,
    "player_view": q_player_view,
    "pool_table": q_pool_table,
    "pool_leaderboard": q_pool_leaderboard,
    "player_detail": q_player_detail,
    "player_competition_summary": q_player_competition_summary,
    "leaderboard_totals": q_leaderboard_totals,
    "player_list": q_player_list,
}

from scoreline.plans import function_queries  # noqa: E402

QUERIES.update(function_queries.QUERIES)

from scoreline.plans import ingest_queries  # noqa: E402

QUERIES.update(ingest_queries.QUERIES)

from scoreline.plans import sequence_queries  # noqa: E402

QUERIES.update(sequence_queries.QUERIES)

from scoreline.plans import extract_queries  # noqa: E402

QUERIES.update(extract_queries.QUERIES)
