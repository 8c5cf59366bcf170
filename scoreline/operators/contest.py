"""Description of a two-sided contest: which columns hold the sides, the
scores and the grouping key, and how many points a result is worth.

Every standings/pool operator takes a ``ContestSpec`` so the same plans serve
any two-sided contest, not only football."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ContestSpec:
    group: str = "competition"
    home: str = "home_team"
    away: str = "away_team"
    home_score: str = "home_goals"
    away_score: str = "away_goals"
    # league points for win / draw / loss
    win_points: int = 3
    draw_points: int = 1
    loss_points: int = 0
    # pool points (prediction game) per win / draw
    pool_win_points: int = 2
    pool_draw_points: int = 1


DEFAULT = ContestSpec()
