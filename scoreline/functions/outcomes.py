"""Result and arithmetic column functions.

NULL scores: every comparison with a NULL is unknown, so each CASE falls to
its ELSE branch (0).  A match with a missing score therefore still counts as
played but as neither win, draw nor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(own: Column, other: Column, win: int = 3, draw: int = 1, loss: int = 0) -> Column:
    return (F.when(own > other, F.lit(win))
             .when(own == other, F.lit(draw))
             .otherwise(F.lit(loss)))


def win_flag(own: Column, other: Column) -> Column:
    return F.when(own > other, F.lit(1)).otherwise(F.lit(0))


def draw_flag(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1)).otherwise(F.lit(0))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; NULL on a zero or NULL denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round2(x: Column) -> Column:
    """Two-decimal rounding done in decimal arithmetic (half up), so the
    result does not depend on how an engine rounds binary doubles."""
    return F.round(x.cast("decimal(38,6)"), 2).cast("double")


def whole_number(x: Column) -> Column:
    """a sum shown as an integer."""
    return x.cast("bigint")
