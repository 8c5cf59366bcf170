"""Phase functions: phase from text (F4), the phase calendar (§2.4) and
phase from date (F5), season from date (E13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions.text import nonempty_extract

UNKNOWN = "UNKNOWN"
SENTINEL_DATE = "2024-01-01"   # fixed value: a placeholder date, never a real match day

# --- Fixed values: phase keywords, tried in this order (first substring
# hit on the lower-cased text wins) ---------------------------------------
PHASE_RULES = [
    ("league phase", "LEAGUE_PHASE"),
    ("league", "LEAGUE_PHASE"),
    ("group stage", "LEAGUE_PHASE"),
    ("group", "LEAGUE_PHASE"),
    ("knockout phase", "KNOCKOUT_PHASE"),
    ("knockout", "KNOCKOUT_PHASE"),
    ("ko phase", "KNOCKOUT_PHASE"),
    ("round of 16", "ROUND_OF_16"),
    ("ro16", "ROUND_OF_16"),
    ("1/8 final", "ROUND_OF_16"),
    ("round of 8", "QUARTER_FINAL"),
    ("ro8", "QUARTER_FINAL"),
    ("1/4 final", "QUARTER_FINAL"),
    ("quarter", "QUARTER_FINAL"),
    ("quarter-final", "QUARTER_FINAL"),
    ("semi", "SEMI_FINAL"),
    ("semi-final", "SEMI_FINAL"),
    ("semi final", "SEMI_FINAL"),
    ("final", "FINAL"),
    ("play-off", "PLAY_OFF"),
    ("playoff", "PLAY_OFF"),
    ("qualifying", "QUALIFYING"),
    ("preliminary", "PRELIMINARY"),
]

# --- Fixed values: phase calendar per competition.  Bounds are
# (years after the season's first year, month, day), inclusive. -----------
PHASE_CALENDAR = {
    "UCL": [
        ("LEAGUE_PHASE", (0, 9, 16), (1, 1, 28)),
        ("KNOCKOUT_PHASE", (1, 2, 17), (1, 2, 25)),
        ("ROUND_OF_16", (1, 3, 10), (1, 3, 18)),
        ("QUARTER_FINAL", (1, 4, 7), (1, 4, 15)),
        ("SEMI_FINAL", (1, 4, 28), (1, 5, 6)),
        ("FINAL", (1, 5, 30), (1, 5, 30)),
    ],
    "UEL": [
        ("LEAGUE_PHASE", (0, 9, 16), (1, 1, 28)),
        ("KNOCKOUT_PHASE", (1, 2, 19), (1, 2, 25)),
        ("ROUND_OF_16", (1, 3, 12), (1, 3, 19)),
        ("QUARTER_FINAL", (1, 4, 9), (1, 4, 16)),
        ("SEMI_FINAL", (1, 4, 30), (1, 5, 7)),
        ("FINAL", (1, 5, 20), (1, 5, 20)),
    ],
    "UECL": [
        ("LEAGUE_PHASE", (0, 9, 16), (1, 1, 28)),
        ("KNOCKOUT_PHASE", (1, 2, 19), (1, 2, 25)),
        ("ROUND_OF_16", (1, 3, 12), (1, 3, 19)),
        ("QUARTER_FINAL", (1, 4, 9), (1, 4, 16)),
        ("SEMI_FINAL", (1, 4, 30), (1, 5, 7)),
        ("FINAL", (1, 5, 27), (1, 5, 27)),
    ],
}
# -------------------------------------------------------------------------


def _key(off: int, month: int, day: int) -> int:
    return off * 10000 + month * 100 + day


def calendar_rows():
    for comp, phases in PHASE_CALENDAR.items():
        for phase, lo, hi in phases:
            yield comp, phase, _key(*lo), _key(*hi)


def calendar_frame(spark: SparkSession) -> DataFrame:
    """The calendar as a frame (18 rows: fixed size, safe to broadcast)."""
    return spark.createDataFrame(
        list(calendar_rows()),
        "cal_competition string, cal_phase string, cal_lo int, cal_hi int")


def normalize_phase(text: Column) -> Column:
    """phase code from free text; empty -> UNKNOWN; otherwise the first
    keyword rule that matches, else the text upper-cased with every other
    character than A-Z, 0-9 and _ replaced by _, cut to 30 characters."""
    low = F.lower(text)
    expr = F.when(text.isNull() | (text == ""), F.lit(UNKNOWN))
    for key, code in PHASE_RULES:
        expr = expr.when(low.contains(key), F.lit(code))
    return expr.otherwise(F.substring(F.regexp_replace(F.upper(text), "[^A-Z0-9_]", "_"), 1, 30))


def season_first_year(season: Column) -> Column:
    """First year of a ``YYYY/YYYY`` season text, NULL when unparsable."""
    return F.substring_index(season, "/", 1).try_cast("int")


def calendar_key(d: Column, season_year: Column) -> Column:
    """Position of date ``d`` relative to the season (see PHASE_CALENDAR)."""
    return (F.year(d) - season_year) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def phase_from_key(competition: Column, key: Column) -> Column:
    """F5 on a precomputed calendar key (see ``calendar_key``): a CASE on
    the competition, then integer range tests -- cheap enough to stay in
    generated code.  NULL key -> UNKNOWN."""
    by_comp: dict[str, list] = {}
    for comp, phase, lo, hi in calendar_rows():
        by_comp.setdefault(comp, []).append((phase, lo, hi))
    outer = None
    for comp, arms in by_comp.items():
        inner = None
        for phase, lo, hi in arms:
            c = key.between(lo, hi)
            inner = F.when(c, F.lit(phase)) if inner is None else inner.when(c, F.lit(phase))
        outer = (F.when(competition == comp, inner) if outer is None
                 else outer.when(competition == comp, inner))
    return F.coalesce(outer, F.lit(UNKNOWN))


def phase_key(d: Column, season: Column) -> Column:
    """Calendar key of a date within a season; NULL for a NULL date, a bad
    season or the sentinel date (all of which give UNKNOWN)."""
    s = season_first_year(season)
    return F.when(d != F.lit(SENTINEL_DATE).cast("date"), calendar_key(d, s))


def phase_from_date(competition: Column, d: Column, season: Column) -> Column:
    """F5 as a column expression.  The key expression is repeated in every
    range test; on large frames prefer ``with_phase``, which computes the
    key once."""
    return phase_from_key(competition, phase_key(d, season))


def with_phase(df: DataFrame, competition: str, d: Column, season: Column,
               out: str = "phase") -> DataFrame:
    """F5 on a frame: the calendar key is computed once as its own column,
    then ranged over (Catalyst keeps the two projections apart because the
    key is referenced many times)."""
    return (df.withColumn("_cal_key", phase_key(d, season))
              .withColumn(out, phase_from_key(F.col(competition), F.col("_cal_key")))
              .drop("_cal_key"))


def phase_by_calendar(df: DataFrame, spark: SparkSession, competition: str,
                      date_col: str, season_col: str, out_col: str = "phase") -> DataFrame:
    """Interval join of each row with the calendar on competition and
    ``date`` between the phase bounds.  The calendar has a fixed size (18
    rows), so it is broadcast; rows in no interval get UNKNOWN."""
    cal = F.broadcast(calendar_frame(spark))
    s = season_first_year(F.col(season_col))
    k = calendar_key(F.col(date_col), s)
    keyed = df.withColumn("_cal_k", k)
    cond = ((keyed[competition] == cal["cal_competition"])
            & keyed["_cal_k"].between(cal["cal_lo"], cal["cal_hi"])
            & (keyed[date_col] != F.lit(SENTINEL_DATE).cast("date")))
    out = keyed.join(cal, cond, "left")
    return (out.withColumn(out_col, F.coalesce(F.col("cal_phase"), F.lit(UNKNOWN)))
               .drop("_cal_k", "cal_competition", "cal_phase", "cal_lo", "cal_hi"))


def season_text(y: Column) -> Column:
    """``y/y+1``, of a year that is not NULL."""
    return F.concat_ws("/", y.cast("string"), (y + 1).cast("string"))


def season_from_date(d: Column) -> Column:
    """``y/y+1`` from July on, otherwise ``y-1/y``."""
    y = F.year(d)
    return F.when(F.month(d) >= 7, F.format_string("%d/%d", y, y + 1)) \
            .otherwise(F.format_string("%d/%d", y - 1, y))


def season_from_date_text(date_text: Column, as_of: Column) -> Column:
    """E13 on a ``YYYY-MM-DD`` text that may not be a valid date: the year
    and month are read from the text; the sentinel, NULL or unreadable text
    fall back to the season ending in ``as_of``'s year."""
    y = nonempty_extract(date_text, r"^(\d+)-(\d+)", 1).try_cast("int")
    m = nonempty_extract(date_text, r"^(\d+)-(\d+)", 2).try_cast("int")
    now_y = F.year(as_of)
    fallback = F.format_string("%d/%d", now_y - 1, now_y)
    # nearly all have four and two digits, which need no pattern to be taken out
    y4, m2 = F.substring(date_text, 1, 4).cast("int"), F.substring(date_text, 6, 2).cast("int")
    return (F.when(date_text.isNull() | (date_text == SENTINEL_DATE), fallback)
             .when(date_text.rlike(r"^\d{4}-\d{2}(?!\d)"), F.when(m2 >= 7, season_text(y4)).otherwise(season_text(y4 - 1)))
             .when(y.isNull() | m.isNull(), fallback)
             .when(m >= 7, season_text(y))
             .otherwise(season_text(y - 1)))
