"""Identifiers and names: content-hash match id (F3), competition display
name (F10), file slug (F11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreline.functions.phases import PHASE_RULES, UNKNOWN

# --- Fixed values: competition catalogue (code -> display name) ---------
COMPETITION_NAMES = {
    "UCL": "Champions League",
    "UEL": "Europa League",
    "UECL": "Conference League",
}
# -------------------------------------------------------------------------
PHASE_CODES = sorted({UNKNOWN, *(code for _, code in PHASE_RULES)})


def _txt(c: Column) -> Column:
    # a missing value is rendered as the text None, as string formatting does
    return F.coalesce(c.cast("string"), F.lit("None"))


def _identity(competition, season, phase, home, away, match_date_text) -> Column:
    return F.concat_ws("|", *map(_txt, (competition, season, phase, home, away, match_date_text)))


def match_key(competition: Column, season: Column, phase: Column, home: Column,
              away: Column, match_date_text: Column) -> Column:
    """All 32 hex digits of the identity's digest, over the uncut phase: the key
    to join or compare by.  ``match_id`` shows only eight of them."""
    return F.md5(_identity(competition, season, phase, home, away, match_date_text))


def match_id(competition: Column, season: Column, phase: Column, home: Column,
             away: Column, match_date_text: Column) -> Column:
    """``{comp}_{season, / -> _}_{phase cleaned, 20 chars}_{md5 prefix}``
    where the hash covers ``comp|season|phase|home|away|date``."""
    digest = F.upper(F.substring(F.md5(_identity(competition, season, phase, home, away, match_date_text)), 1, 8))
    # the codes of the rules are clean already and shorter
    phase_clean = F.when(phase.isin(*PHASE_CODES), phase).otherwise(
        F.substring(F.regexp_replace(F.upper(_txt(phase)), "[^A-Z0-9_]", "_"), 1, 20))
    season_clean = F.translate(_txt(season), "/", "_")
    return F.concat_ws("_", _txt(competition), season_clean, phase_clean, digest)


def competition_name(code: Column) -> Column:
    """Display name of a competition code; an unknown code stays itself."""
    m = F.create_map(*[F.lit(x) for kv in COMPETITION_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), code)


def file_slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[ -]", "_"))


def match_file_name(code: Column) -> Column:
    """``{code}_{slug of display name}_matches.csv``."""
    return F.concat(code, F.lit("_"), file_slug(competition_name(code)), F.lit("_matches.csv"))
