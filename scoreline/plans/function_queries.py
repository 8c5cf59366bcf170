"""Registered queries for the column functions, calendar, ids and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreline.functions import dates, ids, phases, teams
from scoreline.operators import report
from scoreline.sources import params, tables

AS_OF = "2026-03-01"   # fixed "now" for repeatable year inference

# Test texts for the phase and club rules (built into labels per part row).
PHASE_SAMPLES = [
    "League Phase", "league", "Group Stage", "GROUP A", "Knockout Phase",
    "knockout round play-offs", "KO phase", "Round of 16", "RO16", "1/8 Final",
    "Round of 8", "ro8", "1/4 final", "Quarter-finals", "Semi-finals", "semi final",
    "Final", "Play-off", "Playoff round", "Qualifying", "Preliminary round",
    "Champions League - Final", "Matchday 3", "", "Jornada 5 (ida)", "Round of 32",
    "Fase final", "unknown", "  ", "Second qualifying round",
]
CLUB_SAMPLES = [
    "Scotland", "England", "england ", "England National Team", "AZ", "1. FC Koln",
    "Spain", "Real Madrid", "Paris Saint-Germain", "Wales", "Ireland U21",
    "Manchester City", "  ", "", "Portugal", "Ajax", "Inter", "Sporting CP", "Czech",
    "Iceland", "Bodo/Glimt", "Slavia Praha", "Germany country team", "FC Copenhagen",
    "Italy national squad", "Ath Bilbao", "PSG", "Finland",
]
# Text layouts used to print order dates for the date parser.
DATE_LAYOUTS = [
    "dd.MM.yyyy", "d/M/yyyy", "yyyy-MM-dd", "d MMMM yyyy", "dd MMM yyyy",
    "MMMM  d, yyyy", "MMM dd, yyyy", "dd.MM.yy", "d/M/yy",
    "'kick-off' HH:mm 'on' dd/MM/yyyy", "dd.MM",
]
# Windows for the window test, in the parameter-file key format.
WINDOW_PARAMS = {
    "SEASON": "1996/1997",
    "UCL_LEAGUE_PHASE_INITIAL_DATE": "1996-09-16",
    "UCL_LEAGUE_PHASE_END_DATE": "1998-01-28",
    "UEL_LEAGUE_PHASE_INITIAL_DATE": "1995-01-01",
    "UEL_LEAGUE_PHASE_END_DATE": "1995-12-31",
}


def _pick(samples, key):
    return F.element_at(F.array(*[F.lit(s) for s in samples]),
                        (key % len(samples) + 1).cast("int"))


def q_matches_per_competition(spark, sf):
    return report.matches_per_group(tables.matches(spark, sf))


def q_recent_matches_top10(spark, sf):
    return report.recent_matches(tables.matches(spark, sf), 10)


def q_duplicate_match_ids(spark, sf):
    return report.duplicate_keys(tables.matches(spark, sf))


def _seasoned(spark, sf):
    m = tables.matches(spark, sf, balanced=True)
    return m.withColumn("season", phases.season_from_date(F.col("match_date")))


def q_season_of_match(spark, sf):
    return _seasoned(spark, sf).select("match_id", "competition", "match_date", "season")


def q_phase_by_calendar(spark, sf):
    m = _seasoned(spark, sf)
    return phases.phase_by_calendar(m, spark, "competition", "match_date", "season").select(
        "match_id", "competition", "match_date", "season", "phase")


def q_match_ids(spark, sf):
    m = phases.with_phase(_seasoned(spark, sf), "competition", F.col("match_date"), F.col("season"))
    return m.select(
        "competition", "season", "phase", "home_team", "away_team", "match_date",
        ids.match_id(F.col("competition"), F.col("season"), F.col("phase"), F.col("home_team"),
                     F.col("away_team"), dates.date_text(F.col("match_date"))).alias("match_key"))


def q_match_full_keys(spark, sf):
    """S13 on the full digest: matches per key, with the uncut phase."""
    m = phases.with_phase(_seasoned(spark, sf), "competition", F.col("match_date"), F.col("season"))
    key = ids.match_key(F.col("competition"), F.col("season"), F.col("phase"), F.col("home_team"),
                        F.col("away_team"), dates.date_text(F.col("match_date")))
    return m.select(key.alias("match_key"), "phase").groupBy("match_key", "phase").agg(F.count(F.lit(1)).alias("n"))


def q_in_window(spark, sf):
    m = tables.matches(spark, sf).withColumn("match_date_text", dates.date_text(F.col("match_date")))
    w = params.params_from_dict(spark, WINDOW_PARAMS)
    return dates.in_window(m, w, "competition", "match_date_text").select(
        "match_id", "competition", "match_date", "in_window")


def q_phase_normalized(spark, sf):
    p = tables.table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    label = F.concat(_pick(PHASE_SAMPLES, F.col("p_partkey")),
                     F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" - "), F.col("p_name")))
                      .otherwise(F.lit("")))
    return p.select("p_partkey", label.alias("label")).withColumn(
        "phase", phases.normalize_phase(F.col("label")))


def q_club_filter(spark, sf):
    p = tables.table(spark, sf, "part").select("p_partkey", "p_name")
    label = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(
        _pick(CLUB_SAMPLES, F.col("p_partkey")))
    return p.select("p_partkey", label.alias("label")).withColumn(
        "is_club", teams.is_club(F.col("label")))


def q_clean_team(spark, sf):
    p = tables.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    size = F.col("p_size").cast("string")
    raw = (F.when(F.col("p_partkey") % 3 == 0,
                  F.concat(size, F.lit(". "), F.col("p_name"), F.lit("  "), F.col("p_brand")))
            .when(F.col("p_partkey") % 3 == 1, F.concat(size, F.col("p_name")))
            .otherwise(F.concat(F.lit(" \u00a0"), F.col("p_name"), F.lit("\u00a0 x"))))
    return p.select("p_partkey", raw.alias("raw")).withColumn(
        "team", teams.clean_team(F.col("raw")))


def q_parsed_dates(spark, sf):
    o = tables.spread(tables.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    fmt = (F.col("o_orderkey") % len(DATE_LAYOUTS)).cast("int")
    text = None
    for i, lay in enumerate(DATE_LAYOUTS):
        t = F.date_format(F.col("o_orderdate"), lay)
        text = F.when(fmt == i, t) if text is None else text.when(fmt == i, t)
    text = F.when(F.col("o_orderkey") % 2 == 1, F.translate(text, " ", "\u00a0")).otherwise(text)
    return o.select("o_orderkey", fmt.alias("fmt"), text.alias("date_text")).select(
        "o_orderkey", "fmt",
        dates.parse_date(F.col("date_text"), F.lit(AS_OF).cast("date")).alias("parsed_date"))


QUERIES = {
    "matches_per_competition": q_matches_per_competition,
    "recent_matches_top10": q_recent_matches_top10,
    "duplicate_match_ids": q_duplicate_match_ids,
    "season_of_match": q_season_of_match,
    "phase_by_calendar": q_phase_by_calendar,
    "match_ids": q_match_ids,
    "match_full_keys": q_match_full_keys,
    "in_window": q_in_window,
    "phase_normalized": q_phase_normalized,
    "club_filter": q_club_filter,
    "clean_team": q_clean_team,
    "parsed_dates": q_parsed_dates,
}
