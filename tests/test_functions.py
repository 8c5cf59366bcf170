import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoreline.operators import extract
from scoreline.functions import dates, ids, phases, teams


def _eval(spark, col_fn, values, ddl="x string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


def test_is_club_cases(spark):
    names = ["Scotland", "England", "England National Team", "AZ", "1. FC Koln", "Real Madrid",
             "  ", None, "Wales", "Italy national squad", "Ajax"]
    got = _eval(spark, teams.is_club, names)
    assert got == [True, False, False, False, True, True, False, False, False, False, True]


def test_clean_team(spark):
    got = _eval(spark, teams.clean_team, ["12. Real  Madrid ", "3Liverpool", " Inter\tMilan", "1. FC Koln"])
    assert got == ["Real Madrid", "Liverpool", "Inter Milan", "FC Koln"]


@pytest.mark.parametrize("text,code", [
    ("League Phase", "LEAGUE_PHASE"), ("Group B", "LEAGUE_PHASE"), ("Knockout round", "KNOCKOUT_PHASE"),
    ("KO phase", "KNOCKOUT_PHASE"), ("Round of 16", "ROUND_OF_16"), ("1/8 final", "ROUND_OF_16"),
    ("RO8", "QUARTER_FINAL"), ("Quarter-finals", "QUARTER_FINAL"), ("Semi-finals", "SEMI_FINAL"),
    ("Final", "FINAL"), ("Play-off", "PLAY_OFF"), ("Playoff", "PLAY_OFF"), ("Qualifying", "QUALIFYING"),
    ("Preliminary", "PRELIMINARY"), ("Champions League - Final", "LEAGUE_PHASE"), ("", "UNKNOWN"),
    (None, "UNKNOWN"), ("Matchday 3", "MATCHDAY_3"), ("x" * 40, "X" * 30),
])
def test_normalize_phase(spark, text, code):
    assert _eval(spark, phases.normalize_phase, [text]) == [code]


def test_calendar_bounds(spark):
    cases = [("UCL", "2025-09-16", "LEAGUE_PHASE"), ("UCL", "2025-09-15", "UNKNOWN"),
             ("UCL", "2026-01-28", "LEAGUE_PHASE"), ("UCL", "2026-01-29", "UNKNOWN"),
             ("UCL", "2026-02-17", "KNOCKOUT_PHASE"), ("UEL", "2026-02-17", "UNKNOWN"),
             ("UEL", "2026-03-19", "ROUND_OF_16"), ("UCL", "2026-03-19", "UNKNOWN"),
             ("UCL", "2026-05-30", "FINAL"), ("UEL", "2026-05-20", "FINAL"), ("UECL", "2026-05-27", "FINAL"),
             ("UECL", "2026-05-20", "UNKNOWN"), ("XYZ", "2025-10-01", "UNKNOWN"),
             ("UCL", "2024-01-01", "UNKNOWN")]
    df = spark.createDataFrame([(c, d) for c, d, _ in cases], "c string, d string").select(
        phases.phase_from_date(F.col("c"), F.to_date("d"), F.lit("2025/2026")).alias("p"))
    assert [r.p for r in df.collect()] == [p for _, _, p in cases]
    # the join form agrees with the expression form
    j = phases.phase_by_calendar(
        spark.createDataFrame([(c, dt.date.fromisoformat(d), "2025/2026") for c, d, _ in cases],
                              "c string, d date, s string"), spark, "c", "d", "s")
    assert sorted((r.c, str(r.d), r.phase) for r in j.collect()) == sorted(cases)


def test_bad_season_gives_unknown(spark):
    df = spark.createDataFrame([("UCL", "2025-10-01", "abc")], "c string, d string, s string")
    assert df.select(phases.phase_from_date(F.col("c"), F.to_date("d"), F.col("s"))).first()[0] == "UNKNOWN"


AS_OF = dt.date(2026, 3, 1)


@pytest.mark.parametrize("text,expect", [
    ("05.01.2026", "2026-01-05"), ("5/1/2026", "2026-01-05"), ("2026-01-05", "2026-01-05"),
    ("5 January 2026", "2026-01-05"), ("5 Jan 2026", "2026-01-05"), ("January 5, 2026", "2026-01-05"),
    ("Jan 5, 2026", "2026-01-05"), ("05.01.26", "2026-01-05"), ("5/1/26", "2026-01-05"),
    ("01.02.69", "1969-02-01"), ("Jan  5, 2026", "2026-01-05"), ("5  January 2026", "2026-01-05"),
    ("31.02.2026", None), ("29.02.2024", "2024-02-29"), ("29.02.2025", None),
    ("played 03/04/2025 20:45", "2025-04-03"), ("10.12.", "2026-01-10"), ("10.12", "2025-12-10"),
    ("01.03", "2026-03-01"), ("02.03", "2025-03-02"), ("", None), (None, None),
])
def test_parse_date(spark, text, expect):
    got = _eval(spark, lambda c: dates.parse_date(c, F.lit(AS_OF)), [text])[0]
    assert (got.isoformat() if got else None) == expect


def test_part_date_rules(spark):
    parts = ["Ath Bilbao|PSG|0|0|10.12. 21:00", "31.02.2026|x", "30.02.|15.01.", "a|b", "x 1.2 y 3.4.2025|z",
             "110.12|05.05"]
    df = spark.createDataFrame([(p,) for p in parts], "p string")
    got = [r.part_date for r in extract.with_part_date(df, "p", F.lit(AS_OF)).collect()]
    # '10.12.' -> December of last year; a year given is not validated; an impossible d.m is skipped;
    # only the first hit inside a part counts
    assert got == ["2025-12-10", "2026-02-31", "2026-01-15", None, "2026-02-01", "2025-12-10"]


def test_match_id_reproduces_shipped_id(spark):
    df = spark.createDataFrame([("UCL", "2025/2026", "LEAGUE_PHASE", "Atalanta", "Ath Bilbao", "2026-01-21")],
                               "c string, s string, p string, h string, a string, d string")
    got = df.select(ids.match_id(*[F.col(c) for c in "cspha"], F.col("d"))).first()[0]
    assert got == "UCL_2025_2026_LEAGUE_PHASE_E8A2ADF9"


def test_competition_names_and_files(spark):
    got = _eval(spark, ids.match_file_name, ["UCL", "UEL", "UECL", "XX"])
    assert got == ["UCL_champions_league_matches.csv", "UEL_europa_league_matches.csv",
                   "UECL_conference_league_matches.csv", "XX_xx_matches.csv"]


def test_window_rule(spark):
    from scoreline.sources.params import params_from_dict
    w = params_from_dict(spark, {"SEASON": "2025/2026", "UCL_LEAGUE_PHASE_INITIAL_DATE": "2025-09-16",
                                 "UCL_LEAGUE_PHASE_END_DATE": "2026-01-28"})
    rows = [("UCL", "2025-09-16"), ("UCL", "2026-01-29"), ("UCL", "2024-01-01"), ("UCL", None),
            ("UCL", "2026-02-31"), ("UEL", "2030-01-01")]
    df = spark.createDataFrame(rows, "competition string, d string")
    got = {(r.competition, r.d): r.in_window for r in dates.in_window(df, w, "competition", "d").collect()}
    assert got == {("UCL", "2025-09-16"): True, ("UCL", "2026-01-29"): False, ("UCL", "2024-01-01"): False,
                   ("UCL", None): False, ("UCL", "2026-02-31"): False, ("UEL", "2030-01-01"): True}


def test_read_params_json(spark, tmp_path):
    p = tmp_path / "params.json"
    p.write_text('{\n "SEASON": "2025/2026",\n "UEL_LEAGUE_PHASE_INITIAL_DATE": "2025-09-16",\n'
                 ' "UEL_LEAGUE_PHASE_END_DATE": "2026-01-28"\n}\n')
    from scoreline.sources.params import read_params
    rows = {r.competition: (r.season, r.window_start, r.window_end) for r in read_params(spark, str(p)).collect()}
    assert rows["UEL"] == ("2025/2026", dt.date(2025, 9, 16), dt.date(2026, 1, 28))
    assert rows["UCL"] == ("2025/2026", None, None)


def test_window_bounds_with_short_parts_and_malformed(spark):
    from scoreline.sources.params import params_from_dict
    w = params_from_dict(spark, {"UCL_LEAGUE_PHASE_INITIAL_DATE": "2025-9-16", "UCL_LEAGUE_PHASE_END_DATE": "2026-1-28",
                                 "UEL_LEAGUE_PHASE_INITIAL_DATE": "soon", "UEL_LEAGUE_PHASE_END_DATE": "2026-01-28"})
    df = spark.createDataFrame([("UCL", "1999-10-01"), ("UCL", "2025-10-01"), ("UEL", "2025-10-01"), ("UECL", "2025-10-01")],
                               "competition string, d string")
    twice = w.union(w)                                   # a repeated window repeats no match
    got = {(r.competition, r.d): r.in_window for r in dates.in_window(df, twice, "competition", "d").collect()}
    assert got == {("UCL", "1999-10-01"): False, ("UCL", "2025-10-01"): True, ("UEL", "2025-10-01"): False, ("UECL", "2025-10-01"): True}
    assert dates.in_window(df, twice, "competition", "d").count() == 4


def test_windows_do_not_gather_the_matches_of_a_competition(spark):
    from scoreline.sources.params import params_from_dict
    w = params_from_dict(spark, {"UCL_LEAGUE_PHASE_INITIAL_DATE": "2025-09-16", "UCL_LEAGUE_PHASE_END_DATE": "2026-01-28"})
    df = spark.createDataFrame([("UCL", "2025-10-01"), ("UEL", "2025-10-01")], "competition string, d string")
    plan = dates.in_window(df, w, "competition", "d")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("text, expect", [
    ("5.3.2024", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("5.3/2024", "2024-03-05"), ("05.03.2024\n", "2024-03-05"), ("05.03.0012", "0012-03-05"),
    ("31.2.1224", "2025-12-02"), ("2024-3-5", "2024-03-05"), ("05.03.24", "2024-03-05"), ("5  March 2024", "2024-03-05"), ("30.02.2024", None)])
def test_plain_dates_read_like_all_others(spark, text, expect):
    """the plain form is read by a cast; what that does not read goes the way of the others."""
    as_of = F.lit(dt.date(2026, 3, 1))
    assert spark.createDataFrame([(text,)], "t string").select(dates.date_text(dates.parse_date(F.col("t"), as_of))).first()[0] == expect


def test_iso_dates_and_seasons_of_texts(spark):
    rows = [("2024-07-01",), ("2024-02-30",), ("2024-7-01",), (" 2024-07-01",), ("2024-07-01T00",), ("20245-07-01",), ("x",), (None,)]
    as_of = F.lit(dt.date(2026, 3, 1))
    got = spark.createDataFrame(rows, "t string").select(dates.iso_date(F.col("t")).cast("string"), phases.season_from_date_text(F.col("t"), as_of)).collect()
    assert [tuple(r) for r in got] == [("2024-07-01", "2024/2025"), (None, "2023/2024"), (None, "2024/2025"), (None, "2025/2026"),
                                       (None, "2024/2025"), (None, "20245/20246"), (None, "2025/2026"), (None, "2025/2026")]
