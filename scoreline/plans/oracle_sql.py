"""Reference SQL (DuckDB dialect, ANSI where possible) for each registered
query.  The driver's tables are pre-registered as views; the adapter and the
standings are common table expressions here."""

from __future__ import annotations

ADAPTER = """
matches AS (
  SELECT concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar)) AS match_id,
         CASE l_orderkey % 3 WHEN 0 THEN 'UCL' WHEN 1 THEN 'UEL' ELSE 'UECL' END AS competition,
         cast(l_shipdate AS date) AS match_date,
         concat('T', cast(l_suppkey % 36 AS varchar)) AS home_team,
         concat('T', cast(l_partkey % 36 AS varchar)) AS away_team,
         CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE cast(l_quantity AS int) % 6 END AS home_goals,
         cast((l_partkey + l_linenumber) % 5 AS int) AS away_goals,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem WHERE l_suppkey % 36 <> l_partkey % 36),
participantes AS (
  SELECT concat('J', cast(c_nationkey AS varchar)) AS jugador,
         concat('T', cast(c_custkey % 40 AS varchar)) AS team
  FROM customer)"""

# Every match seen from both sides; one grouping by side, another over sides.
STANDINGS = """
seen AS (
  SELECT competition, 'home' AS place, home_team AS team, home_goals AS scored, away_goals AS conceded FROM matches
  UNION ALL
  SELECT competition, 'away', away_team, away_goals, home_goals FROM matches),
by_place AS (
  SELECT competition, team, place, cast(count(*) AS bigint) AS played,
         cast(count_if(scored > conceded) AS bigint) AS won, cast(count_if(scored = conceded) AS bigint) AS drawn,
         cast(count_if(scored < conceded) AS bigint) AS lost, cast(sum(scored) AS bigint) AS scored,
         cast(sum(conceded) AS bigint) AS conceded
  FROM seen GROUP BY ALL),
league AS (
  SELECT competition, team, cast(sum(played) AS bigint) AS mp, cast(sum(won) AS bigint) AS w, cast(sum(drawn) AS bigint) AS d,
         cast(sum(lost) AS bigint) AS l, cast(sum(scored) AS bigint) AS gf, cast(sum(conceded) AS bigint) AS ga,
         cast(sum(scored - conceded) AS bigint) AS gd, cast(sum(3 * won + drawn) AS bigint) AS pts
  FROM by_place GROUP BY ALL),
pool AS (
  SELECT competition, team, mp, w, d, l, cast(2 * w + d AS bigint) AS pts,
         (SELECT cast(1 + count(*) AS bigint) FROM league better
          WHERE better.competition = league.competition AND better.pts > league.pts) AS pos
  FROM league),
board AS (
  SELECT jugador, cast(sum(pts) AS bigint) AS pts, sum(pts) / nullif(cast(sum(mp) AS double), 0) AS avg
  FROM participantes LEFT JOIN pool USING (team) GROUP BY jugador)"""


def with_ctes(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


BASE = with_ctes(ADAPTER, STANDINGS)

_PLACE = """
SELECT team AS {place}_team, competition, played AS pj, won AS wins, drawn AS draws, lost AS loses, scored AS gf, conceded AS ga,
       3 * won + drawn AS {place}_pts
FROM by_place WHERE place = '{place}'"""
_BOARD = "SELECT jugador, pts, avg, cast(round(cast(avg AS decimal(38,6)), 2) AS double) AS avg_rounded"
_DETAIL = """
SELECT jugador, competition, team, mp, w, d, l, pts, pos FROM participantes JOIN pool USING (team) WHERE jugador IS NOT NULL"""

ORACLE: dict[str, str] = {
    "match_outcomes": BASE + """
SELECT competition, home_team, away_team, home_goals, away_goals,
       coalesce(3 * cast(home_goals > away_goals AS integer) + cast(home_goals = away_goals AS integer), 0) AS home_points,
       coalesce(3 * cast(home_goals < away_goals AS integer) + cast(home_goals = away_goals AS integer), 0) AS away_points,
       coalesce(cast(home_goals > away_goals AS integer), 0) AS home_win_games,
       coalesce(cast(home_goals = away_goals AS integer), 0) AS draw_games,
       coalesce(cast(home_goals < away_goals AS integer), 0) AS away_win_games
FROM matches""",
    "home_table": BASE + _PLACE.format(place="home"),
    "away_table": BASE + _PLACE.format(place="away"),
    "total_rows": BASE + """
SELECT team AS home_team, competition, played AS pj, won AS wins, drawn AS draws, lost AS loses, scored AS gf, conceded AS ga,
       scored - conceded AS gd, 3 * won + drawn AS home_pts
FROM by_place""",
    "league_table": BASE + "SELECT * FROM league",
    "league_table_one_pass": BASE + "SELECT * FROM league",
    "league_table_ranked": BASE + """
SELECT *, row_number() OVER (PARTITION BY competition ORDER BY pts DESC, gd DESC, gf DESC, team) AS place FROM league""",
    "pool_table": BASE + "SELECT * FROM pool",
    "pool_leaderboard": BASE + _BOARD + " FROM board",
    "leaderboard_ordered": BASE + _BOARD + """,
       row_number() OVER (ORDER BY pts DESC NULLS LAST, avg DESC NULLS LAST, jugador) AS place
FROM board""",
    "player_row": BASE + _BOARD + " FROM board WHERE jugador = 'J7'",
    "player_detail": BASE + _DETAIL,
    "player_view": BASE + "SELECT *, row_number() OVER (ORDER BY competition, pos, team) AS place FROM (" + _DETAIL + " AND jugador = 'J7') t",
    "player_competition_summary": BASE + """
SELECT jugador, competition, cast(sum(mp) AS bigint) AS total_mp, cast(sum(w) AS bigint) AS total_w,
       cast(sum(d) AS bigint) AS total_d, cast(sum(l) AS bigint) AS total_l, cast(sum(pts) AS bigint) AS total_points
FROM participantes JOIN pool USING (team)
WHERE jugador IS NOT NULL AND competition IS NOT NULL
GROUP BY ALL""",
    "leaderboard_totals": BASE + """
SELECT cast(count(*) AS bigint) AS n_players, cast(sum(pts) AS bigint) AS total_points,
       cast(sum(pts) AS double) / nullif(count(pts), 0) AS mean_points
FROM board""",
    "player_list": BASE + """
SELECT jugador, row_number() OVER (ORDER BY jugador) AS place FROM (SELECT DISTINCT jugador FROM board WHERE jugador IS NOT NULL) t""",
}


# ---------------------------------------------------------------------------
# Functions, calendar, ids and reports
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(x) for x in items) + "]"


def _phase_case(comp: str, d: str, season_year: str) -> str:
    from scoreline.functions.phases import calendar_rows
    k = f"((year({d}) - {season_year}) * 10000 + month({d}) * 100 + day({d}))"
    arms = " ".join(f"WHEN {comp} = {_q(c)} AND {k} BETWEEN {lo} AND {hi} THEN {_q(p)}"
                    for c, p, lo, hi in calendar_rows())
    return (f"CASE WHEN {d} IS NULL OR {season_year} IS NULL OR {d} = DATE '2024-01-01' "
            f"THEN 'UNKNOWN' {arms} ELSE 'UNKNOWN' END")


def _season_sql(d: str) -> str:
    return (f"CASE WHEN month({d}) >= 7 THEN printf('%d/%d', year({d}), year({d}) + 1) "
            f"ELSE printf('%d/%d', year({d}) - 1, year({d})) END")


def _season_year_sql(d: str) -> str:
    return f"(year({d}) - CASE WHEN month({d}) >= 7 THEN 0 ELSE 1 END)"


def _normalize_phase_sql(t: str) -> str:
    from scoreline.functions.phases import PHASE_RULES
    arms = " ".join(f"WHEN strpos(lower({t}), {_q(k)}) > 0 THEN {_q(v)}" for k, v in PHASE_RULES)
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'UNKNOWN' {arms} "
            f"ELSE substr(regexp_replace(upper({t}), '[^A-Z0-9_]', '_', 'g'), 1, 30) END")


#: any Unicode white space, as a character class of the oracle's dialect
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _clean_team_sql(x: str) -> str:
    inner = f"regexp_replace({x}, '^\\d+\\.?{BLANK}*', '')"
    return f"regexp_replace({_strip_sql(inner)}, '{BLANK}+', ' ', 'g')"


def _is_club_sql(t: str) -> str:
    from scoreline.functions.teams import CLUB_TOKENS, COUNTRY_NAMES, NATIONAL_TEAM_PHRASES
    low = f"lower({_strip_sql(t)})"
    nat = " OR ".join(f"strpos({low}, {_q(p)}) > 0" for p in NATIONAL_TEAM_PHRASES)
    tok = " OR ".join(f"strpos({low}, {_q(x.lower())}) > 0" for x in CLUB_TOKENS)
    countries = ", ".join(_q(c) for c in COUNTRY_NAMES)
    return (f"CASE WHEN {t} IS NULL OR length({_strip_sql(t)}) < 3 THEN false "
            f"WHEN {nat} THEN false "
            f"WHEN {low} IN ({countries}) AND NOT ({tok}) THEN false ELSE true END")


def _match_id_sql(comp, season, phase, home, away, date_text) -> str:
    return (f"concat_ws('_', {comp}, replace({season}, '/', '_'), "
            f"substr(regexp_replace(upper({phase}), '[^A-Z0-9_]', '_', 'g'), 1, 20), "
            f"upper(substr(md5(concat_ws('|', {comp}, {season}, {phase}, {home}, {away}, "
            f"{date_text})), 1, 8)))")


def _function_oracles() -> dict[str, str]:
    from scoreline.functions.ids import COMPETITION_NAMES
    from scoreline.plans import function_queries as fq

    names = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in COMPETITION_NAMES.items())
    comp_name = f"CASE competition {names} ELSE competition END"
    out = {}
    out["matches_per_competition"] = BASE + f"""
SELECT competition, {comp_name} AS competition_name,
       concat(competition, '_', lower(regexp_replace({comp_name}, '[ -]', '_', 'g')), '_matches.csv') AS file_name,
       cast(count(*) AS bigint) AS n_matches
FROM matches GROUP BY competition"""
    out["recent_matches_top10"] = BASE + """
SELECT * FROM (
  SELECT match_id, competition, match_date, home_team, away_team, home_goals, away_goals,
         cast(row_number() OVER (PARTITION BY competition ORDER BY match_date DESC NULLS LAST,
              match_id ASC NULLS FIRST, home_team ASC NULLS FIRST, away_team ASC NULLS FIRST,
              home_goals ASC NULLS FIRST, away_goals ASC NULLS FIRST) AS integer) AS rn,
         cast(greatest(count(*) OVER (PARTITION BY competition) - 10, 0) AS bigint) AS n_more
  FROM matches) t
WHERE rn <= 10"""
    out["duplicate_match_ids"] = BASE + """
SELECT match_id, cast(count(*) AS bigint) AS n FROM matches GROUP BY match_id HAVING count(*) > 1"""
    season = _season_sql("match_date")
    sy = _season_year_sql("match_date")
    out["season_of_match"] = BASE + f"""
SELECT match_id, competition, match_date, {season} AS season FROM matches"""
    out["phase_by_calendar"] = BASE + f"""
SELECT match_id, competition, match_date, {season} AS season,
       {_phase_case('competition', 'match_date', sy)} AS phase FROM matches"""
    out["match_ids"] = BASE + f"""
SELECT competition, season, phase, home_team, away_team, match_date,
       {_match_id_sql('competition', 'season', 'phase', 'home_team', 'away_team', "strftime(match_date, '%Y-%m-%d')")} AS match_key
FROM (SELECT *, {season} AS season, {_phase_case('competition', 'match_date', sy)} AS phase FROM matches) m"""
    out["match_full_keys"] = BASE + f"""
SELECT md5(concat_ws('|', competition, season, phase, home_team, away_team, strftime(match_date, '%Y-%m-%d'))) AS match_key,
       phase, cast(count(*) AS bigint) AS n
FROM (SELECT *, {season} AS season, {_phase_case('competition', 'match_date', sy)} AS phase FROM matches) m
GROUP BY ALL"""
    wp = fq.WINDOW_PARAMS
    out["in_window"] = BASE + f"""
SELECT match_id, competition, match_date,
  CASE WHEN match_date IS NULL OR match_date = DATE '2024-01-01' THEN false
       WHEN competition = 'UCL' THEN match_date BETWEEN DATE {_q(wp['UCL_LEAGUE_PHASE_INITIAL_DATE'])} AND DATE {_q(wp['UCL_LEAGUE_PHASE_END_DATE'])}
       WHEN competition = 'UEL' THEN match_date BETWEEN DATE {_q(wp['UEL_LEAGUE_PHASE_INITIAL_DATE'])} AND DATE {_q(wp['UEL_LEAGUE_PHASE_END_DATE'])}
       ELSE true END AS in_window
FROM matches"""
    n = len(fq.PHASE_SAMPLES)
    out["phase_normalized"] = f"""
SELECT p_partkey, label, {_normalize_phase_sql('label')} AS phase FROM (
  SELECT p_partkey, concat({_list(fq.PHASE_SAMPLES)}[p_partkey % {n} + 1],
         CASE WHEN p_size % 2 = 0 THEN concat(' - ', p_name) ELSE '' END) AS label
  FROM part) t"""
    n = len(fq.CLUB_SAMPLES)
    out["club_filter"] = f"""
SELECT p_partkey, label, {_is_club_sql('label')} AS is_club FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name
         ELSE {_list(fq.CLUB_SAMPLES)}[p_partkey % {n} + 1] END AS label
  FROM part) t"""
    out["clean_team"] = f"""
SELECT p_partkey, raw, {_clean_team_sql('raw')} AS team
FROM (SELECT p_partkey,
        CASE p_partkey % 3 WHEN 0 THEN concat(cast(p_size AS varchar), '. ', p_name, '  ', p_brand)
                           WHEN 1 THEN concat(cast(p_size AS varchar), p_name)
                           ELSE concat(' ', chr(160), p_name, chr(160), ' x') END AS raw
      FROM part) t"""
    nl = len(fq.DATE_LAYOUTS)
    asof = fq.AS_OF
    y_now, m_now = int(asof[:4]), int(asof[5:7])
    d = "cast(o_orderdate AS date)"
    y0 = f"(CASE WHEN month({d}) > {m_now} THEN {y_now - 1} ELSE {y_now} END)"
    first = f"try_cast(printf('%04d-%02d-%02d', {y0}, month({d}), day({d})) AS date)"
    back = f"try_cast(printf('%04d-%02d-%02d', {y0} - 1, month({d}), day({d})) AS date)"
    out["parsed_dates"] = f"""
SELECT o_orderkey, cast(o_orderkey % {nl} AS integer) AS fmt,
  CASE WHEN o_orderkey % {nl} = {nl - 1} THEN
         CASE WHEN {first} IS NULL THEN NULL WHEN {first} > DATE '{asof}' THEN {back} ELSE {first} END
       ELSE {d} END AS parsed_date
FROM orders"""
    return out


ORACLE.update(_function_oracles())


# ---------------------------------------------------------------------------
# Loading
# ---------------------------------------------------------------------------

def _ingest_oracles() -> dict[str, str]:
    from scoreline.functions.ids import COMPETITION_NAMES
    from scoreline.plans import ingest_queries as iq

    season = _season_sql("match_date")
    sy = _season_year_sql("match_date")
    names = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in COMPETITION_NAMES.items())
    comp_name = f"CASE competition {names} ELSE competition END"
    feed = f"""
feed AS (
  SELECT *, {_match_id_sql('competition', 'season', 'phase', 'home_name', 'away_team', "strftime(match_date, '%Y-%m-%d')")} AS feed_id,
         concat(competition, '_', lower(regexp_replace({comp_name}, '[ -]', '_', 'g')), '_matches.csv') AS file_name,
         l_orderkey % {iq.BAD_DATE_EVERY} = 0 AS bad_date,
         l_orderkey % {iq.BAD_GOALS_EVERY} = 0 AS bad_goals
  FROM (SELECT *, {season} AS season, {_phase_case('competition', 'match_date', sy)} AS phase,
               CASE WHEN l_partkey % {iq.QUOTED_NAME_EVERY} = 0 THEN concat(home_team, {_q(iq.QUOTED_SUFFIX)})
                    ELSE home_team END AS home_name
        FROM matches) m)"""
    base = with_ctes(ADAPTER, feed)
    out = {}
    out["csv_load_roundtrip"] = base + """
SELECT feed_id AS match_id, competition, season, phase, match_date, home_name AS home_team, away_team,
       home_goals, away_goals
FROM feed WHERE NOT bad_date AND NOT bad_goals"""
    out["csv_split_load"] = out["stream_load"] = out["csv_load_roundtrip"]
    out["load_log"] = base + """
SELECT file_name, cast(count(*) FILTER (WHERE NOT bad_date AND NOT bad_goals) AS bigint) AS rows_inserted,
       cast(count(*) FILTER (WHERE bad_date OR bad_goals) AS bigint) AS rows_rejected,
       CASE WHEN count(*) FILTER (WHERE bad_date OR bad_goals) = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status
FROM feed GROUP BY file_name
UNION ALL SELECT * FROM (VALUES ('UCL_empty_matches.csv', 0, 0, 'SUCCESS'), ('UEL_header_matches.csv', 0, 0, 'SUCCESS'),
                                ('UECL_broken_matches.csv', 0, 0, 'ERROR: unreadable file'))"""
    out["stream_log"] = out["load_log"]
    out["load_count"] = base + """
SELECT cast(count(*) AS bigint) AS n_rows, cast(count(*) AS bigint) AS n_stamped FROM feed WHERE NOT bad_date AND NOT bad_goals"""
    out["new_files"] = base + """
SELECT 'batch2' AS batch, file_name, cast(count(*) AS bigint) AS rows FROM feed WHERE competition <> 'UEL' GROUP BY file_name"""
    landed = """
landed AS (
  SELECT DISTINCT file_name FROM feed
  UNION ALL VALUES ('UCL_empty_matches.csv'), ('UEL_header_matches.csv'), ('UECL_broken_matches.csv'))"""
    names = with_ctes(ADAPTER, feed, landed)
    out["file_inventory"] = names + """
SELECT file_name, row_number() OVER (ORDER BY file_name) AS place, greatest(count(*) OVER () - 4, 0) AS n_more
FROM landed QUALIFY place <= 4"""
    out["publish_status"] = names + """
SELECT CASE WHEN file_name LIKE 'UECL%' THEN 'uploaded' ELSE 'skipped' END AS status, cast(count(*) AS bigint) AS n_files
FROM landed GROUP BY ALL"""
    out["retired_names"] = names + """
SELECT CASE WHEN file_name LIKE 'UECL%' THEN file_name || '_OLD.gz' ELSE replace(file_name, '.csv', '_OLD.csv') END AS file_name
FROM landed UNION ALL VALUES ('UCL_champions_league_matches.csv_OLD.gz')"""
    out["rejected_rows"] = base + """
SELECT file_name, feed_id AS match_id,
       CASE WHEN NOT bad_date THEN strftime(match_date, '%Y-%m-%d')
            ELSE CASE l_linenumber % 3 WHEN 0 THEN strftime(match_date, '%d/%m/%Y') WHEN 1 THEN strftime(match_date, '%Y')
                 ELSE strftime(match_date, '%Y-%m-%d') || ' or later' END END AS raw_match_date,
       cast(home_goals AS varchar) AS raw_home_goals,
       CASE WHEN bad_goals THEN concat(cast(away_goals AS varchar), '.5') ELSE cast(away_goals AS varchar) END AS raw_away_goals,
       CASE WHEN bad_date THEN 'bad match_date' ELSE 'bad away_goals' END AS reject_reason
FROM feed WHERE bad_date OR bad_goals"""
    return out


ORACLE.update(_ingest_oracles())


# ---------------------------------------------------------------------------
# Ordered state over events
# ---------------------------------------------------------------------------

def _sequence_oracles() -> dict[str, str]:
    from scoreline.plans import sequence_queries as sq
    out = {}
    events = f"(SELECT * REPLACE (CASE WHEN event_id % {sq.NO_USER_EVERY} <> 0 THEN user_id END AS user_id) FROM events)"
    out["carry_forward_date"] = f"""
SELECT event_id, user_id,
       coalesce(last_value(CASE WHEN event_type = {_q(sq.DATE_EVENT)} THEN cast(ts AS date) END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                DATE {_q(sq.AS_OF)}) AS match_date
FROM {events} ev"""
    arms = " ".join(f"WHEN event_type = {_q(k)} THEN {_q(v)}" for k, v in sq.PHASE_TEXT_BY_EVENT.items())
    c = sq.COMPETITION_BY_USER
    comp = f"CASE user_id % 3 WHEN 0 THEN {_q(c[0])} WHEN 1 THEN {_q(c[1])} ELSE {_q(c[2])} END"
    d = "cast(ts AS date)"
    out["carry_forward_phase"] = f"""
WITH e AS (
  SELECT event_id, user_id, ts, CASE {arms} END AS txt,
         {_phase_case('comp', d, _season_year_sql(d))} AS inferred
  FROM (SELECT *, {comp} AS comp FROM {events} ev) x),
f AS (
  SELECT *, CASE WHEN txt IS NOT NULL AND txt <> '' THEN {_normalize_phase_sql('txt')} END AS explicit FROM e),
g AS (
  SELECT *,
    count(explicit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
    last_value(explicit IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base
  FROM f),
h AS (
  SELECT *, first_value(nullif(inferred, 'UNKNOWN') IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_inf
  FROM g)
SELECT event_id, user_id,
       CASE WHEN coalesce(base, 'UNKNOWN') <> 'UNKNOWN' THEN base ELSE coalesce(first_inf, 'UNKNOWN') END AS phase
FROM h"""
    return out


ORACLE.update(_sequence_oracles())


# ---------------------------------------------------------------------------
# Extraction
# ---------------------------------------------------------------------------

def _extract_oracles() -> dict[str, str]:
    from scoreline.plans import extract_queries as xq
    out = {}
    order = "l_linenumber, l_partkey, l_suppkey, away_goals, home_goals, match_date"
    hdr = " ".join(f"WHEN {r} THEN {_normalize_phase_sql(_q(t))}" for r, t in xq.HEADER_BY_ORDER.items())
    run = f"(PARTITION BY l_orderkey ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def read_pages(season: str | None = None, keep: str = "true") -> str:
        """Match rows of the rendered result pages, with page and place."""
        return with_ctes(ADAPTER) + f""",
lines AS (
  SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS integer) AS pos,
         concat('FC ', home_team) AS h, concat('FC ', away_team) AS a,
         CASE WHEN l_orderkey % 2 = 0 OR l_linenumber % 4 <> 3 THEN match_date END AS found,
         CASE WHEN l_orderkey % 2 = 0 THEN CASE l_orderkey % 4 {hdr} END
              WHEN l_partkey % 7 = 0 THEN {_normalize_phase_sql(_q(xq.INNER_PHASE))} END AS explicit
  FROM matches),
dated AS (
  SELECT *, coalesce(last_value(found IGNORE NULLS) OVER {run}, DATE '{xq.AS_OF}') AS on_date,
         count(explicit) OVER {run} AS seg, last_value(explicit IGNORE NULLS) OVER {run} AS base
  FROM lines WHERE home_goals IS NOT NULL),
seasoned AS (
  SELECT *, {_season_sql('on_date') if season is None else season} AS season,
         {_season_year_sql('on_date') if season is None else f"try_cast(left({season}, 4) AS integer)"} AS sy FROM dated),
inferred AS (SELECT *, {_phase_case('competition', 'on_date', 'sy')} AS inf FROM seasoned),
phased AS (
  SELECT *, coalesce(base, first_value(nullif(inf, 'UNKNOWN') IGNORE NULLS)
             OVER (PARTITION BY l_orderkey, seg ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS phase
  FROM inferred),
found_matches AS (
  SELECT l_orderkey AS page_id, pos, {_match_id_sql('competition', 'season', 'phase', 'h', 'a', "strftime(on_date, '%Y-%m-%d')")} AS match_id,
         competition, season, phase, strftime(on_date, '%Y-%m-%d') AS match_date, h AS home_team, a AS away_team, home_goals, away_goals
  FROM phased WHERE {keep})
"""
    out["match_extract_html"] = read_pages() + "SELECT * EXCLUDE (page_id, pos) FROM found_matches"
    out["pages_to_table"] = read_pages() + """
SELECT * EXCLUDE (page_id, pos) REPLACE (CAST(match_date AS DATE) AS match_date, CAST(home_goals AS INTEGER) AS home_goals,
                                         CAST(away_goals AS INTEGER) AS away_goals) FROM found_matches"""
    out["extract_limited"] = read_pages() + f"""
SELECT * FROM found_matches
QUALIFY row_number() OVER (PARTITION BY competition ORDER BY page_id, pos) <= {xq.LIMIT}"""
    # UCL has a window, UEL a malformed one (nothing passes), UECL none
    out["extract_with_params"] = read_pages(
        f"CASE competition WHEN 'none' THEN NULL ELSE {_q(xq.PARAMS['SEASON'])} END",
        "competition = 'UECL' OR (competition = 'UCL' AND on_date BETWEEN DATE '1995-01-05' AND DATE '1996-06-30')"
    ) + "SELECT * EXCLUDE (page_id, pos) FROM found_matches"
    out["page_extract_counters"] = read_pages() + """
SELECT p.page_id, coalesce(c.competition, 'UCL') AS competition, coalesce(c.n, 0) AS n_elements, coalesce(c.ok, 0) AS n_extracted,
       cast(0 AS bigint) AS n_no_teams, coalesce(c.n - c.ok, 0) AS n_no_score, cast(0 AS bigint) AS n_failed, cast(0 AS bigint) AS n_broad
FROM pages p LEFT JOIN (
  SELECT l_orderkey, competition, cast(count(*) AS bigint) AS n, cast(count(home_goals) AS bigint) AS ok
  FROM matches GROUP BY l_orderkey, competition) c ON p.page_id = c.l_orderkey"""
    texts = with_ctes(ADAPTER) + """,
t AS (
  SELECT match_id,
    CASE l_linenumber % 3
      WHEN 0 THEN concat_ws(' | ', concat('FC', chr(160), home_team), concat('FC ', away_team, chr(160)), cast(home_goals AS varchar),
                            cast(away_goals AS varchar), strftime(match_date, '%d.%m.'))
      WHEN 1 THEN concat_ws(' | ', concat(cast(l_linenumber AS varchar), '. ', home_team),
                            cast(home_goals AS varchar) || chr(160) || ':' || chr(160) || cast(away_goals AS varchar), away_team)
      ELSE concat_ws(' | ', strftime(match_date, '%d.%m.%Y'), home_team, away_team,
                     cast(home_goals AS varchar) || ' - ' || cast(away_goals AS varchar)) END AS full_text
  FROM matches),
p AS (SELECT *, list_transform(string_split(full_text, '|'), lambda x: """ + _strip_sql("x") + """) AS parts FROM t)"""
    cand = ("list_filter(parts, lambda x: NOT regexp_full_match(x, '[0-9]+') "
            "AND NOT regexp_matches(x, '^[0-9]{1,2}\\.[0-9]{1,2}') AND length(x) > 2)")
    out["teams_from_text"] = texts + f""",
c AS (SELECT *, {cand} AS cands FROM p),
h AS (SELECT *, CASE WHEN len(cands) >= 2 THEN cands[1] END AS home_candidate,
             CASE WHEN len(cands) >= 2 THEN cands[2] END AS away_candidate,
             list_filter(cands, lambda x: x <> cands[1])[1] AS second_distinct FROM c),
k AS (SELECT *, {_clean_team_sql('home_candidate')} AS hc, {_clean_team_sql('away_candidate')} AS ac FROM h),
r AS (SELECT *, (hc = ac AND hc <> '' AND second_distinct IS NOT NULL) AS fix FROM k)
SELECT match_id, full_text, home_candidate, away_candidate,
       CASE WHEN fix THEN cands[1] ELSE hc END AS home_team,
       CASE WHEN fix THEN second_distinct ELSE ac END AS away_team,
       coalesce(home_candidate IS NOT NULL AND away_candidate IS NOT NULL
                AND length(CASE WHEN fix THEN cands[1] ELSE hc END) >= 2
                AND length(CASE WHEN fix THEN second_distinct ELSE ac END) >= 2
                AND (CASE WHEN fix THEN cands[1] ELSE hc END) <> (CASE WHEN fix THEN second_distinct ELSE ac END),
                false) AS teams_ok
FROM r"""
    colon, pipe = f"'(\\d+){BLANK}*[:]{BLANK}*(\\d+)'", f"'(\\d+){BLANK}*[|]{BLANK}*(\\d+)'"
    out["score_from_text"] = texts + f""",
s AS (
  SELECT *, nullif(regexp_extract(full_text, {colon}, 1), '') AS c1h, nullif(regexp_extract(full_text, {colon}, 2), '') AS c1a,
         list_filter(range(1, len(parts)), lambda i: regexp_full_match(parts[i], '[0-9]+')
                     AND regexp_full_match(parts[i + 1], '[0-9]+'))[1] AS idx,
         nullif(regexp_extract(full_text, {pipe}, 1), '') AS c3h, nullif(regexp_extract(full_text, {pipe}, 2), '') AS c3a
  FROM p)
SELECT match_id, full_text,
       try_cast(coalesce(c1h, parts[idx], c3h) AS bigint) AS home_goals,
       try_cast(coalesce(c1a, parts[idx + 1], c3a) AS bigint) AS away_goals,
       CASE WHEN c1h IS NOT NULL THEN 'colon' WHEN idx IS NOT NULL THEN 'adjacent'
            WHEN c3h IS NOT NULL THEN 'pipe' END AS score_rule
FROM s"""
    d_from, d_to = xq.DIGIT_LETTERS
    pat = "'([A-Za-z\\s]+?)\\s+(\\d+)\\s*:\\s*(\\d+)\\s+([A-Za-z\\s]+)'"
    asof = xq.AS_OF
    y = int(asof[:4])
    season = f"{y - 1}/{y}"
    d = f"DATE '{asof}'"
    out["broad_text_matches"] = with_ctes(ADAPTER) + f""",
pg AS (
  SELECT l_orderkey, competition,
         string_agg(concat('Club ', translate(home_team, '{d_from}', '{d_to}'), ' ', cast(home_goals AS varchar), ' : ',
                           cast(away_goals AS varchar), ' ', 'Club ', translate(away_team, '{d_from}', '{d_to}')),
                    ', ' ORDER BY {order}) AS txt
  FROM matches GROUP BY l_orderkey, competition),
g AS (
  SELECT competition, unnest(regexp_extract_all(txt, {pat}, 1)) AS g1, unnest(regexp_extract_all(txt, {pat}, 2)) AS g2,
         unnest(regexp_extract_all(txt, {pat}, 3)) AS g3, unnest(regexp_extract_all(txt, {pat}, 4)) AS g4
  FROM pg WHERE regexp_matches(txt, '\\d\\s*:\\s*\\d')),
f AS (
  SELECT competition, {_strip_sql('g1')} AS home_team, {_strip_sql('g4')} AS away_team,
         try_cast(g2 AS integer) AS home_goals, try_cast(g3 AS integer) AS away_goals,
         '{season}' AS season, '{asof}' AS match_date,
         {_phase_case('competition', d, str(y - 1))} AS phase
  FROM g)
SELECT {_match_id_sql('competition', 'season', 'phase', 'home_team', 'away_team', 'match_date')} AS match_id,
       competition, season, phase, match_date, home_team, away_team, home_goals, away_goals
FROM f
WHERE length(home_team) > 2 AND length(away_team) > 2 AND {_is_club_sql('home_team')} AND {_is_club_sql('away_team')}"""
    regular = f"""
  SELECT {_match_id_sql('competition', 'season', 'phase', 'h', 'a', 'dtxt')} AS match_id, competition, season, phase, dtxt AS match_date,
         h AS home_team, a AS away_team, home_goals, away_goals
  FROM (SELECT *, coalesce(first_value(nullif({_phase_case('competition', 'match_date', _season_year_sql('match_date'))}, 'UNKNOWN') IGNORE NULLS)
                    OVER {run}, 'UNKNOWN') AS phase, {_season_sql('match_date')} AS season, strftime(match_date, '%Y-%m-%d') AS dtxt,
               concat('FC ', home_team) AS h, concat('FC ', away_team) AS a
        FROM matches WHERE home_goals IS NOT NULL AND l_orderkey % 3 <> 0) x"""
    out["extract_fallback"] = out["broad_text_matches"].replace(
        "FROM matches GROUP BY l_orderkey, competition)", "FROM matches WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, competition)"
    ) + " UNION ALL " + regular
    # the same rows with their page, their place on it and, on pages without
    # elements, their order in the text
    paged = out["broad_text_matches"].replace(
        "FROM matches GROUP BY l_orderkey, competition)", "FROM matches WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, competition)").replace(
        "  SELECT competition, unnest(regexp_extract_all(txt, {pat}, 1)) AS g1".format(pat=pat),
        "  SELECT l_orderkey, competition, unnest(range(len(regexp_extract_all(txt, {pat}, 1)))) AS nth, unnest(regexp_extract_all(txt, {pat}, 1)) AS g1".format(pat=pat)).replace(
        "  SELECT competition, {strip} AS home_team".format(strip=_strip_sql("g1")), "  SELECT l_orderkey, nth, competition, {strip} AS home_team".format(strip=_strip_sql("g1"))).replace(
        "SELECT {mid} AS match_id".format(mid=_match_id_sql('competition', 'season', 'phase', 'home_team', 'away_team', 'match_date')),
        "SELECT l_orderkey, nth, {mid} AS match_id".format(mid=_match_id_sql('competition', 'season', 'phase', 'home_team', 'away_team', 'match_date')))
    head, _, last = paged.rpartition("\nSELECT l_orderkey, nth, ")
    out["extract_fallback_limited"] = head + ",\nboth_kinds AS (\nSELECT l_orderkey, nth, " + last + " UNION ALL " + regular.replace(
        "  SELECT ", f"  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS nth, ", 1) + f""")
SELECT l_orderkey AS page_id, * EXCLUDE (l_orderkey, nth) FROM both_kinds
QUALIFY row_number() OVER (PARTITION BY competition ORDER BY l_orderkey, nth) <= {xq.LIMIT}"""
    out["single_element_matches"] = with_ctes(ADAPTER) + f""",
f AS (
  SELECT *, first_value(match_date) OVER (PARTITION BY l_orderkey ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS page_date
  FROM matches),
g AS (
  SELECT *, {_season_sql('page_date')} AS season, {_season_year_sql('page_date')} AS sy,
         strftime(page_date, '%Y-%m-%d') AS dtxt, concat('FC ', home_team) AS h, concat('FC ', away_team) AS a
  FROM f WHERE home_goals IS NOT NULL),
k AS (SELECT *, {_phase_case('competition', 'page_date', 'sy')} AS phase FROM g)
SELECT {_match_id_sql('competition', 'season', 'phase', 'h', 'a', 'dtxt')} AS match_id, competition, season,
       phase, dtxt AS match_date, h AS home_team, a AS away_team, home_goals, away_goals
FROM k"""
    return out


ORACLE.update(_extract_oracles())
