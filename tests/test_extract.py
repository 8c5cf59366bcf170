"""Extraction on small pages, with the rows that the rules give written out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoreline.functions import html_elements as H
from scoreline.operators import extract

AS_OF = dt.date(2026, 3, 1)
PAGES = "page_id {}, competition string, html string"


def line(*kids, cls="event__match"):
    return f'<div class="{cls}">{"".join(kids)}</div>'


def box(cls, text):
    return f'<div class="{cls}">{text}</div>'


def team(*names):
    return "".join(box("event__participant", n) for n in names)


def read(spark, pages, id_type="long", **options):
    df = spark.createDataFrame(pages, PAGES.format(id_type))
    return extract.extract_matches(spark, df, as_of=F.lit(AS_OF), **options)


def rows(spark, html, comp="UCL", **options):
    got = read(spark, [(1, comp, html)], **options).orderBy("pos", "home_team").collect()
    return [(r.home_team, r.away_team, r.home_goals, r.away_goals, r.match_date, r.phase) for r in got]


def test_dates_and_rounds_of_lines_and_their_parent(spark):
    html = ("<div>" + box("event__round", "Round of 16")
            + line(box("event__time", "10.12."), team("1. Arsenal", "Bayern"), box("event__score", "2"), box("event__score", "1"))
            + line(team("Inter", "PSV"), box("x", "1 : 1"))
            + line(team("Ajax", "Celtic"))                                                   # no score
            + line(box("event__stage", "Semi-finals"), box("event__time", "5 Nov 2025"), team("Lyon", "Betis"), box("x", "0:2"))
            + line(team("Lille", "Roma"), box("x", "3:1")) + "</div>")
    # a line without a round or date asks its parent: the header, and the first
    # date element, whose "10.12." reads as 10 January by the d.m quirk
    assert rows(spark, html) == [
        ("Arsenal", "Bayern", 2, 1, "2025-12-10", "ROUND_OF_16"),
        ("Inter", "PSV", 1, 1, "2026-01-10", "ROUND_OF_16"),
        ("Lyon", "Betis", 0, 2, "2025-11-05", "SEMI_FINAL"),
        ("Lille", "Roma", 3, 1, "2026-01-10", "ROUND_OF_16")]


def test_dates_and_rounds_carry_along_a_page(spark):
    html = "".join(f"<section>{x}</section>" for x in (
        line(team("Ajax", "PSV"), box("x", "1:0")),
        line(box("time", "02.10.2025"), box("round", "Playoff"), team("Inter", "Roma"), box("x", "1:1")),
        line(team("Lille", "Porto"), box("x", "2:1")),
        line(box("round", "unknown"), box("time", "20.11.2025"), team("Lyon", "Betis"), box("x", "0:2")),
        line(team("Genk", "Celta"), box("x", "3:1"))))
    assert [r[0:1] + r[4:] for r in rows(spark, html)] == [
        ("Ajax", "2026-03-01", "UNKNOWN"), ("Inter", "2025-10-02", "PLAY_OFF"), ("Lille", "2025-10-02", "PLAY_OFF"),
        ("Lyon", "2025-11-20", "LEAGUE_PHASE"), ("Genk", "2025-11-20", "LEAGUE_PHASE")]


def test_the_page_header_counts_for_any_number_of_lines(spark):
    for n in (1, 9, 10, 11, 30):
        html = "<div>" + box("round", "Semi-finals") + "".join(
            line(box("time", f"{i % 28 + 1:02d}.10.2025"), team(f"Home {chr(65 + i)}", f"Away {chr(65 + i)}"), box("x", "1:0")) for i in range(n)) + "</div>"
        assert {r[5] for r in rows(spark, html)} == {"SEMI_FINAL"} and len(rows(spark, html)) == n


@pytest.mark.parametrize("kids, home, away", [
    (team("FC X", "FC X", "FC Y"), "FC X", "FC Y"),                              # the third name stands in
    ("<span>Lyon</span><span>Betis</span>", "Lyon", "Betis"),                    # from the text's parts
    ("<a class=participant href=/t/>Arsenal</a><a class=participant href=/t/>Bayern</a>", "Arsenal", "Bayern"),
    (team("Real&nbsp;Madrid", "Inter&nbsp; "), "Real Madrid", "Inter"),
    ('<div class="participant"">Genk</div><div class=\'participant\'>Celta</div>', "Genk", "Celta"),
])
def test_teams(spark, kids, home, away):
    assert [r[:2] for r in rows(spark, line(kids, box("time", "01.02.2026"), box("x", "2:1")))] == [(home, away)]


@pytest.mark.parametrize("score, goals", [
    (box("x", "2 : 1"), (2, 1)), (box("x", "2&nbsp;:&nbsp;1"), (2, 1)), (box("s", "3") + box("s", "0"), (3, 0)),
    (box("event__score", "<b>4</b><i>|</i><b>2</b>"), (4, 2)), (box("x", "3000000000:1"), (3000000000, 1)),
])
def test_scores(spark, score, goals):
    assert [r[2:4] for r in rows(spark, line(box("time", "1 Feb 2026"), team("Ajax", "Celtic"), score))] == [goals]


def test_a_score_no_number_holds_is_counted_not_lost(spark):
    df = spark.createDataFrame([(1, "UCL", line(team("Ajax", "Celtic"), box("x", "9" * 30 + ":1")))], PAGES.format("long"))
    _, outcomes, _ = extract.extract_matches(spark, df, as_of=F.lit(AS_OF), with_outcomes=True)
    assert [r.outcome for r in outcomes.collect()] == ["bad_score"]


def test_rejected_lines(spark):
    html = (line("<span>England</span><span>Spain</span><span>1</span><span>0</span><span>07.11.2025</span>")
            + line("<span>Porto</span><span>Braga</span><span>0</span><span>2</span><span>01.01.2024</span>")
            + line(team("Ajax", "Ajax"), box("x", "1:1"))
            + line("<span>Lyon</span><span>Betis</span><span>2</span><span>0</span><span>06.11.2025</span>"))
    assert [r[:2] for r in rows(spark, html)] == [("Lyon", "Betis")]


def test_broad_rule_only_where_nothing_else_was_found(spark):
    text = "<p>Yesterday Rakow 2 : 1 Rapid Wien and then</p><script>var s = 'Fake One 9 : 9 Fake Two';</script>"
    found = line("<span>Lyon</span><span>Betis</span><span>2</span><span>0</span><span>06.11.2025</span>")
    assert [r[:4] for r in rows(spark, "<div>" + text + "</div>")] == [("Yesterday Rakow", "Rapid Wien and then", 2, 1)]
    assert [r[:2] for r in rows(spark, text + found)] == [("Lyon", "Betis")]
    assert rows(spark, "<p>Nothing here 12 : 00</p><!-- Aaa 1 : 2 Bbb -->") == []


def test_a_limit_does_not_bring_broad_finds_back(spark):
    def page(n):
        both = "<p>Napoli Club 3 : 1 Torino Club</p>" + line(box("time", f"0{n}.10.2025"), team(f"Ajax{n}", "PSV"), box("x", "1:0"))
        return (n, "UCL", both)
    broad = "<p>Rakow Club 2 : 1 Rapid Club, Genk Club 0 : 0 Brugge Club, Lyon Club 1 : 4 Betis Club</p>"
    got = read(spark, [page(1), page(2), page(3)], "long", limit=2).collect()
    assert sorted((r.page_id, r.home_team) for r in got) == [(1, "Ajax1"), (2, "Ajax2")]
    got = read(spark, [page(1), (2, "UCL", broad), page(3)], "long", limit=3).collect()
    assert sorted((r.page_id, r.home_team) for r in got) == [(1, "Ajax1"), (2, "Genk Club"), (2, "Rakow Club")]
    # a broad find does not set the phase of the elements that are read after it
    odd = "<p>Rakow Club 2 : 1 Rapid Club</p>" + line(team("England", "Lyon"), box("x", "1:1"))
    got = read(spark, [(1, "UCL", odd)], "long").collect()
    assert [(r.home_team, r.pos, r.match_date) for r in got] == [("Rakow Club", -1, "2026-03-01")]


def test_broad_rule_is_linear(spark):
    page = "a " * 100_000 + "Ajax Club 2 : 1 Celtic Club"
    df = spark.createDataFrame([(1, "UCL", page)], "page_id long, competition string, page_text string")
    (r,) = extract.broad_matches(df, F.lit(AS_OF)).collect()
    assert (r.home_goals, r.away_goals, r.away_team) == (2, 1, "Celtic Club")


def test_parameters_limit_and_ids(spark):
    html = "".join(line(box("time", f"{d:02d}.10.2025"), team(f"Home {d}x", f"Away {d}x"), box("x", "1:0")) for d in range(1, 6))
    pages = [("a", "UCL", html), ("a", "UEL", line(team("Lyon", "Betis"), box("x", "1:1"))), ("b", "UCL", html)]
    params = spark.createDataFrame([("UCL", "2030/2031", dt.date(2025, 10, 2), dt.date(2025, 10, 4))],
                                   "competition string, season string, window_start date, window_end date")
    got = read(spark, pages, "string", params=params).collect()
    assert sorted((r.page_id, r.competition, r.match_date) for r in got) == sorted(
        [(p, "UCL", f"2025-10-0{d}") for p in "ab" for d in (2, 3, 4)] + [("a", "UEL", "2026-03-01")])
    assert {r.season for r in got if r.competition == "UCL"} == {"2030/2031"}
    got = read(spark, pages, "string", limit=2).collect()
    assert sorted((r.competition, r.page_id, r.pos) for r in got) == [("UCL", "a", 0), ("UCL", "a", 1), ("UEL", "a", 0)]


def test_counters(spark):
    html = (line(team("Ajax", "Celtic"), box("x", "1:1")) + line(team("Ajax", "PSV")) + line(box("x", "1:1"))
            + line(team("England", "Lyon"), box("x", "2:2")))
    df = spark.createDataFrame([(1, "UCL", html), (2, "UCL", "<p>Aaa Club 1 : 2 Bbb Club</p>"), (3, "UCL", None)], PAGES.format("long"))
    _, outcomes, broad = extract.extract_matches(spark, df, as_of=F.lit(AS_OF), with_outcomes=True)
    got = {r.page_id: tuple(r)[2:] for r in extract.outcome_counters(outcomes, broad, df).collect()}
    assert got == {1: (4, 1, 1, 1, 1, 0), 2: (0, 0, 0, 0, 0, 1), 3: (0, 0, 0, 0, 0, 0)}


def test_single_element_reading(spark):
    pages = [(7, "UCL", "<div><span class='date'>02.10.2025</span><span class='round'>Group B</span>"
              "<div class='event__match'><span class='team'>Real Madrid</span><span class='team'>Napoli</span><span>2 : 1</span></div>"
              "<div class='event__match'>Lille 3:0 Roma</div><div class='event__match'>no score here</div></div>"),
             (8, "UEL", "<div class='event__match'>Porto 1 : 1 Braga</div>")]
    got = {(r.home_team, r.away_team): r for r in extract.single_element_matches(
        spark.createDataFrame(pages, PAGES.format("long")), as_of=F.lit(AS_OF)).collect()}
    assert set(got) == {("Real Madrid", "Napoli"), ("Lille", "Roma"), ("Porto", "Braga")}
    a, b = got["Real Madrid", "Napoli"], got["Porto", "Braga"]
    assert (a.home_goals, a.away_goals, a.match_date, a.phase, a.season) == (2, 1, "2025-10-02", "LEAGUE_PHASE", "2025/2026")
    assert (b.match_date, b.season, b.phase) == ("2026-03-01", "2025/2026", "UNKNOWN")


def test_page_helper_on_odd_markup():
    for doc in (None, "", "<", "</div></div>", "<div class=event__match", "<p>" * 3000, "&#0;&bogus;"):
        H.page_records(doc)
    recs, text = H.page_records("<div class='event__match'>A &amp; B<style>x 1:1</style><br/>C</div>")
    assert recs[0]["full_text"] == "A & B | C" and text == "A & BC"
    recs, _ = H.page_records("<div class=event>" + "<div class=event__match><span>one team</span></div>" * 3 + "</div>")
    assert len(recs) == 3                                     # the first selector with a hit


def test_display_headers(spark):
    from scoreline.operators import pool
    df = spark.createDataFrame([("a", 3, 1.5, 1.5)], "jugador string, pts bigint, avg double, avg_rounded double")
    assert pool.for_display(df, pool.LEADERBOARD_HEADERS).columns == ["Jugador", "Points", "Average", "Avg (Rounded)"]


PLAIN_PAGES = [
    '<html><head><title>R</title></head><body><div class="x event__match y"><span class=date>01.02.2024</span>'
    "<a class='participant' href=/t/>FC&nbsp;A</a><br><a class=participant href=/t/>FC B</a><i>1 : 2</i></div></body></html>",
    '<div class="round">Final</div><div><span class="event__date"">3 May 2024</span><div class="event__match">A 1:2 B</DIV></div></p><b>',
    '<div class="a"" id=\'event\' class="event">1:2</div><div data-testid="match-row">3:4</div>',
]


@pytest.mark.parametrize("page", PLAIN_PAGES)
def test_plain_markup_is_read_as_the_library_reads_it(page):
    builder = H._Builder()
    builder.feed(page)
    builder.close()
    shape = lambda root: [(n.tag, n.cls, n.testid, n.parent.at, n.end, n.strings()) for n in root.descendants()]
    assert H._parse_plain(page) is not None and shape(H._parse_plain(page)) == shape(builder.page.finish())


def test_other_markup_is_left_to_the_library():
    for page in ("<script>a<b</script>", "<!-- <div> -->", "a<b", "x &amp", '<div class="a>b">', "<p/>", "text", "<title>a<b></title>"):
        assert H._parse_plain(page) is None
    assert H.page_records("<div class=event__match><script>1</script><template>x<i>y</i></template>z</div>")[0][0]["full_text"] == "z"


def test_broad_rule_does_not_repeat_its_patterns_in_a_filter(spark):
    df = spark.createDataFrame([(1, "UCL", "Club A 3 : 4 Club B, Club  C 1:2 Club D")], "page_id long, competition string, page_text string")
    b = extract.broad_matches(df, F.lit(AS_OF))
    assert [(r.home_team, r.away_team, r.home_goals, r.away_goals) for r in b.orderBy("hit_no").collect()] == [
        ("Club A", "Club B", 3, 4), ("Club  C", "Club D", 1, 2)]
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract" in x]


def test_lines_are_dealt_out_by_order_before_they_are_rendered(spark):
    from scoreline.plans import extract_queries
    plan = extract_queries.result_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchange = next(x for x in plan.splitlines() if "Exchange" in x)
    assert plan.count("Exchange hashpartitioning") == 1 and "l_orderkey" in exchange
    assert plan.index("participant") < plan.index("Exchange")          # a plan is printed from its end


def test_only_pages_without_a_match_are_searched_by_the_broad_rule(spark):
    """The pattern stands behind the page pass, which sorts the rows once."""
    df = spark.createDataFrame([(1, "UCL", f"<p>Club A 1 : 2 Club B, FC Ajax 1 : 1 FC Porto, Club C 3 : 0 Club D</p>{line(team('FC One', 'FC Two'), box('score', '1'))}"),
                                (2, "UCL", "<p>Club A 1 : 2 Club B, and 4 : 4 , Club C 3 : 0 Club D</p>"),
                                (2, None, "<p>Club E 5 : 2 Club F</p>"),
                                (3, "UCL", f"<p>Club G 1 : 2 Club H</p>{line(team('FC One', 'FC Two'), box('score', '1'), box('score', '2'))}")], PAGES.format("long"))
    found = extract.extract_matches(spark, df, as_of=F.lit(AS_OF))
    got = sorted((r.page_id, r.pos, r.home_team, r.home_goals, r.season) for r in found.collect())
    assert [g for g in got if g[0] > 1] == [(2, -1, "Club A", 1, "2025/2026"), (2, -1, "Club C", 3, "2025/2026"),
                                             (2, -1, "Club E", 5, "2025/2026"), (3, 0, "FC One", 1, "2025/2026")]
    assert [g[2:4] for g in got if g[0] == 1] == [("Club A", 1), ("Club C", 3), ("FC Ajax", 1)]
    # the plan is printed from the result down to the scan
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Window") and "regexp_extract_all" not in plan[plan.rindex("Window"):]
    steps = found._jdf.queryExecution().executedPlan().toString()
    steps = steps.split("Initial Plan")[-1]
    assert steps.count("Sort [") == 1 and steps.count("Exchange ") == 1


def test_a_page_of_plain_marks_is_cut_at_them_alone():
    for page in ("a <b", "<b>x", "<title>a&amp;b</title>", "<title>a<b></title>", "<b>a</ b>", "<script></script>", "text", "<a href=\">\">"):
        assert H._parse_plain(page) is None
    root = H._parse_plain("x &lt; y<TITLE>a > b</title><div class=Score>1 > 0&nbsp;</DIV><br><template><p>z</p></template>")
    assert root.text() == "x < ya > b1 > 0\xa0"
    assert [n.tag for n in root.descendants()] == ["title", "div", "br", "template", "p"]


def test_a_page_is_read_in_flat_lists_and_its_records_follow_from_them():
    """F8: places of marks, not an object for each element."""
    page = H.parse('x<div class="event__match"><a class=participant>A <b>B</b></a><template>t<i>u</i></template>'
                   "<span class=score>1</span> : 2<br></div><div class=event__match><p>only</div>")
    assert [page.marks[i][0] for i in page.chosen] == ["div", "a", "span", "div"]
    first, last = H.match_elements(page)
    assert page.joined(first, "|") == "A|B|1|: 2" and page.text(last) == "only"
    assert H.element_record(page, first)["participants"] == ["AB"] and H.element_record(page, first)["score_texts"] == ["1"]
    assert page.joined(page.select(first, ("span",), H.SCORE)[0]) == "1" and page.first(last, ("div",), H.DATE) is None
    recs, text = H.page_records("<div class=event__match>a<!-- c -->b</div>")
    assert recs[0]["full_text"] == "a | b" and text == "ab"       # strings of their own, as the library gives them


def test_the_job_of_the_elements_is_cut_into_small_tasks(spark):
    """The rows shuffled to it are narrow, what they take is long."""
    from scoreline.session import small_tasks
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    with small_tasks(spark):
        assert int(spark.conf.get(keys[1])) >= 4 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(k, None) for k in keys] == before


def test_rows_of_the_page_pass_are_sorted_by_page_id_first(spark):
    found = read(spark, [(1, "UCL", line(team("FC One", "FC Two"), box("score", "1"), box("score", "2")))])
    steps = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    order = next(x for x in steps.splitlines() if "Sort [" in x)
    assert order.index("page_id") < order.index("competition")


def test_single_elements_are_written_once_by_compiled_rules(spark):
    """the rules of an element run as their own job, not as one method that is only interpreted."""
    pages = [(1, "UCL", "<div><span class=date>31.02.2025</span><div class=event__match>Lille 3:0 Roma 7 : 12 x</div></div>"),
             (2, "UCL", "<div><span class=date>5/8/2025</span><div class=event__match>A 13:0\xa0B 3:0</div><div class=event__match>1:1 C</div></div>")]
    found = extract.single_element_matches(spark.createDataFrame(pages, PAGES.format("int")), as_of=F.lit(AS_OF))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.page_id, r.pos, r.home_team, r.home_goals, r.away_goals, r.away_team, r.match_date, r.season) for r in found.collect())
    assert got == [(1, 0, "Lille", 3, 0, "Roma", "2024-01-01", "UNKNOWN"), (2, 0, "A", 13, 0, "B", "2025-08-05", "2025/2026")]


def test_the_single_element_rules_compile_no_pattern_a_row(spark, monkeypatch):
    """F2: a split by a pattern compiles it for each row; only a name with a colon behind its score is split."""
    monkeypatch.setattr(extract.F, "split", lambda text, pattern: F.lit(None).cast("array<string>"))
    pages = [(1, "UCL", "<div class=event__match>Lille 3:0 Roma</div>")]
    found = extract.single_element_matches(spark.createDataFrame(pages, PAGES.format("int")), as_of=F.lit(AS_OF))
    assert [r.away_team for r in found.collect()] == ["Roma"]


def test_the_element_rules_copy_a_row_few_times(spark):
    """each step that is not fused copies the row, so independent ones share a step."""
    pages = spark.createDataFrame([(1, "UCL", line(team("FC One", "FC Two"), box("score", "1"), box("score", "2")))], PAGES.format("int"))
    rows = extract.element_fields(extract.html_elements_frame(pages), F.lit(AS_OF))
    states = extract.own_state(rows, F.lit(AS_OF), F.lit(None).cast("string")).select(*extract.STAGE_COLUMNS)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Project [") <= 12


@pytest.mark.parametrize("text, norm", [
    ("a | b", "a|b"), (" a | b ", "a|b"), ("4 | | | 3", "4|||3"), ("a | b | c", "a|b|c"), ("a  |  b", "a|b"), ("|", "|"), (" | ", "|"),
    ("a|b |c| d", "a|b|c|d"), ("", ""), (None, None), ("a b | c d", "a b|c d"), ("| | |", "|||")])
def test_parts_are_trimmed_however_they_come(spark, text, norm):
    assert spark.createDataFrame([(text,)], "t string").select(extract.normalized_parts_text(F.col("t"))).first()[0] == norm
