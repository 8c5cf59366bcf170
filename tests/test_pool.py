from pyspark.sql import functions as F

from scoreline.operators import pool, standings


def test_pool_positions_use_league_points(spark, mk_matches):
    # 1 win (3 league pts, 2 pool pts); T2: 2 draws (2 league pts, 2 pool pts)
    m = mk_matches([("T1", "T3", 1, 0), ("T2", "T3", 0, 0), ("T2", "T4", 1, 1)])
    p = {r.team: (r.pts, r.pos) for r in pool.pool_table(standings.league_table(m)).collect()}
    assert p["T1"] == (2, 1)
    assert p["T2"] == (2, 2)


def test_leaderboard_edge_cases(spark, mk_matches):
    m = mk_matches([("T1", "T2", 2, 0), ("T1", "T3", 1, 1)], comp="UCL").unionByName(
        mk_matches([("T1", "T2", 0, 1)], comp="UEL"))
    pt = pool.pool_table(standings.league_table(m))
    picks = spark.createDataFrame(
        [("ana", "T1"), ("ana", "T1"),        # duplicate pick counts twice
         ("bo", "T9"),                        # only an unmatched team
         ("cy", "T2"), ("cy", "T9"),          # unmatched pick adds nothing
         (None, "T3")],                       # NULL player is its own group
        "jugador string, team string")
    b = {r.jugador: (r.pts, r.avg) for r in pool.leaderboard(picks, pt).collect()}
    # UCL 1W 1D -> 3 pool pts in 2 matches; UEL 1 loss -> 0 pts in 1 match (two rows per pick)
    assert b["ana"] == (6, 6 / 6)
    assert b["bo"] == (None, None)
    assert b["cy"] == (2, 1.0)       # T2: UCL loss (0) + UEL win (2) in 2 matches; T9 adds nothing
    assert b[None] == (1, 1.0)       # T3: one UCL draw


def test_headline_numbers_skip_null(spark):
    board = spark.createDataFrame([("a", 4, 1.0), ("b", None, None), ("c", 2, 0.5)],
                                  "jugador string, pts bigint, avg double")
    r = pool.headline_numbers(board).first()
    assert (r.n_players, r.total_points, r.mean_points) == (3, 6, 3.0)


def test_player_filter_pushed_to_picks(spark):
    from scoreline.sources import tables
    sf = "/root/testdata/sf0.001"
    d = pool.player_detail(pool.pool_table(standings.league_table(tables.matches(spark, sf))),
                           tables.participants(spark, sf), jugador="J3")
    plan = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join Inner" in x)
    assert any("= J3" in x and "Filter" in x for x in plan[join:])     # below the join
    assert d.where(F.col("jugador") != "J3").count() == 0


def test_orders_as_places(spark):
    board = spark.createDataFrame([("b", 4, 1.0), ("a", 4, 1.0), ("c", None, None), ("d", 4, 2.0)], "jugador string, pts bigint, avg double")
    assert [r.jugador for r in pool.leaderboard_ordered(board).orderBy("place").collect()] == ["d", "a", "b", "c"]
    assert [r.jugador for r in pool.player_list(board.union(board)).orderBy("place").collect()] == ["a", "b", "c", "d"]
    league = spark.createDataFrame([("X", "p", 3, 0, 1), ("X", "q", 3, 1, 1), ("Y", "r", 0, 0, 0)], "competition string, team string, pts int, gd int, gf int")
    assert {r.team: r.place for r in standings.ranked(league).collect()} == {"q": 1, "p": 2, "r": 1}


def test_flagship_scans_matches_once(spark):
    import __spark_entry__ as E
    plan = E.queries()["pool_leaderboard"](spark, "/root/testdata/sf0.001")._jdf \
        .queryExecution().executedPlan().toString()
    assert plan.count("lineitem") == 1
    assert plan.count("customer") == 1


def test_top_n_is_limited_before_the_exchange(spark):
    import __spark_entry__ as E
    plan = E.queries()["recent_matches_top10"](spark, "/root/testdata/sf0.001")._jdf \
        .queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
