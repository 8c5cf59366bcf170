import random

from pyspark.sql import functions as F

from scoreline.operators import pool
from scoreline.operators.numbering import number_rows


def _rows(spark, n=500):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]) if rng.random() > 0.5 else "hot", rng.choice([None, *range(40)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x int, `id.x` int")


def test_numbers_follow_a_total_order(spark):
    rows, df = _rows(spark)
    got = number_rows(df, [F.col("x").desc_nulls_last(), F.col("`id.x`")], name="place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    plan = number_rows(df, [F.col("x")])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_numbers_inside_groups_cut_a_hot_group(spark):
    rows, df = _rows(spark)
    got = number_rows(df.withColumn("n", F.lit("old")), [F.col("x").asc_nulls_first(), F.col("`id.x`")], ["g"], "n", total="all", ranges=16)
    place = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        place.update({r[2]: (i + 1, len(own)) for i, r in enumerate(own)})
    assert {r["id.x"]: (r["n"], r["all"]) for r in got.collect()} == place
    assert number_rows(df.limit(0), [F.col("x")], ["g"]).count() == 0 == number_rows(df.limit(0), [F.col("x")]).count()


def test_boards_have_no_unpartitioned_window(spark):
    board = spark.createDataFrame([("p", 3, 1.0), ("q", 3, 1.0), (None, None, None), ("r", 5, 0.1)], "jugador string, pts bigint, avg double")
    got = {r.jugador: r.place for r in pool.leaderboard_ordered(board).collect()}
    assert got == {"r": 1, "p": 2, "q": 3, None: 4}
    assert {r.jugador: r.place for r in pool.player_list(board.union(board)).collect()} == {"p": 1, "q": 2, "r": 3}
    for df in (pool.leaderboard_ordered(board), pool.player_list(board)):
        assert "Window" not in df._jdf.queryExecution().toString()
