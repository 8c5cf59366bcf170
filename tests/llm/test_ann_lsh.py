import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import ann_lsh as A


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return [(int(ids[keep][i]), float(d[keep][i])) for i in order]


def test_probe_order_is_complete_and_by_cost():
    order = A.probe_order(4)
    assert len(order) == 3**4 and len({tuple(r) for r in order}) == 3**4 and not order[0].any()
    assert all(not (r[j] and r[7 - j]) for r in order for j in range(4))


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_and_exact_scores(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] * 4 + 0.2 * x
        x[:1000] = x[0] + 1e-3 * rng.normal(size=(1000, 24))           # one group holds a third of all rows
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(3000)
    df = frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    got = {}
    for r in A.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    assert sorted(got) == list(range(0, 3000, 100))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(r[2], r[1]) for r in rows] == sorted((r[2], r[1]) for r in rows)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert all(abs(s - d[v]) < 1e-9 and v != q for _, v, s in rows)
        hits += len({v for v, _ in brute(ids, x, q, 10)} & {r[1] for r in rows})
    assert hits >= 0.9 * 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [0.0, 0.0]), (4, None), (5, []),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (200, None), (300, [0.0, 0.0])]
    df = frame(spark, rows).withColumn("key", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = A.nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    by = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100, 200, 300)}
    root = round(2 ** 0.5, 6)
    assert by == {0: [(100, 0.0), (2, 0.5), (1, root)], 100: [(0, 0.0), (2, 0.5), (1, root)], 200: [], 300: []}
    assert A.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert A.nearest_neighbours(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_few_found_are_searched_exactly(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(np.float64)
    monkeypatch.setattr(A, "fit", lambda sample, k, target: A.Tables(8, 1e-6, 1))   # no two rows share a bucket
    got = A.nearest_neighbours(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 100 == 0, k=3).collect()
    for q in (0, 100, 200):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [v for v, _ in brute(np.arange(300), x, q, 3)]


def test_repeated_id_hides_no_neighbour(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(0, 0.0)] + [(1, 0.1 + i / 1000) for i in range(50)] + [(2 + i % 30, 0.2 + i / 100) for i in range(60)]
    rows = [(i, [1.0, x, float(e)]) for (i, x), e in zip(rows, rng.normal(size=len(rows)) * 1e-3)]
    x = np.array([v for _, v in rows]).astype(np.float32).astype(np.float64)
    low = {}
    for (i, _), d in zip(rows, np.sqrt(((x - x[0]) ** 2).sum(1))):
        low[i] = min(d, low.get(i, d))
    want = sorted((d, i) for i, d in low.items() if i)[:10]
    for width in (1e-6, 1e6):                            # the exact search, and one bucket for all rows
        monkeypatch.setattr(A, "fit", lambda sample, k, target, width=width: A.Tables(3, width, 1))
        got = sorted((r.score, r.vec_id) for r in A.nearest_neighbours(frame(spark, rows), F.col("vec_id") == 0).collect())
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want])
