import random

from pyspark.sql import functions as F

from scoreline.operators.sequence import counted_chunks, phase_state, running_last

PHASES = ["LEAGUE_PHASE", "ROUND_OF_16", "UNKNOWN", None]


def _rows(seed=7, users=4, n=120):
    rnd = random.Random(seed)
    out = []
    for u in [None, *range(users)]:
        for pos in range(n):
            out.append((u, pos,
                        rnd.choice([None, None, None, f"d{rnd.randint(0, 9)}"]),
                        rnd.choice([None] * 6 + PHASES[:3]),
                        rnd.choice(["UNKNOWN", "UNKNOWN", "FINAL", "SEMI_FINAL"])))
    return out


def _simulate(rows):
    """Sequential reading of the carry rules, row by row."""
    out = {}
    state = {}
    for u, pos, val, explicit, inferred in sorted(rows, key=lambda r: r[1]):
        last, cnt, cur = state.get(u, (None, 0, "UNKNOWN"))
        if val is not None:
            last = val
        phase = cur
        if explicit is not None:
            phase = explicit
            cnt += 1
            cur = phase
        if phase == "UNKNOWN" and inferred != "UNKNOWN":
            phase = inferred
            cur = phase
        state[u] = (last, cnt, cur)
        out[(u, pos)] = (last, cnt, phase)
    return out


def test_chunked_equals_plain_equals_simulation(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "u int, pos int, val string, explicit string, inferred string")
    expect = _simulate(rows)
    for chunk in (None, F.floor(F.col("pos") / 7), F.floor(F.col("pos") / 50)):
        s = running_last(df, ["u"], ["pos"], "val", "last", chunk)
        assert {(r.u, r.pos): r.last for r in s.collect()} == {k: v[0] for k, v in expect.items()}
        p = phase_state(df, ["u"], ["pos"], chunk, "explicit", "inferred")
        assert {(r.u, r.pos): r.phase for r in p.collect()} == {k: v[2] for k, v in expect.items()}


def test_chunked_plan_reads_and_shuffles_its_input_once(spark):
    from scoreline.plans.sequence_queries import QUERIES
    for name in ("carry_forward_date", "carry_forward_phase"):
        made = QUERIES[name](spark, "/root/testdata/sf0.001")
        made.collect()
        final = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # the rows go through one exchange, by sequence and chunk, which both branches read
        assert final.count("Scan parquet") == 1, name
        assert final.count("ReusedExchange") == 1, name


def test_counted_chunks_are_bounded_where_one_value_holds_a_third(spark):
    rows = [(u, pos // 60 if 60 <= pos < 100 else pos, pos, *rest) for u, pos, *rest in _rows(seed=8)]    # a third of the rows at one time
    df = spark.createDataFrame(rows, "u int, at int, pos int, val string, explicit string, inferred string")
    order = {k: i for i, k in enumerate(sorted({(r[1], r[2]) for r in rows}))}
    expect = _simulate([(u, order[at, pos], *rest) for u, at, pos, *rest in rows])
    chunked = counted_chunks(df, ["u"], ["at", "pos"], rows=9)
    sizes = [r["count"] for r in chunked.groupBy("u", "chunk").count().collect()]
    assert max(sizes) == 9 and sum(sizes) == len(rows)
    s = running_last(chunked, ["u"], ["at", "pos"], "val", "last", F.col("chunk"))
    assert {(r.u, order[r["at"], r.pos]): r.last for r in s.collect()} == {k: v[0] for k, v in expect.items()}
    p = phase_state(chunked, ["u"], ["at", "pos"], F.col("chunk"), "explicit", "inferred")
    assert {(r.u, order[r["at"], r.pos]): r.phase for r in p.collect()} == {k: v[2] for k, v in expect.items()}
    assert counted_chunks(df.limit(0), ["u"], ["at", "pos"]).count() == 0
