import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from scoreline.llm import packing as K


def test_ends_have_least_padding():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        lengths = sorted(rng.sample(range(1, 60), n))
        histogram, k = [(x, rng.randint(1, 9)) for x in lengths], rng.randint(1, 5)

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in histogram)
        got = K.best_ends(histogram, k)
        best = min(padding((*c, lengths[-1])) for r in range(min(k, n)) for c in itertools.combinations(lengths[:-1], r))
        assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, None if i % 97 == 0 else "w " * int(rng.paretovariate(0.8))) for i in range(3000)] + [(7, "a b")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("number", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("tie", F.lit(3))
    got = K.pack(df, K.word_tokens(F.col("text")), buckets=6, token_budget=2000).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == len((r.text or "").split()) + 1 <= r.pad_to and r.number == 1 and r.tie == 3
        batches[r.batch_id].append(r)
    for batch in batches.values():
        assert len({(r.bucket, r.pad_to) for r in batch}) == 1
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].pad_to <= 2000
    assert len({r.bucket for r in got}) <= 6
    ends = sorted({r.pad_to for r in got})
    assert all(r.pad_to == min(e for e in ends if e >= r.n_tokens) for r in got)


def test_large_bucket_is_dealt_out_and_empty(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_ROWS", 100)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same length").alias("text"))
    got = K.pack(df, K.word_tokens(F.col("text")), token_budget=30).collect()
    assert len({r.batch_id.split("-")[1] for r in got}) > 5 and {r.pad_to for r in got} == {3}
    assert K.pack(df.limit(0), K.word_tokens(F.col("text"))).count() == 0


def test_pack_has_least_padding_over_long_lengths(spark):
    rng = random.Random(3)
    for k in (2, 4):
        lengths = rng.sample(range(513, 40_000), 10) + [3, 700]
        counts = {x: rng.randint(1, 4) for x in lengths}
        rows = [(i, x) for i, x in enumerate(x for x, c in counts.items() for _ in range(c))]
        got = K.pack(spark.createDataFrame(rows, "doc_id bigint, n bigint"), F.col("n"), buckets=k).collect()
        ends = sorted(lengths)
        want = min(sum(c * (min(e for e in (*cut, ends[-1]) if e >= x) - x) for x, c in counts.items())
                   for cut in itertools.combinations(ends[:-1], k - 1))
        assert sum(r.pad_to - r.n_tokens for r in got) == want and max(r.pad_to for r in got) == max(lengths)


def test_only_the_last_batch_of_a_bucket_is_short(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_ROWS", 100)
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit(3).alias("n"))
    got = defaultdict(list)
    for r in K.pack(df, F.col("n"), token_budget=21).collect():
        got[r.batch_id].append(r.slot)
    assert sorted(map(len, got.values())) == [2] + [7] * 143
    assert all(sorted(slots) == list(range(len(slots))) for slots in got.values())
