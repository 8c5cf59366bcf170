import hashlib
import random

from pyspark.sql import functions as F

from scoreline.llm import sketch


def edited(rows):
    """rows: (id, text) in order; what the contract asks for."""
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        out.append((i, len(t), t[:len(t) - q] + n[:q]))
    return out


def test_edited_texts_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(i * 3 - 50, "".join(rng.choice("ab é😀\n") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("bucket", F.lit("clash"))
    for ranges in (1, 7, 64):
        got = sketch.edited_texts(df, ranges=ranges).select("doc_id", "n_chars", "edited").collect()
        assert sorted(map(tuple, got)) == edited(rows)


def test_nulls_repeats_one_row_no_rows(spark):
    one = spark.createDataFrame([(4, "abcdefgh")], "doc_id bigint, text string")
    assert [tuple(r) for r in sketch.edited_texts(one).select("doc_id", "n_chars", "edited").collect()] == [(4, 8, "abcdefab")]
    assert sketch.edited_texts(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "x y z w v u"), (1, "same text here"), (1, "same text here"), (2, "")], one.schema)
    got = sketch.edited_texts(odd, ranges=4).collect()
    assert len(got) == 5 and sum(r.n_chars for r in got) == 11 + 28


def test_sketches(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = " ".join(rng.choice(words) for _ in range(4000))
    half = " ".join(text.split()[:2000])
    rows = [(1, text), (2, half), (3, text.upper().replace(" ", "\t ")), (4, ""), (5, None), (6, "one"), (7, "one"), (8, "two words"),
            (9, "\u00a0"), (10, text + " tail")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in sketch.fingerprints(df).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[6].fingerprint == got[7].fingerprint != got[8].fingerprint
    assert got[4].fingerprint == got[5].fingerprint == "" and got[6].sketch and got[9].sketch
    assert abs(len(got[1].sketch) - 3996 / 8) < 70                     # a fixed share of all shingles
    assert set(got[2].sketch) <= set(got[1].sketch)                    # a part's sketch is part of the whole's
    pair = df.where("doc_id = 1").crossJoin(F.broadcast(df.where("doc_id = 2").withColumnRenamed("text", "other")))
    pair = sketch.with_sketch(sketch.with_sketch(pair, "text", "a"), "other", "b")
    r = pair.select(sketch.containment(F.col("b"), F.col("a")).alias("held"), sketch.likeness(F.col("a"), F.col("b")).alias("like")).first()
    assert r.held == 1.0 and 0.4 < r.like < 0.6


def test_query_digests(spark, tmp_path):
    from scoreline.llm.queries import op10_fingerprint
    rows = [(1, "aaaa bbbb"), (3, "ccccé"), (9, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_fingerprint(spark, str(tmp_path)).collect()}
    for i, n, text in edited([(i, t or "") for i, t in rows]):
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def brute_sketch(text):
    import re
    from xxhash import xxh64_intdigest
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    every = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        fold = 42                                                      # as Spark hashes an array: each element's hash seeds the next
        for w in words[k:k + 5]:
            fold = xxh64_intdigest(xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), fold)
        every.add(fold)
    return {h for h in every if h < 1 << 61} or ({min(every)} if every else set())


def test_query_equals_brute_force(spark, tmp_path):
    from scoreline.llm.queries import op10_fingerprint
    rng = random.Random(5)
    words = [f"{c}{i}" for i in range(60) for c in ("W", "é")]
    rows = [(i * 2, rng.choice([" ", "\t", "\n "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 30, 300])))) for i in range(60)]
    rows += [(1, rows[0][1]), (200, None), (202, rows[-1][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_fingerprint(spark, str(tmp_path)).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    text = lambda s: "".join(f"{h:016x}" for h in sorted(s, key=signed))
    for k, (i, _, after) in enumerate(edited(rows)):
        own, new, other = (brute_sketch(t) for t in (rows[k][1], after, rows[(k + 1) % len(rows)][1]))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(new)), i
        assert (r.near_edited, r.near_next) == (like(own, new), like(own, other)), i
