import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from test_suffix_dedup import brute
from test_simhash_vpt import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_names_are_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffix_dedup", "packing"]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, after[-1], SF).write.parquet(f"{tmp_path}/{name}")
        after.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if k < 3:
            assert after[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in d.collect()} for d in after]
    # toxicity: a subset, unchanged, and most of it kept
    assert all(rows[0][i] == r for i, r in rows[1].items()) and len(rows[1]) > 0.75 * len(rows[0])
    # one document of each SimHash component stays
    ids = sorted(rows[1])
    comp = brute_components([brute_fingerprint(rows[1][i].text) for i in ids])
    assert sorted(rows[2]) == sorted({min(i for i, c in zip(ids, comp) if c == want) for want in set(comp)})
    # repeated passages go, whole characters at a time
    ids = sorted(rows[2])
    raw = [(i, rows[2][i].text.encode()) for i in ids]
    for (i, t), mask in zip(raw, brute(raw)):
        assert rows[3][i].n_chars == len(rows[3][i].text)
        gone = len(t) - len(rows[3][i].text.encode())
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        assert sum(mask) - 6 * spans <= gone <= sum(mask)
    # packing: every row once
    assert sorted(rows[4]) == ids and after[4].count() == len(ids)
    assert P.run(spark, SF).count() == len(ids)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_planted_cases(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = {i: text(rng.randint(80, 200)) for i in range(400)}
    passage = text(60)
    for i in (11, 50, 303):
        rows[i] = f"{text(40)} {passage} {text(40)}"
    rows[390], rows[391] = rows[20], rows[21]
    toxic = set(range(0, 400, 9)) - {0}
    for i in toxic:
        words = rows[i].split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["vilename", "fouljerk", "nastyrat"]))
        rows[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", F.lit(1).alias("quality"), F.col("doc_id").isin(list(toxic)).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert not toxic & set(got) and 390 not in got and 391 not in got
    assert len(set(rows) - toxic - {390, 391} - set(got)) <= 4          # clean documents stay
    assert passage in got[11].text and all(passage not in got[i].text for i in (50, 303) if i in got)


def test_odd_rows_and_columns(spark):
    long = " ".join(f"word{i % 977} next{i % 1009}" for i in range(60_000))
    passage = "a passage that stands in two of the documents and is longer than fifty bytes by far"
    rows = [(1, f"one {passage} end", 3), (2, f"two other words {passage}", None), (2, f"two other words {passage}", None), (3, None, None),
            (None, "no id", 5), (None, None, None), (4, "", 0), (5, long, 1), (6, "same id first text here", 1), (6, "same id and quite another text", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").select(
        "*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("keep me").alias("cut_text"), F.lit("and me").alias("cut_kept"),
        F.lit("dots").alias("a.b"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.lit("x").alias("row"), F.lit("y").alias("tie"),
        F.lit(7).alias("bucket"), F.lit("z").alias("others"))
    kept = P.drop_copies(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    got = kept.collect()
    assert sorted([r.doc_id for r in got if r.doc_id is not None]) == [1, 2, 3, 5, 6, 6] and sum(r.doc_id is None for r in got) == 2
    cut = P.cut_passages(spark, docs, "")
    assert cut.dtypes == docs.dtypes
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(texts) == 10 and (1, f"one {passage} end") in texts and texts.count((2, "two other words")) == 2 and (5, long) in texts
    assert all((r.cut_text, r.cut_kept, r["a.b"], r.others, r.n_chars) == ("keep me", "and me", "dots", "z", len(r.text)) for r in cut.collect())
    packed = P.pack_batches(spark, docs, "").collect()
    assert len(packed) == 10 and {r["a.b"] for r in packed} == {"dots"} and all(r.m == {"k": r.doc_id} for r in packed)
    for stage in (P.drop_copies, P.cut_passages, P.pack_batches):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_toxicity_stage_keeps_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    train = [(i, text(60) + " vilename fouljerk" * (i % 9 == 0) + text(20)) for i in range(400)]
    df = spark.createDataFrame(train, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None), (1, ""), (1, ""), (2, f"{train[1][1]} " * 2_000), (3, f"{text(30)} vilename fouljerk {text(30)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("k").alias("a.b"), F.lit("c").alias("score"))
    got = P.drop_toxic(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 2]
