import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from scoreline.llm import toxicity as X


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    sizes = [1, 5, 3, 7]
    e = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(e), bool)
    first[np.append(0, np.cumsum(sizes)[:-1])] = True
    got, at = X.marginals(e, first, start, step), 0
    for n in sizes:
        weight, toxic = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(start[y[0]] + sum(step[a, b] for a, b in zip(y, y[1:])) + sum(e[at + i] for i in range(n) if y[i]))
            weight += w
            toxic += w * np.array(y)
        assert np.allclose(got[at:at + n], toxic / weight)
        at += n
    long = rng.normal(size=1000)
    whole = X.marginals(long, np.arange(1000) == 0, start, step)
    split = X.marginals(np.concatenate([long, long]), np.isin(np.arange(2000), (0, 1000)), start, step)
    assert np.allclose(split, np.concatenate([whole, whole]))


def corpus(rng, n):
    stems = [f"bad{c}st" for c in "abcdefgh"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshrdlucmfwypvk") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", "en", "s", "lich"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_spans_and_odd_rows(spark):
    rng = random.Random(6)
    docs, labels = corpus(rng, 900)
    docs += [(None, None), (5000, ""), (5001, "badastlich " * 3000), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    model = X.fit(df, marks)
    rows = X.score(df, model).withColumn("out", X.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth, text = dict(labels), {}
    for i, t in docs:
        text.setdefault(i, t)
    held = [r for r in rows if r.out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    found = [text[r.doc_id][s.start:s.end] for r in held if truth[r.doc_id] for s in r.spans]
    assert len(found) > 20 and sum(w.startswith("bad") for w in found) >= 0.9 * len(found)
    (long,) = [r for r in rows if r.doc_id == 5001]
    assert long.predicted == 1
    kept = X.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_labels_missing_or_of_one_kind(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for marks in (none, spark.createDataFrame([(1, 0)], none.schema), spark.createDataFrame([(1, 1)], none.schema)):
        got = X.score(df, X.fit(df, marks)).collect()
        assert len({r.score for r in got}) == 1
    assert X.score(df.limit(0), X.fit(df.limit(0), none)).count() == 0
