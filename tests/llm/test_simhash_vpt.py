import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scoreline.llm import simhash_vpt as S


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=2):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def near_points(rng, n):
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        p = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            p ^= 1 << b
        out.append(p)
    return out


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one two", "É É é é", "a\u00a0b c", "word " * 5000] + \
        [" ".join(rng.choice(["Alpha", "beta", "γ", "Δ", "x"]) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = {r.id: r.fp & (2**64 - 1) for r in S.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    assert S.text_fingerprint(b"a b c d e f g", block=2) == brute_fingerprint("a b c d e f g")


def test_tree_loses_no_link():
    rng = random.Random(2)
    points = sorted(set(near_points(rng, 300)))
    array = np.array(points, np.uint64)
    want = brute_components(points)
    for leaf in (4, 32, 1000):
        parent = list(range(len(points)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        pairs = S.shard_links(array, leaf)
        for i, j in pairs.tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(points))] == want
        assert len(pairs) < len(points)                  # a forest, not all pairs
    tree = S.grow_tree(array[::3], 20)
    shards = {}
    for number, at in S.route(tree, array):
        shards.setdefault(number, set()).update(at.tolist())
    assert len(shards) > 3
    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= 2:
                assert any(i in s and j in s for s in shards.values())


def test_components_of_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(400))
    texts = [base, base + " tail", base, None, "", "   ", "short text", None] + [" ".join(f"w{rng.randint(0, 999)}" for _ in range(50)) for _ in range(30)]
    ids = [7, 3, 9, 12, 11, 10, None, None, *range(20, 50)]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").withColumn("root", F.lit("clash"))
    prints = [brute_fingerprint(t or "") for t in texts]
    comp = brute_components(prints)
    low = {c: min((i for i, x in zip(ids, comp) if x == c and i is not None), default=None) for c in set(comp)}
    want = sorted((str(i), f"{p:016x}", str(low[c])) for i, p, c in zip(ids, prints, comp))
    got = S.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.drop_near_duplicates(df.union(df.where("doc_id = 20")))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, c in zip(ids, comp) if i is None or low[c] == i)


def test_one_row_of_each_component_where_ids_repeat_with_other_texts(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 9999)}" for _ in range(60)) for x in "abc")
    near = c.upper()                                     # another text of the same fingerprint
    rows = [(5, a), (7, a), (3, b), (5, b), (8, c), (8, near), (8, c), (8, near), (None, a), (None, a)]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    got = sorted((str(r.doc_id), r.text.lower()) for r in kept)
    assert got == sorted([("5", a), ("3", b), ("8", c), ("None", a), ("None", a)])
