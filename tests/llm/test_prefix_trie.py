import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scoreline.llm import prefix_trie as T
from scoreline.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(paths):
    """paths: conv -> list of (role, text); rows by (depth, conv_id)."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = {}
    for p, cs in members.items():
        subtree = [q for q in members if q[:len(p)] == p]
        children = [q for q in subtree if len(q) == len(p) + 1]
        leaves = [q for q in subtree if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in subtree)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in subtree if q)
        ends = sorted(c for c in cs if len(paths[c]) == len(p))
        out[len(p), min(cs)] = (min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved, sha(",".join(map(str, ends))))
    return out


def rows_of(df):
    names = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = df.collect()
    out = {(r.depth, r.conv_id): tuple(r[n] for n in names) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "CHUNK", 2)
    monkeypatch.setattr(T, "LISTED", 4)


def said_of(spark, paths):
    rows = [(c, n, *t) for c, p in paths.items() for n, t in enumerate(p)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, r string, t string")
    return T.turns(df, "c", "n", "r", "t"), spark.createDataFrame([(c,) for c in paths], "conv bigint")


def test_equals_brute_force(spark, small):
    rng = random.Random(1)
    paths = {}
    for c in rng.sample(range(-20, 200), 40):
        start = rng.choice([[], *paths.values()]) if rng.random() < 0.8 and paths else []
        cut = start[:rng.randint(0, len(start))]
        paths[c] = cut + [(rng.choice(["u", "a", ""]), rng.choice(["", "é", "hello"])) for _ in range(rng.randint(0, 9))]
    paths[500] = []
    for c in range(600, 611):                                   # a hot group of equal conversations
        paths[c] = paths[min(paths)]
    got = T.trie(*said_of(spark, paths))
    assert rows_of(got) == brute(paths)


def test_none_and_only_turnless(spark):
    said, every = said_of(spark, {1: [("u", "x")]})
    assert T.trie(said.limit(0), every.limit(0)).collect() == []
    assert rows_of(T.trie(said.limit(0), spark.createDataFrame([(5,), (10,)], "conv bigint"))) == {(0, 5): (None, 2, 0, 1, 0, sha("5,10"))}


def rebuilt(table):
    """table: (conv, turn, role, text) rows; the contract's conversations."""
    own = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, sha(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}"))
    for r in sorted((r for r in table if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "é" * 9]))
            for c in rng.sample(range(60), 40) for _ in range(rng.randint(1, 14))]
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]] + [(7, n, "user", f"long {n}") for n in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("x"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute(rebuilt(rows))
