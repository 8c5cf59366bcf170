import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scoreline.llm import merkle as M
from scoreline.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(hashes, arity):
    """The root and each leaf's steps (slot, others), the plain way."""
    steps, at, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for k in range(len(hashes)):
            i = at[k]
            run = nodes[i // arity * arity:i // arity * arity + arity]
            steps[k].append((i % arity, [h for j, h in enumerate(run) if j != i % arity]))
            at[k] = i // arity
        nodes = [H(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def brute(rows, arity=2):
    """rows of (id, group, leaf): leaf -> subroot, root, steps, by row number."""
    groups = {}
    for n, (i, g, h) in enumerate(rows):
        groups.setdefault(g, []).append(((i is not None, i or 0), h, n))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: climb([h for _, h, _ in sorted(groups[g])], arity) for g in order}
    root, tops = climb([built[g][0] for g in order], arity)
    out = {}
    for t, g in zip(tops, order):
        for (_, h, n), s in zip(sorted(groups[g]), built[g][1]):
            out[n] = (h, built[g][0], root, s + t)
    return out


def proof_hash(steps):
    return H(*[h for _, others in steps for h in others])


def fold(h, steps):
    for slot, others in steps:
        h = H(*others[:slot], h, *others[slot:])
    return h


@pytest.mark.parametrize("arity", [2, 5])
def test_equals_brute_force(spark, arity):
    rng = random.Random(arity)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "b", "é", "a.b"]), "x" * rng.randint(0, 3)) for _ in range(60)]
    rows += [(5, "alone", "t")] + [(7, "b", "same")] * 4
    df = spark.createDataFrame([(n, i, g, t, "k") for n, (i, g, t) in enumerate(rows)], "n int, `id.x` bigint, g string, t string, idx string")
    got = M.manifest(df, M.record_hash("id.x", "g", "t"), "id.x", "g", arity)
    assert got.columns == ["n", "id.x", "g", "t", "idx", "leaf", "subroot", "root", "path"]
    got = got.select("*", M.proof("path").alias("steps"), M.proof_hash(F.col("path")).alias("ph"),
                     M.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert len(got) == len(rows)
    want = brute([(i, g, H(field(i), field(g), field(t))) for i, g, t in rows], arity)
    # equal rows share one leaf hash and may swap places
    key = lambda x: (x[0], x[1], x[2], str(x[3]))                       # noqa: E731
    mine = sorted([(r.leaf, r.subroot, r.root, [(s.slot, list(s.others)) for s in r.steps]) for r in got], key=key)
    assert mine == sorted(want.values(), key=key)
    for r in got:
        steps = [(s.slot, s.others) for s in r.steps]
        assert r.ph == proof_hash(steps) and r.folded == fold(r.leaf, steps) == r.root and r.idx == "k"


def test_a_lone_row_and_none(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, g string")
    r = M.manifest(df, M.record_hash("id", "g"), "id", "g").select("*", M.proof_hash(F.col("path")).alias("p")).first()
    assert r.leaf == r.subroot == r.root == H("1:1", "-") and r.p == H() and r.path == []
    assert M.manifest(df.limit(0), M.record_hash("id", "g"), "id", "g").collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, rng.choice(["t é", "", None, "long " * 50]), rng.choice(["en", "de", None, "x"]), rng.choice(["s", None]),
             rng.choice([None, 5, 2**63 - 1])) for i in rng.sample(range(1000), 70)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()}
    leaf = lambda d, n: H(*map(field, (d[0], d[3], d[2], n, d[1])))     # noqa: E731
    want = brute([(d[0], d[2], leaf(d, d[4])) for d in docs])
    assert len(got) == len(docs)
    for n, d in enumerate(docs):
        h, sub, root, steps = want[n]
        changed = zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None
        folded = fold(leaf(d, d[4] + 1) if changed else h, steps)
        r = got[d[0]]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (h, sub, root, proof_hash(steps), folded, not changed)
