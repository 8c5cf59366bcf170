import itertools
import random
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreline.llm import min_slack as S
from scoreline.llm.queries import QUERIES

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def plain_fullest(counts, room):
    """The fullest combination by trying all, longest lengths first."""
    lengths = sorted(counts, reverse=True)
    best = max(itertools.product(*[range(counts[x] + 1) for x in lengths]),
               key=lambda c: (s := sum(n * x for n, x in zip(c, lengths)), c) if sum(n * x for n, x in zip(c, lengths)) <= room else (-1, c))
    return {x: n for x, n in zip(lengths, best) if n}


def test_fullest_equals_trying_all():
    rng = random.Random(1)
    for _ in range(300):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 40), rng.randint(1, 5))}
        room = rng.randint(0, 60)
        assert S.fullest(counts, room) == plain_fullest(counts, room)


@pytest.mark.parametrize("seeded", [True, False])
def test_plan_equals_planning_bin_by_bin(seeded):
    rng = random.Random(2)
    for _ in range(60):
        histogram = {x: rng.randint(1, 30) for x in rng.sample(range(1, 51), rng.randint(1, 12))}
        left, bins = Counter(histogram), []
        while +left:
            if seeded:
                longest = max(+left)
                left[longest] -= 1
                chosen = Counter(S.fullest(dict(+left), 50 - longest)) + Counter([longest])
                left[longest] += 1
            else:
                chosen = Counter(S.fullest(dict(+left), 50))
            left -= chosen
            bins.append(dict(chosen))
        assert [c for c, times in S.plan_bins(histogram, 50, seeded) for _ in range(times)] == bins
        assert S.plan_bins({}, 50, seeded) == []


def test_as_few_bins_as_trying_all():
    def least(items, room):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= room:
                    place(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1:]])
            place(i + 1, [*bins, items[i]])
        place(0, [])
        return best
    rng, more = random.Random(3), 0
    for _ in range(80):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        got = sum(t for _, t in S.best_plan(Counter(items), 20))
        assert least(items, 20) <= got <= least(items, 20) + 1
        more += got - least(items, 20)
    assert more <= 4


@pytest.mark.parametrize("by_rank", [True, False])
def test_tokens_equal_the_library(library, by_rank):
    tokens = S.Tokens(FILE, P.PATTERN, by_rank=by_rank)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 2000):
        text = "".join(f"{c}a {c}1 {c}" for c in every[at:at + 2000])
        if np.frombuffer(tokens.ids(text), "<u4").tolist() != library.encode(text, add_special_tokens=False).ids:
            wrong = [c for c in every[at:at + 2000] if np.frombuffer(tokens.ids(f"{c}a {c}1 {c}"), "<u4").tolist()
                     != library.encode(f"{c}a {c}1 {c}", add_special_tokens=False).ids]
            raise AssertionError([hex(ord(c)) for c in wrong])
    for text in ("", " ", "a  b\n\n c", "x<|endoftext|> y<|endoftext|>", " <|endoftext|>  ", "it's\x1c 'll\x85 z"):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    rng = random.Random(7)
    for _ in range(3000):                                       # pre-tokens that repeat themselves, and mixed ones
        few = "".join(rng.sample("ab-=_é¿😀e tn.0", rng.randint(1, 3)))
        text = "".join(rng.choices(few, k=rng.randint(1, 40)))
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    ordinary, plain = S.Tokens(FILE, P.PATTERN, False, by_rank), Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    assert np.frombuffer(ordinary.ids("x<|endoftext|>"), "<u4").tolist() == plain.encode("x<|endoftext|>", add_special_tokens=False).ids


def test_ids_are_ranks_only_where_they_are(tmp_path):
    import json
    assert S.ids_are_ranks(FILE)
    whole = json.load(open(FILE, encoding="utf-8"))
    model = whole["model"]
    other = {**whole, "model": {**model, "merges": [*model["merges"][1:], model["merges"][0]]}}       # not in the order of the ids
    (tmp_path / "order.json").write_text(json.dumps(other))
    assert not S.ids_are_ranks(str(tmp_path / "order.json"))
    other = {**whole, "model": {**model, "vocab": {**model["vocab"], "zqzqzq": 60_000}}}              # no merge gives it
    (tmp_path / "extra.json").write_text(json.dumps(other))
    assert not S.ids_are_ranks(str(tmp_path / "extra.json"))


def test_very_long_runs(library):
    for by_rank in (True, False):
        tokens = S.Tokens(FILE, P.PATTERN, by_rank=by_rank)
        for text in (" " * 300_000 + "x", "\n" * 200_000, "a" * 50_000, "-" * 50_000, "word " * 60_000):
            assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:5]


@pytest.mark.parametrize("by_rank", [True, False])
def test_long_texts_are_cut_where_a_pre_token_ends(library, monkeypatch, by_rank):
    monkeypatch.setattr(S, "CHUNK", 7)
    monkeypatch.setattr(S, "REMEMBER", 20)
    rng, tokens = random.Random(4), S.Tokens(FILE, P.PATTERN, by_rank=by_rank)
    for _ in range(400):
        text = "".join(rng.choices(["word", "'s", " ", "  ", "\n", "\t", " ", "é", "12", "!!", "\x1c", "<|endoftext|>"], k=40))
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def check(rows, docs, library, size):
    """Every document whole, every bin gapless and within its size."""
    bins, ids_of = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        ids_of[r.doc_id].append(r)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id].append((piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in ids_of.items()} == {k: sorted(v) for k, v in want.items()}
    return len(bins)


def test_pack(spark, library):
    rng = random.Random(5)
    docs = [(rng.choice([None, i]), rng.choice([None, "", "a" * rng.randint(1, 30), "tok en " * rng.randint(1, 60)])) for i in range(300)]
    docs += [(7, "same text")] * 200
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, `a.b` string")
    cut = S.pieces(df, FILE, P.PATTERN, size=32, keep_ids=True).withColumn("offset", F.lit("old"))
    rows = S.pack(cut, 32)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = rows.collect()
    n = check(got, docs, library, 32)
    assert n == -(-sum(r.length for r in got) // 32)
    whole = {r.sequence_id: r for r in S.sequences(rows).collect()}
    assert len(whole) == n
    for r in got:
        at = whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)]
        assert bytes(at) == bytes(r.ids) and whole[r.sequence_id].n_tokens * 4 == len(whole[r.sequence_id].ids)
    assert S.pack(S.pieces(df.limit(0), FILE, P.PATTERN)).collect() == []
    with pytest.raises(ValueError):
        S.pack(spark.createDataFrame([(1, 33)], "doc_id int, length bigint"), 32)


def test_query_places_all_documents(spark, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_best_fit"](spark, "/root/testdata/sf0.001").collect()
    n = check(got, docs, library, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1
