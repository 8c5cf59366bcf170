import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from scoreline.llm import bpe

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")


def test_chunks_stitch_to_the_whole():
    pattern, rng = regex.compile(public.PATTERN), random.Random(1)
    texts = ["a" * 3000, " " * 3000, "\n \n" * 700 + "x", "ab " * 900, "", "x", "1" * 999 + " " * 500 + "é" * 400]
    texts += ["".join(rng.choice([" ", "  ", "\n", "ab", "x1", "'s", "!!", "é", "\t ", "   ", "word", "'ll"]) for _ in range(rng.randint(0, 300)))
              for _ in range(200)]
    for text in texts:
        for chunk, overlap in ((40, 10), (7, 3), (100, 50)):
            assert [p for part in bpe.pre_tokens(text, pattern, chunk, overlap) for p in part] == pattern.findall(text)


def test_against_the_library(spark):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world's  \n\n  end", "\x00\x1c\x85\u00a0 x", "<|endoftext|>", "日本語のテキスト😀", "a" * 70000, "word " * 40000, "same", "same"]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: r for r in bpe.encode_texts(df, PATH, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids, r = library.encode_ordinary(t or ""), got[i if i != 3 else None]
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(df.limit(0), PATH, public.PATTERN).count() == 0
