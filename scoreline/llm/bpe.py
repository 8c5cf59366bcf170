"""Byte-level BPE encoding and decoding by public ranks.

Long texts are cut into chunks that overlap.  Every chunk is pre-tokenised on
its own; neighbours are stitched at the first place inside the overlap where
both have a boundary.  The pattern looks ahead but never back, so from a common
boundary on both chunks give the same pre-tokens; without one the right
chunk starts where the left one ends.  The pieces are then encoded one by one
(each distinct piece once per worker), and decoding concatenates the bytes of
the ids.

The work is row-wise: one Arrow pass over the texts, no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import small_batches

CHUNK, OVERLAP = 1 << 16, 256
#: distinct pieces that a worker remembers before it starts anew
REMEMBER = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def pre_tokens(text: str, pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The pre-tokens of ``text`` as lists of strings, a list for each chunk."""
    if len(text) <= chunk + overlap:
        yield pattern.findall(text)
        return
    done = 0                                   # all before it has been given out
    while done < len(text):
        border = done + chunk
        if border + overlap >= len(text):
            yield pattern.findall(text, done)
            return
        reach = border + overlap
        # the left chunk up to the end of the overlap, the right one from the border
        left = pattern.findall(text[:reach], done)
        ends = np.cumsum(np.fromiter(map(len, left), np.int64, len(left))) + done
        settled = ends[:-1]                    # the last match may be cut short by the chunk's end
        if left[-1].isspace() or (len(left) > 1 and left[-2].isspace()):
            settled = ends[:-2]                # so may the choice where white space before it ends
        right = pattern.finditer(text, border, min(len(text), reach + overlap))
        starts = {m.start() for m in right if m.start() <= reach}
        common = next((i for i in range(int(np.searchsorted(settled, border)), len(settled))
                       if int(settled[i]) in starts), None)
        if common is None:                     # no agreement here: look further
            common = len(settled) - 1
            if common < 0:
                chunk, overlap = chunk * 2, overlap * 2
                continue
        yield left[:common + 1]
        done = int(settled[common])


class Encoder:
    """Encodes and decodes with one table of ranks; lives in a worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken
        self.ranks = read_ranks(ranks_path)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            self.bytes_of[rank] = word
        self.pattern = regex.compile(pattern)
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(self._known) >= REMEMBER:
            self._known.clear()
        ids = np.array(self._core._encode_single_piece(piece), np.dtype("<u4")).tobytes()
        self._known[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, chunk by chunk."""
        for pieces in pre_tokens(text, self.pattern):
            known = self._known
            yield b"".join([known.get(p) or self._piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids (binary, little-endian unsigned 32-bit; only with
    ``keep_ids``), ids_sha256 and decoded_sha256 of every row's whole text.

    Null text is empty and gives no tokens.  Ids of rows may be null or repeat;
    extra columns are ignored; no rows give no rows.  ``ranks_path`` must be
    readable on the executors (an installed package's file).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            out: dict[str, list] = {"n": [], "ids": [], "sha": [], "back": []}
            for text in batch.column("text"):
                sha, back, parts, n = hashlib.sha256(), hashlib.sha256(), [], 0
                for ids in encoder.encode(text.as_py()):
                    sha.update(ids)
                    back.update(encoder.decode(ids))
                    n += len(ids) // 4
                    if keep_ids:
                        parts.append(ids)
                out["n"].append(n)
                out["sha"].append(sha.hexdigest())
                out["back"].append(back.hexdigest())
                out["ids"].append(b"".join(parts))
            arrays = [batch.column("id"), pa.array(out["n"], pa.int64()), pa.array(out["sha"], pa.string()),
                      pa.array(out["back"], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(out["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
