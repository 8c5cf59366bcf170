"""Best-fit packing by minimum bin slack.

1. Documents are tokenised where they are read and cut into pieces of at most
   ``size`` tokens; one aggregation counts the pieces of each length.  That
   histogram has at most ``size`` entries, however many documents there are.
2. Bins are planned from the histogram.  For one bin a bitset holds the sums
   that the available lengths can reach (bounded subset-sum, one integer of
   ``size + 1`` bits for each length); the fullest reachable sum is traced back
   to a combination, longest lengths first, and that combination is removed.
   As long as its lengths last, the next bin would choose the same one, so it
   is removed as many times as it fits: the plan is a short list of
   (combination, times), equal to planning bin by bin.  The plan is made twice,
   with each bin free and with each bin opened by the longest length left, and
   the one with fewer bins is kept.
3. Pieces of one length are interchangeable.  They are numbered (in groups, so
   that a hot length is many keys), and the number says which bin and place a
   piece takes.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.common import partitions, plain, small_batches, stored

SIZE, END_ID = 2048, 0
#: code points handed to the pattern at a time
CHUNK = 1 << 16
#: distinct pre-tokens that a worker remembers before it starts anew
REMEMBER = 400_000
GROUP_PIECES = 4_096

# Between a character that is no white space and a blank or line break a
# pre-token always ends: no alternative of the pattern runs on there, and none
# looks back.
_SAFE = re.compile(r"\S(?=[ \n])")


def _shown() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: those that print stand for themselves, the others follow from
    256 on in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: b if b in prints else next(others) for b in range(256)}


def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int], list[list[str]]]:
    """Ids by bytes, ids of special tokens by name, and merges of a byte-level BPE
    file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    bytes_of = {chr(shown): b for b, shown in _shown().items()}
    special = {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
    ids = {bytes(map(bytes_of.__getitem__, t)): i for t, i in whole["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    return ids, special, merges


def ids_are_ranks(path: str) -> bool:
    """Joining the neighbours whose joint id is least gives this tokenizer's ids.

    That holds if ids ascend along the merges and every token, encoded by itself,
    is one token.  For the neighbours a, b of a text are a state of their joint
    string's own encoding as long as no merge crossed their ends; where that
    encoding ends in one token, the only pair it can end with is the listed one.
    """
    from tokenizers import Tokenizer
    ids, _, merges = _vocabulary(path)
    model, shown = Tokenizer.from_file(path).model, _shown()
    bytes_of = {chr(c): b for b, c in shown.items()}
    joined = [ids[bytes(map(bytes_of.__getitem__, a + b))] for a, b in merges]
    if joined != sorted(set(joined)) or any(bytes([b]) not in ids for b in range(256)):
        return False
    return all([t.id for t in model.tokenize(text.decode("latin-1").translate(shown))] == [i] for text, i in ids.items())


class Tokens:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library; lives
    in a worker.  Texts are cut at the special tokens, as the library does, and
    into pre-tokens by its pattern.  With ``by_rank`` (see ``ids_are_ranks``)
    the same vocabulary is applied by ``tiktoken``, several times as fast; else
    the library's model encodes each distinct pre-token once."""

    def __init__(self, path: str, pattern: str, special: bool = True, by_rank: bool = False):
        vocabulary, names, _ = _vocabulary(path)
        if by_rank:
            import tiktoken
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
        else:
            import regex
            from tokenizers import Tokenizer
            self._fast = None
            self._model, self._pattern = Tokenizer.from_file(path).model, regex.compile(pattern)
            self._known: dict[str, bytes] = {}
        names = names if special else {}
        self._special = {name: struct.pack("<I", i) for name, i in names.items()}
        # longest first, so that of two that begin alike the longer one is found
        self._cut = re.compile("(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + ")") if names else None
        self._shown = _shown()

    def _encode(self, piece: str) -> bytes:
        if len(self._known) >= REMEMBER:
            self._known.clear()
        shown = piece.encode().decode("latin-1").translate(self._shown)
        ids = [t.id for t in self._model.tokenize(shown)]
        self._known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return self._known[piece]

    def _ordinary(self, text: str) -> Iterator[bytes]:
        done = 0
        while done < len(text):
            cut = _SAFE.search(text, done + CHUNK) if len(text) - done > CHUNK else None
            end = cut.end() if cut else len(text)
            part = text[done:end] if done or cut else text
            if self._fast:
                yield self._fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield b"".join([self._known.get(p) or self._encode(p) for p in self._pattern.findall(part)])
            done = end

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, end to end."""
        if not any(name in text for name in self._special):
            return b"".join(self._ordinary(text))
        parts: list[bytes] = []
        for part in self._cut.split(text):
            parts.extend([self._special[part]] if part in self._special else self._ordinary(part))
        return b"".join(parts)


def _pieces_of(batches: Iterator[pa.RecordBatch], path: str, pattern: str, size: int, end_id: int, special: bool,
               by_rank: bool, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, end = Tokens(path, pattern, special, by_rank), np.array([end_id], np.dtype("<u4")).tobytes()
    for batch in batches:
        out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
        for row, text in enumerate(batch.column("text")):
            ids = tokens.ids(text.as_py()) + end
            n = len(ids) // 4
            first = n % size or size                      # a longer one gives full pieces behind its first
            starts = [0, *range(first, n, size)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                cut = ids[4 * a:4 * b]
                out["row"].append(row)
                out["piece"].append(piece)
                out["start"].append(a)
                out["length"].append(b - a)
                out["crc"].append(zlib.crc32(cut))
                if keep_ids:
                    out["ids"].append(cut)
        arrays = [batch.column("id").take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()),
                  *[pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            arrays.append(pa.array(out["ids"], pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", special: bool = True, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: id_col, piece (from 0), start (its
    document's ids before it), length, ids_crc32 and, with ``keep_ids``, ids
    (binary, little-endian unsigned 32-bit).

    A document is the ids of its text and ``end_id``.  One longer than ``size`` is
    cut into pieces of ``size``, of which the first may be shorter.  Null text is
    empty: a piece of the end mark alone.  Ids may be null or repeat, each row is
    a document; other columns are ignored; no rows give none.  With ``special``
    the names of special tokens inside a text get their ids, the library's
    default; without they are ordinary text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(plain(id_col).alias("id"), F.coalesce(plain(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    run = partial(_pieces_of, path=tokenizer, pattern=pattern, size=size, end_id=end_id, special=special,
                  by_rank=ids_are_ranks(tokenizer), keep_ids=keep_ids)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths, each used at most ``counts`` times, with the
    largest sum up to ``room``; of equal sums the one with the longest lengths."""
    lengths = sorted(x for x, c in counts.items() if c and x <= room)
    mask = (1 << (room + 1)) - 1
    reach = [1]                                           # bit s: the sum s can be reached
    for x in lengths:
        bits, left, step = reach[-1], min(counts[x], room // x), 1
        while left > 0:                                   # 1, 2, 4, ... copies and the rest
            bits |= bits << (x * min(step, left)) & mask
            left -= step
            step *= 2
        reach.append(bits)
    target, chosen = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths), 0, -1):
        x = lengths[i - 1]
        for copies in range(min(counts[x], target // x), -1, -1):
            if reach[i - 1] >> (target - copies * x) & 1:
                break
        if copies:
            chosen[x] = copies
            target -= copies * x
    return chosen


def plan_bins(histogram: dict[int, int], size: int, seeded: bool) -> list[tuple[dict[int, int], int]]:
    """(combination, times) in the order of planning.  ``seeded``: each bin is
    opened by the longest length left."""
    counts, plan = {x: c for x, c in histogram.items() if c}, []
    while counts:
        if seeded:
            longest = max(counts)
            rest = {**counts, longest: counts[longest] - 1}
            chosen = fullest(rest, size - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
        else:
            chosen = fullest(counts, size)
        times = min(counts[x] // n for x, n in chosen.items())
        plan.append((chosen, times))
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


def best_plan(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """The plan with fewer bins; of equal ones the seeded one.  The other is not
    made where no plan can have fewer."""
    def bins(plan: list) -> int:
        return sum(times for _, times in plan)

    seeded = plan_bins(histogram, size, True)
    if bins(seeded) == math.ceil(sum(x * c for x, c in histogram.items()) / size):
        return seeded
    return min(seeded, plan_bins(histogram, size, False), key=bins)


def _places(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, from number, to number, first bin, copies a bin, offset of the
    first copy) for each length of each planned combination."""
    used: dict[int, int] = {}
    out, first = [], 0
    for chosen, times in plan:
        offset = 0
        for x in sorted(chosen, reverse=True):
            start = used.get(x, 0)
            used[x] = start + chosen[x] * times
            out.append((x, start, used[x], first, chosen[x], offset))
            offset += x * chosen[x]
        first += times
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row of ``cut`` (with a ``length`` from 1 to ``size``, as ``pieces``
    gives) with all its columns, ``sequence_id`` and ``offset``: its bin and its
    place there.  The pieces of a bin follow each other without gaps from 0.

    Equal rows are packed each; no rows give none.  Columns called like the new
    ones are replaced.  ``cut`` is written once.
    """
    spark = cut.sparkSession
    cut = cut.drop("sequence_id", "offset")
    rows = stored(cut.select(F.struct(*map(plain, cut.columns)).alias("row"), plain("length").alias("n"),
                             F.monotonically_increasing_id().alias("uid")), "pack-pieces")
    histogram = {r.n: r["rows"] for r in rows.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    if any(x is None or not 1 <= x <= size for x in histogram):
        raise ValueError(f"lengths must lie between 1 and {size}")
    # at most some entries a length, as each combination uses a length up
    places = spark.createDataFrame(_places(best_plan(histogram, size)),
                                   "x bigint, low bigint, high bigint, first bigint, copies bigint, at bigint")
    groups = max(partitions(spark), math.ceil(sum(histogram.values()) / GROUP_PIECES))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    before = Window.partitionBy("x").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("n").alias("x"), F.col("grp").alias("g")).agg(F.count("*").alias("held")) \
                 .select("x", "g", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("n", "grp").orderBy("uid")) - 1
    rows = rows.withColumn("inside", inside).join(starts, (F.col("n") == F.col("x")) & (F.col("grp") == F.col("g"))) \
               .select("row", "n", (F.col("inside") + F.col("start")).alias("number"))
    fits = (F.col("n") == F.col("x")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    rank = F.col("number") - F.col("low")
    return rows.join(F.broadcast(places), fits).select(
        "row.*", (F.col("first") + F.floor(rank / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + F.pmod(rank, F.col("copies")) * F.col("n")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (binary) of every bin of a packing whose
    pieces carry their ``ids``; a bin is at most ``size`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
