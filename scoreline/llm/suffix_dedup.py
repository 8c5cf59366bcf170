"""Suffix-array deduplication: cut every byte covered by a string of at least
``length`` bytes that also starts in a document with a smaller id.

1. Anchors.  Each window of ``length`` bytes picks its smallest 16-byte gram by
   hash, so equal windows pick the same gram wherever they stand.  Runs of
   windows with one anchor (about 18 windows) are the unit of work.
2. Screen.  Anchor hashes (six bytes each, once a document) are shuffled and
   counted; those of two documents or more set bits in a filter that all tasks
   get (16 MB, and up to 64 MB where many are shared).  False hits only cost work.
3. Shards.  Runs whose anchor passes travel, with the bytes their windows
   cover, to the shard of the anchor, where all equal windows meet.
4. Two-stage sorting in each shard.  Equal runs are merged to one, and of those
   left only the ones that may share a window with another document go on
   (a window holds half of its other bytes before or behind the anchor).  Of the
   window starts, only suffixes smaller than their successors are sorted
   directly (on their first 56 bytes); the others are induced by scanning the
   buckets of first bytes in ascending order.  Neighbours in that order whose
   common prefix has ``length`` bytes form a group, whose smallest document
   keeps its bytes.
5. Cut.  Covered byte ranges are gathered per document and joined to the texts.

A shard is worked off in parts of bounded size (runs of one anchor stay
together).  A passage that very many documents hold costs its shard 13 bytes a
copy beside one sort of the passage itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.llm.common import partitions, plain, small_batches

LENGTH, GRAM = 50, 16
#: the filter: segments by the first byte of a hash, bits of each at least and at most, bits wanted for a shared anchor
SEGMENTS, LEAST_BITS, MOST_BITS, BITS_EACH = 256, 1 << 19, 1 << 21, 8
#: windows looked at at a time; bytes of texts whose runs are sent together; bytes of runs read, and of texts sorted, at a time
CHUNK, SENT, PART, SORT = (1 << 16) - 128, 1 << 25, 1 << 25, 1 << 22
_C1, _C2, _C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: a number for each byte, and odd factors: a cheap hash that anchors are chosen by
_BYTE = np.random.default_rng(50).integers(0, 1 << 32, 256, np.uint32)
_STEPS = [(1, np.uint32(0x9E3779B1)), (2, np.uint32(0x85EBCA77)), (4, np.uint32(0xC2B2AE3D)), (8, np.uint32(0x27D4EB2F))]


def _words(data: np.ndarray | bytes) -> np.ndarray:
    """The eight bytes at each place; the last place is eight before the end."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def _mixed(words: Iterator[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of some columns of words."""
    h = np.uint64(0)
    for w in words:
        h = (h ^ w) * _C1
        h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    h *= _C3
    return h ^ (h >> np.uint64(29))


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor in texts that lie one after another in
    ``data``: (first window, windows, anchor's place after it, 48-bit hash, text's
    number).  Of a window's grams the anchor is the first of least cheap hash."""
    width = length - GRAM + 1
    starts, ends = offsets[:-1], offsets[1:]
    cuts = np.sort(np.concatenate([starts, np.maximum(ends - length + 1, starts)]))
    for a in range(0, len(data) - length + 1, CHUNK):
        part = data[a:a + CHUNK + length - 1]
        m = len(part) - length + 1
        n = len(part) - GRAM + 1
        low = _BYTE.take(part)
        for span, factor in _STEPS:                    # hashes of 2, 4, 8 and 16 bytes
            after = low[span:]
            low = low[:-span] * factor
            low += after
        low &= np.uint32(0xFFFF0000)
        low |= np.arange(n, dtype=np.uint32)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        at = low[:m].astype(np.uint16)
        fresh = np.ones(m, bool)
        np.not_equal(at[1:], at[:-1], out=fresh[1:])
        # a run ends where a text begins or where its windows would reach over the end of theirs
        fresh[cuts[np.searchsorted(cuts, a):np.searchsorted(cuts, a + m)] - a] = True
        first = np.flatnonzero(fresh)
        count = np.diff(first, append=m)
        text = np.searchsorted(ends, first + a, "right")
        good = first + a + length <= ends[text]
        first, count, text = first[good], count[good], text[good]
        gram = at[first].astype(np.int64)
        words = _words(part)
        yield first + a, count, gram - first, _mixed(words[gram + k] for k in range(0, GRAM, 8)) >> np.uint64(16), text


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _screen(rows: DataFrame, length: int) -> bytes:
    """Bits of the anchors that two or more documents hold: as many for each segment."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1 << 16) for b in batches for i in range(0, len(b), 1 << 16)):
            data, offsets = _texts(batch.column("text"))
            found = [h << np.uint64(16) | text.astype(np.uint64) for _, _, _, h, text in anchored_runs(data, offsets, length)]
            if not found:
                continue
            both = np.sort(np.concatenate(found))
            h = both[np.append(True, both[1:] != both[:-1])] >> np.uint64(16)
            third = np.zeros(len(h), bool)             # an anchor counts once a document, at most twice a batch
            third[2:] = (h[2:] == h[:-2])
            h = h[~third]
            packed = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            cuts = np.searchsorted(h, np.arange(SEGMENTS + 1, dtype=np.uint64) << np.uint64(40))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([packed[cuts[s]:cuts[s + 1]].tobytes() for s in some], pa.binary())],
                ["segment", "hashes"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("hashes")):
                held.setdefault(segment, []).append(packed.as_py())
        for segment in sorted(held):
            raw = np.frombuffer(b"".join(held.pop(segment)), np.uint8).reshape(-1, 6)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :6] = raw
            h = np.sort(h.view("<u8").ravel())
            shared = h[1:][h[1:] == h[:-1]]
            wanted = BITS_EACH * (1 + int(np.count_nonzero(shared[1:] != shared[:-1])))
            each = min(max(1 << (wanted - 1).bit_length(), LEAST_BITS), MOST_BITS)
            flags = np.zeros(each, np.uint8)
            flags[(shared & np.uint64(each - 1)).astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()),
                                              pa.array([np.packbits(flags).tobytes()], pa.binary())], ["segment", "bits"])

    spread = rows.select("text").mapInArrow(anchors, "segment bigint, hashes binary").repartition("segment")
    found = {r.segment: bytes(r.bits) for r in spread.mapInArrow(bits, "segment bigint, bits binary").collect()}
    size = max(map(len, found.values()), default=LEAST_BITS // 8)
    # a smaller segment repeats: it was filled by fewer low bits
    return b"".join(found[s] * (size // len(found[s])) if s in found else bytes(size) for s in range(SEGMENTS))


def _in_screen(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    each = np.uint64(len(flags) // SEGMENTS * 8)
    bit = ((h >> np.uint64(40)) * each + (h & (each - np.uint64(1)))).astype(np.int64)
    return (flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


#: bytes of a suffix that its place in the order goes by
SORTED = 56


def two_stage_order(t: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` places of ``t`` (a mask) in the order of the suffixes there,
    right for the first 56 bytes.  ``t`` holds bytes 1 to 255, a 0 after each
    text, and at least 64 zeros at its end."""
    n = len(t)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)       # ends of runs of one byte
    runs = np.diff(ends, prepend=-1)
    small = np.repeat(np.append(t[ends[:-1]] < t[ends[:-1] + 1], True), runs)   # smaller than the successor
    # a larger one is induced from its successor, so mark up to the next smaller one
    place = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(place[::-1])[::-1]
    reach = np.zeros(n + 1, np.int32)
    edge = np.flatnonzero(wanted & ~np.append(wanted[1:], False))   # last wanted of a stretch
    np.add.at(reach, edge, 1)
    np.add.at(reach, np.minimum(next_small[edge], n - 1) + 1, -1)
    marked = wanted | (np.cumsum(reach[:n]) > 0)

    direct = np.flatnonzero(marked & small)
    words = np.ndarray((n - 7,), ">u8", t.tobytes(), strides=(1,))
    direct = direct[np.lexsort([words[np.minimum(direct + 8 * k, n - 8)].astype(np.uint64) for k in range(6, -1, -1)])]
    heads = np.searchsorted(t[direct], np.arange(257))              # sorted by first byte
    induced = marked & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        bucket = [level]
        while len(level):                                           # runs of c: one byte longer each time
            level = level[level > 0] - 1
            level = level[induced[level] & (t[level] == c)]
            bucket.append(level)
        bucket.append(direct[heads[c]:heads[c + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (t[before] > c)]
        byte = t[before]
        before = before[np.argsort(byte, kind="stable")]
        cuts = np.append(0, np.cumsum(np.bincount(byte, minlength=256)))
        for d in np.flatnonzero(np.diff(cuts)):
            waiting[d].append(before[cuts[d]:cuts[d + 1]])
    order = np.concatenate(done) if done else np.empty(0, np.int64)
    return order[wanted[order]]


def _alike(words: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The size of each run's text, and words that between them cover it."""
    yield size.astype(np.uint64)
    for k in range(0, length - 7, 8):
        yield words[start + k]
    for k in range(8, 2 * length - GRAM - length // 8 * 8 + 8, 8):
        yield words[start + size - k]


def _by_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an order that brings equal hashes together, and where each new one
    begins.  So many low bits as the places need are left out of the comparison."""
    bits = np.uint64(len(h).bit_length())
    both = np.sort(h >> bits << bits | np.arange(len(h), dtype=np.uint64))
    h = both >> bits
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), np.flatnonzero(np.append(True, h[1:] != h[:-1]))


def _merge_equal(text: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run, equal where the texts are, and a run of each number."""
    words = _words(text)
    order, heads = _by_hash(_mixed(_alike(words, start, size, length)))
    text_of = np.empty(len(start), np.int64)
    text_of[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
    texts = order[heads]
    later = np.flatnonzero(texts[text_of] != np.arange(len(start)))
    model = texts[text_of[later]]
    other = np.zeros(len(later), bool)                  # of equal hash, but not equal
    for a, b in zip(_alike(words, start[later], size[later], length), _alike(words, start[model], size[model], length)):
        other |= a != b
    if other.any():
        known: dict[bytes, int] = {}
        runs = later[other]
        text_of[runs] = [known.setdefault(text[start[i]:start[i] + size[i]].tobytes(), len(texts) + len(known)) for i in runs]
        new, at = np.unique(text_of[runs], return_index=True)
        texts = np.append(texts, runs[at])
    return text_of, texts


def _may_meet(text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """The runs that may share a window with one of another smallest document: they
    have the anchor and half of a window's other bytes, before or behind it, alike."""
    words, half = _words(text), (length - GRAM + 1) // 2
    at, need = start + anchor, np.zeros(len(start), bool)
    for some, begin in ((np.flatnonzero(anchor >= half), -half), (np.flatnonzero(size - anchor - GRAM >= half), 0)):
        if len(some):
            x = at[some] + begin
            order, heads = _by_hash(_mixed(words[x + min(k, half + GRAM - 8)] for k in range(0, half + GRAM, 8)))
            docs = low[some[order]]
            differ = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)
            need[some[order]] |= np.repeat(differ, np.diff(heads, append=len(order)))
    return np.flatnonzero(need)


def _laid_out(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The texts one after another."""
    return text[np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]


def _sorted_repeats(text: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (text, start, end) of windows that also stand in a text of a smaller document."""
    begin = np.append(0, np.cumsum(size + 1))[:-1]
    t = np.zeros(int((size + 1).sum()) + 65, np.uint8)
    t[np.repeat(np.arange(len(size)), size) + np.arange(size.sum())] = _laid_out(text, start, size) + np.uint8(1)   # 0xFF is never in UTF-8
    edges = np.zeros(len(t) + 1, np.int8)
    edges[begin] += 1
    edges[begin + size - length + 1] -= 1
    wanted = np.cumsum(edges[:-1], dtype=np.int8) > 0
    order = two_stage_order(t, wanted)
    # common prefixes of neighbours, as far as they matter
    words = np.ndarray((len(t) - 7,), ">u8", t, strides=(1,))
    same = np.ones(len(order) - 1, bool)
    for k in range(0, length, 8):
        shift = np.uint64(8 * max(0, 8 - (length - k)))
        w = words[order + k].astype(np.uint64) >> shift
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.append(True, ~same))
    owner = np.searchsorted(begin, order, "right") - 1
    least = np.repeat(np.minimum.reduceat(low[owner], heads), np.diff(heads, append=len(order)))
    held = np.sort(order[least < low[owner]])           # windows that the text's first holder loses
    split = np.flatnonzero(np.append(True, np.diff(held) != 1)) if len(held) else np.empty(0, np.int64)
    run_text = np.searchsorted(begin, held[split], "right") - 1
    run_to = held[np.append(split[1:], len(held)) - 1] - begin[run_text] + length if len(held) else split
    return run_text, held[split] - begin[run_text], run_to


def repeated_in(text: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, docs: np.ndarray,
                length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered byte ranges (run, start, end) of runs: all windows of them that also
    start in a run of a smaller document.  Windows are only equal under one anchor."""
    text_of, texts = _merge_equal(text, start, size, length)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, text_of, docs)
    some = _may_meet(text, start[texts], size[texts], anchor[texts], low, length)
    found = [(np.empty(0, np.int64),) * 3]
    if len(some):
        at = (start + anchor)[texts[some]]
        order, heads = _by_hash(_mixed(_words(text)[at + k] for k in range(0, GRAM, 8)))
        some = some[order]
        filled = np.append(0, np.cumsum(size[texts[some]]))[np.append(heads, len(some))]
        cut = 0
        while cut < len(heads):                        # texts of one anchor are sorted together
            end = max(cut + 1, int(np.searchsorted(filled, filled[cut] + SORT, "right")) - 1)
            x = some[heads[cut]:heads[end] if end < len(heads) else len(some)]
            which, a, b = _sorted_repeats(text, start[texts[x]], size[texts[x]], low[x], length)
            found.append((x[which], a, b))
            cut = end
    run_text, run_from, run_to = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(run_text, kind="stable")
    run_text, run_from, run_to = run_text[order], run_from[order], run_to[order]
    # later holders lose the whole text; the first holder loses the runs found
    later = np.flatnonzero(docs > low[text_of])
    first = np.flatnonzero(docs == low[text_of])
    a, b = np.searchsorted(run_text, text_of[first]), np.searchsorted(run_text, text_of[first], "right")
    pick = np.repeat(a - np.append(0, np.cumsum(b - a))[:-1], b - a) + np.arange((b - a).sum())
    return (np.concatenate([later, np.repeat(first, b - a)]), np.concatenate([np.zeros(len(later), np.int64), run_from[pick]]),
            np.concatenate([size[later], run_to[pick]]))


#: what a run has beside its text: id, text hash, place, windows, anchor
_HEAD = (("<i8", 8), ("<i8", 8), ("<i4", 4), ("u1", 1), ("u1", 1))


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind, size in _HEAD:
        out.append(np.frombuffer(raw, kind, n, at))
        at += size * n
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def shard_runs(batches: Iterator[pa.RecordBatch], bits: np.ndarray, shards: int, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """(shard, runs): the runs whose anchors pass the screen, packed for each shard.
    Those of several batches go together: a pack costs the same however few runs it
    holds, and batches times shards would grow with the square of the input."""
    texts, kept, size = [], [], 0
    for batch in batches:
        data, offsets = _texts(batch.column("text"))
        ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
        for first, count, anchor, h, text in anchored_runs(data, offsets, length):
            hit = np.flatnonzero(_in_screen(bits, h))
            first, text = first[hit], text[hit]
            kept.append((first + size, count[hit], anchor[hit], (h[hit] % np.uint64(shards)).astype(np.int64),
                         ids[text], ties[text], first - offsets[text]))
        texts.append(data)
        size += len(data)
        if size >= SENT:
            yield from _packed(np.concatenate(texts), kept, length)
            texts, kept, size = [], [], 0
    if texts:
        yield from _packed(np.concatenate(texts), kept, length)


def _packed(data: np.ndarray, kept: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    if not sum(len(k[0]) for k in kept):
        return
    pack = zstandard.ZstdCompressor(level=1).compress
    columns = [np.concatenate(c) for c in zip(*kept)]
    order = np.argsort(columns[3], kind="stable")
    first, count, anchor, shard, doc, tie, place = (c[order] for c in columns)
    some, cuts = np.unique(shard, return_index=True)
    cuts = np.append(cuts, len(shard))
    size = count + length - 1
    ends = np.append(0, np.cumsum(size))[cuts]
    heads = [c.astype(kind) for c, (kind, _) in zip((doc, tie, place, count, anchor), _HEAD)]
    blobs, at = [], 0
    while at < len(some):                              # about SORT bytes are laid out at a time
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SORT, "right")) - 1)
        text = _laid_out(data, first[cuts[at]:cuts[to]], size[cuts[at]:cuts[to]]).tobytes()
        for s in range(at, to):
            x = slice(cuts[s], cuts[s + 1])
            blobs.append(pack(b"".join([int(x.stop - x.start).to_bytes(8, "little"), *(c[x].tobytes() for c in heads),
                                        text[ends[s] - ends[at]:ends[s + 1] - ends[at]]])))
        at = to
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "runs"])


def covered_ranges(docs: DataFrame, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """(id, tie, start, end): byte ranges of texts to be cut; they may overlap.
    ``docs``: id bigint, tie bigint (tells rows of one id apart), text binary."""
    spark = docs.sparkSession
    shards = shards or 2 * partitions(spark)
    rows = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    flags = spark.sparkContext.broadcast(_screen(rows, length))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_runs(batches, np.frombuffer(flags.value, np.uint8), shards, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tie", "start", "end"]
        held: list[bytes] = []
        size, last = 0, None
        for batch in batches:                          # sorted by shard
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("runs")):
                if shard != last and held:
                    yield from sort_shard(held, size, names)
                    held, size = [], 0
                last = shard
                held.append(packed.as_py())
                size += zstandard.frame_content_size(held[-1])
        if held:
            yield from sort_shard(held, size, names)

    def sort_shard(held: list[bytes], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        parts = -(-size // PART)
        unpack = zstandard.ZstdDecompressor().decompress
        for part in range(parts):
            columns: list[list[np.ndarray]] = []
            for packed in held:
                doc, tie, place, count, anchor, text = _unpack(unpack(packed))
                sizes = count.astype(np.int64) + length - 1
                if parts > 1:                          # runs of one anchor stay in one part
                    starts = np.cumsum(sizes) - sizes
                    words = _words(text)
                    h = _mixed(words[starts + anchor + k] for k in range(0, GRAM, 8))
                    some = np.flatnonzero((h >> np.uint64(20)) % np.uint64(parts) == part)
                    doc, tie, place, anchor, text = doc[some], tie[some], place[some], anchor[some], _laid_out(text, starts[some], sizes[some])
                    sizes = sizes[some]
                columns.append([doc, tie, place, sizes, anchor, text])
            doc, tie, place, sizes, anchor, text = (np.concatenate(c) for c in zip(*columns))
            columns.clear()
            if not len(doc):
                continue
            run, start, end = repeated_in(np.append(text, np.zeros(16, np.uint8)), np.cumsum(sizes) - sizes, sizes, anchor.astype(np.int64), doc, length)
            if len(run):
                place = place[run].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc[run]), pa.array(tie[run]),
                                                  pa.array(place + start), pa.array(place + end)], names)

    return (rows.mapInArrow(runs, "shard bigint, runs binary").repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(cut, "id bigint, tie bigint, start bigint, end bigint"))


def merge_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes that the ranges cover, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > ends[:-1])
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:], len(ends)) - 1]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                shards: int | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns, and: cut_bytes (its bytes),
    cut_spans array<struct<start, end>> (maximal removed byte runs), cut_kept
    (binary, the bytes that stay), cut_text (the characters none of whose bytes
    are removed).

    Null text is empty.  Rows with a null id lose nothing and take nothing from
    others; rows of one id do not count as smaller than one another, nor does a
    row repeated under its id.  Columns of the input that carry one of the
    names above are replaced.  Texts shorter than ``length`` bytes stay whole;
    no rows give none.  A ``length`` beyond ``SORTED`` is an error.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    if length > SORTED:
        raise ValueError(f"length must be at most {SORTED} bytes, as far as suffixes are sorted")
    small_batches(docs.sparkSession)
    new = ("cut_bytes", "cut_spans", "cut_kept", "cut_text")
    keep = [c for c in docs.columns if c.lower() not in new]
    raw = F.encode(F.coalesce(plain(text_col), F.lit("")), "UTF-8")
    keyed = docs.select(plain(id_col).cast("bigint").alias("id"), F.xxhash64(raw).alias("tie"), raw.alias("text"))
    ranges = covered_ranges(keyed, length, shards)
    ranges = ranges.groupBy("id", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    # the text is in the row already: cut from it, so that it travels once
    slim = docs.select(F.struct(*map(plain, keep)).alias("row"), plain(id_col).cast("bigint").alias("id"), F.xxhash64(raw).alias("tie"))
    joined = slim.join(ranges, ["id", "tie"], "left").select("row", F.encode(F.coalesce(F.col("row")[text_col], F.lit("")), "UTF-8").alias("text"),
                                                             "starts", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept, texts = [], [], [], []
            for text, s, e in zip(batch.column("text"), batch.column("starts"), batch.column("ends")):
                text = text.as_py()
                starts, ends = (s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else (np.empty(0, np.int64),) * 2
                starts, ends = (x.tolist() for x in merge_ranges(starts, ends))
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                kept.append(b"".join(text[b:a] for b, a in zip([0, *ends], [*starts, len(text)])))
                texts.append(_whole_characters(text, starts, ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()),
                 pa.array(texts, pa.string())], ["row", *new])

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([joined.schema["row"], T.StructField("cut_bytes", T.LongType()),
                           T.StructField("cut_spans", T.ArrayType(pair)), T.StructField("cut_kept", T.BinaryType()),
                           T.StructField("cut_text", T.StringType())])
    return joined.mapInArrow(cut, schema).select("row.*", *new)


def _whole_characters(text: bytes, starts: list[int], ends: list[int]) -> str:
    """What stays when the runs are narrowed to whole characters."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80  # noqa: E731  in the middle of a character
    out, at = [], 0
    for a, b in zip(starts, ends):
        while inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if b > a:
            out.append(text[at:a])
            at = b
    return b"".join([*out, text[at:]]).decode("utf-8")
