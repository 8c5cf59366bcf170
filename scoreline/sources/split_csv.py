"""S1 for large files: one CSV file read by many tasks, though its quoted fields
may hold line breaks.

A task that starts in the middle of a file cannot see whether it starts inside
quotes.  So the files are read as lines, which Spark splits, and each line is a
function from "is inside quotes before it" to "is inside quotes behind it"; a
line without quotes changes nothing.

1. A first pass composes these functions over each split: one row a split, with
   what it leaves behind when it is entered outside and inside quotes.
2. Along the splits of a file those rows say how each split is entered: the last
   split before it that ends alike either way decides, and every later one that
   turns the state over.
3. A second pass joins lines to records inside each split.  What the split
   before has begun, and what it leaves open itself, are handed out as
   fragments, at most two a split, and put together by file and number.
4. Records are parsed by ``from_csv`` with the options of the whole-file reader.

Lines never leave their split, unless a table of split states outgrows what
Spark broadcasts by itself; then lines are dealt out by split and sorted.  Both
passes read the file, so prefer ``csv_ingest.read_raw`` for files that fit a
task.  Compressed files cannot be split: each is one task here, as there.  A
record must fit a task: a quote that is never closed makes one of all that
follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.schemas import RAW_MATCH_COLUMNS
from scoreline.session import scratch_path
from scoreline.sources.csv_ingest import CSV_READ_OPTIONS, file_reader

_OPENS = re.compile(rb'[ \t]*+"')
_CLOSES = re.compile(rb'(?:[^"]|"")*+"')

SPLIT = ["file_path", "split"]
RECORD = "file_path string, split bigint, number bigint, file_name string, changed bigint, kind string, record binary"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether ``line``, entered inside quotes or not, ends inside quotes.  A
    quote opens a field only at its start; one inside a plain field is text."""
    at = 0
    while True:
        if inside:
            close = _CLOSES.match(line, at)
            if close is None:
                return True
            at = close.end()
        else:
            opening = _OPENS.match(line, at)
            if opening:
                at, inside = opening.end(), True
                continue
        comma = line.find(b",", at)
        if comma < 0:
            return False
        at, inside = comma + 1, False


def _lines(spark: SparkSession, paths, glob: str | None, recursive: bool) -> DataFrame:
    df = file_reader(spark, glob, recursive).option("lineSep", "\n").text(list(paths) if isinstance(paths, (list, tuple)) else [paths])
    return df.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_name").alias("file_name"),
                     F.unix_micros("_metadata.file_modification_time").alias("changed"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(split, from, to) of the rows of one split that follow each other."""
    paths, splits = batch.column("file_path"), batch.column("split").to_numpy()
    start, n = 0, len(splits)
    while start < n:
        key = (paths[start].as_py(), int(splits[start]))
        end = start + 1
        while end < n and splits[end] == key[1] and paths[end].as_py() == key[0]:
            end += 1
        yield key, start, end
        start = end


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, after = None, [False, True]

    def row(key, after) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([after[0]]), pa.array([after[1]])],
                                          [*SPLIT, "from_outside", "from_inside"])
    for batch in batches:
        quoted = pc.match_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False)
        for now, start, end in _runs(batch):
            if now != key:
                if key is not None:
                    yield row(key, after)
                key, after = now, [False, True]
            for i in quoted[start:end].nonzero()[0].tolist():
                line = batch.column("line")[start + i].as_py()
                both = ends_inside(line, False), ends_inside(line, True)
                after = [both[a] for a in after]
    if key is not None:
        yield row(key, after)


def split_states(lines: DataFrame) -> DataFrame:
    """file_path, split, inside: whether each split is entered inside quotes."""
    schema = "file_path string, split bigint, from_outside boolean, from_inside boolean"
    path = scratch_path(lines.sparkSession, "csv-splits")
    lines.mapInArrow(_states, schema).write.parquet(path)
    # in the end a split belongs to one file, so a window holds one file's splits
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    turns = F.count(F.when(F.col("from_outside") & ~F.col("from_inside"), 1))
    rows = lines.sparkSession.read.schema(schema).parquet(path).withColumn("turns", turns.over(before))
    last = F.last(F.when(fixed, F.struct("from_outside", "turns")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last)
    left = F.coalesce(F.col("last.from_outside"), F.lit(False)).cast("int") + F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    return rows.select(*SPLIT, (left % 2 == 1).alias("inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(kinds)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RECORD.split(", ")])

    split = None
    for batch in batches:
        quoted = pc.match_substring(batch.column("line"), '"').to_pylist()
        lines = batch.column("line").to_pylist()
        for key, start, end in _runs(batch):
            if split is None or key != split.key:
                if split:
                    out.extend(split.rest())
                split = _Split(key, *[batch.column(c)[start].as_py() for c in ("file_name", "changed", "inside")])
            out.extend(split.records(lines[start:end], quoted[start:end]))
        yield emit()
    if split:
        out.extend(split.rest())
    yield emit()


class _Split:
    """Joins the lines of one split to records."""

    def __init__(self, key: tuple[str, int], file_name: str, changed: int, inside: bool):
        self.key, self.lineage, self.inside = key, (file_name, changed), inside
        self.opened = not inside                       # the record at hand began here
        self.held: list[bytes] = []
        self.number = -1 if key[1] == 0 else 0         # a file's header is its record -1

    def records(self, lines: list[bytes], quoted: list[bool]) -> Iterator[tuple]:
        for line, marks in zip(lines, quoted):
            if not self.held and not self.inside:
                self.opened = True
                if not marks and not line.strip():     # a blank line
                    continue
            if marks:
                self.inside = ends_inside(line, self.inside)
            self.held.append(line)
            if not self.inside:
                if self.number >= 0 or not self.opened:
                    yield self._row("whole" if self.opened else "rest")
                self.number, self.held = self.number + 1, []

    def rest(self) -> Iterator[tuple]:
        if self.held:                                  # left open, or all of the split lies inside quotes
            yield self._row("open" if self.opened else "inner")

    def _row(self, kind: str) -> tuple:
        return (*self.key, self.number, *self.lineage, kind, b"\n".join(self.held))


def records(lines: DataFrame) -> DataFrame:
    """file_path, file_name, changed, split and number (place where it begins) and
    record (its bytes) of every record of ``lines`` but the files' headers."""
    states = split_states(lines.select("line", *SPLIT))
    placed = lines.withColumn("at", F.monotonically_increasing_id()).join(states, SPLIT)
    placed = placed.sortWithinPartitions(*SPLIT, "at").drop("at")
    path = scratch_path(lines.sparkSession, "csv-records")
    placed.mapInArrow(_records, RECORD).write.partitionBy("kind").parquet(path)
    parts = lines.sparkSession.read.schema(RECORD).parquet(path)
    along = Window.partitionBy("file_path").orderBy("split", "number")
    pieces = parts.where("kind != 'whole'").withColumn("nth", F.count(F.when(F.col("kind") == "open", 1)).over(along))
    joined = F.array_sort(F.collect_list(F.struct("split", "number", "record")))
    broken = pieces.groupBy("file_path", "file_name", "changed", "nth").agg(joined.alias("p"))
    begun = broken.select("file_path", "file_name", "changed", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["number"].alias("number"),
                          F.aggregate(F.transform("p", lambda x: x["record"]), F.lit(None).cast("binary"),
                                      lambda a, r: F.when(a.isNull(), r).otherwise(F.concat(a, F.lit(b"\n"), r))).alias("record"))
    return parts.where("kind = 'whole'").drop("kind").unionByName(begun.where("number >= 0"))


def read_raw_split(spark: SparkSession, paths, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """What ``csv_ingest.read_raw`` returns, each file read by as many tasks as it
    has splits.  Blank lines outside quotes are no records; each file's first
    record is its header.  Bytes that are no UTF-8 become U+FFFD.  Empty files
    give no rows."""
    found = records(_lines(spark, paths, glob, recursive))
    text = F.regexp_replace(F.replace(F.make_valid_utf8(F.col("record").cast("string")), F.lit("\r\n"), F.lit("\n")), r"\r$", "")
    options = {k: v for k, v in CSV_READ_OPTIONS.items() if k not in ("header", "enforceSchema", "encoding")}
    fields = ", ".join(f"{c} string" for c in RAW_MATCH_COLUMNS)
    # as a generator's row a record is parsed once: a filter on its columns would else
    # be moved before the parse and repeat it for each of them
    parsed = found.select(F.inline(F.array(F.from_csv(text, fields, options))), "file_path", "file_name", "changed")
    return parsed.select(*RAW_MATCH_COLUMNS, "file_path", "file_name",
                         F.timestamp_micros("changed").alias("file_modification_time"))
