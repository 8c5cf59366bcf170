"""Incremental loading of landed match files (S4 + S5 as a stream).

The file source remembers which files it has seen in its checkpoint, so each
file is loaded exactly once however often the job runs; with an archive folder
read files are moved there (the "retire" step).  ``trigger(availableNow=True)``
drains what has landed and stops, so the same code serves scheduled batch runs
and a continuous stream.

The stream itself carries names, not contents: a micro-batch is a list of at
most ``max_files_per_trigger`` files.  Those are loaded as in a full refresh: at
once, and isolated only after a failure, so one broken file holds up no other
and no later run.  Rows and log rows of a micro-batch are written under a name
of their own and published by one marker with the batch's number (``commits``).
A batch that is replayed after a failure finds its number and does nothing, or
finds none and is loaded anew; readers only see published batches.  Broken
files are logged ``ERROR`` and, if a quarantine folder is given, moved there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreline.sources import commits, csv_ingest
from scoreline.sources.landing import MATCH_FILE_GLOB, list_files


def landed_files(spark: SparkSession, landing_dir: str, glob: str = MATCH_FILE_GLOB, archive_dir: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of landed files: path, file_name, length, modification_time.
    Their contents are not read."""
    r = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
         .option("pathGlobFilter", glob).option("recursiveFileLookup", "true"))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(landing_dir).select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), "length",
                                      F.col("modificationTime").alias("modification_time"))


def load_batch(files: DataFrame, number: int, landing_dir: str, out_root: str, key: str = "file_name", prepare=None,
               quarantine_dir: str | None = None, glob: str = MATCH_FILE_GLOB) -> None:
    """Load one micro-batch and publish it under its number.  Empty files, which
    the file source passes over, are logged with the first batch that finds
    them."""
    spark = files.sparkSession
    if number in {n for n, _ in commits.published(spark, out_root)}:
        return
    name = uuid.uuid4().hex[:12]
    rows = [(r.path, r.file_name, r.length, r.modification_time) for r in files.toLocalIterator()]
    listing = spark.createDataFrame(rows, files.schema)
    empty = list_files(spark, landing_dir, glob=glob, recursive=True).where("length = 0")
    known = _published(spark, out_root, "files")
    if known is not None:
        empty = empty.join(known.select("path", "modification_time"), ["path", "modification_time"], "left_anti")
    result = csv_ingest.stage_files(spark, [r[0] for r in rows], out_root, name, prepare)
    written = csv_ingest.staged_rows(spark, csv_ingest.no_rows(spark, prepare), result.rows_path)
    seen = csv_ingest.with_readable(listing.unionByName(empty.select(*listing.columns)), result.broken)
    seen = prepare(seen) if prepare else seen
    seen.write.parquet(f"{out_root}/files/load={name}")
    seen = spark.read.schema(seen.schema).parquet(f"{out_root}/files/load={name}")
    csv_ingest.load_log_rows(written, key, seen).write.parquet(f"{out_root}/log/load={name}")
    commits.publish(spark, out_root, name, number)
    if quarantine_dir:
        fs, path = commits.file_system(spark, quarantine_dir)
        for file in result.broken:
            fs.mkdirs(path(quarantine_dir))
            # on a replay it may have gone already; its name is kept apart by its batch
            fs.rename(path(file), path(f"{quarantine_dir}/{number:012d}-{file.rsplit('/', 1)[-1]}"))


def start_load(spark: SparkSession, landing_dir: str, out_root: str, checkpoint_dir: str,
               archive_dir: str | None = None, key: str = "file_name", prepare=None, available_now: bool = True,
               max_files_per_trigger: int | None = 1000, quarantine_dir: str | None = None) -> StreamingQuery:
    """Start the incremental load; ``prepare`` may add columns (e.g. a logical
    source name) to raw rows and file lists before typing.  A micro-batch reads
    ``max_files_per_trigger`` files at most.  A quarantine folder must not lie in
    the landing folder."""
    files = landed_files(spark, landing_dir, archive_dir=archive_dir, max_files_per_trigger=max_files_per_trigger)

    def load(batch: DataFrame, number: int) -> None:
        load_batch(batch, number, landing_dir, out_root, key, prepare, quarantine_dir)

    w = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _published(spark: SparkSession, out_root: str, kind: str) -> DataFrame | None:
    """What the published batches wrote under ``kind``; a batch may have none."""
    fs, path = commits.file_system(spark, out_root)
    folders = [f"{out_root}/{kind}/load={name}" for _, name in commits.published(spark, out_root)]
    folders = [f for f in folders if fs.exists(path(f))]
    return spark.read.option("basePath", f"{out_root}/{kind}").parquet(*folders) if folders else None


def _rows(spark: SparkSession, out_root: str) -> DataFrame:
    """Typed rows of all published batches, with ``load_status``."""
    rows = _published(spark, out_root, "rows")
    return csv_ingest.staged_rows(spark, csv_ingest.no_rows(spark, None), f"{out_root}/none") if rows is None else rows


def loaded_matches(spark: SparkSession, out_root: str) -> DataFrame:
    return (_rows(spark, out_root).where(F.col(csv_ingest.STATUS) == "accepted")
            .select(*csv_ingest.MATCH_COLUMNS, "load_datetime"))


def loaded_rejects(spark: SparkSession, out_root: str, key: str = "file_name") -> DataFrame:
    return csv_ingest.rejected(_rows(spark, out_root).where(F.col(csv_ingest.STATUS) == "rejected"), key)


def loaded_log(spark: SparkSession, out_root: str) -> DataFrame:
    """One row for each file of each published batch, as of ``csv_ingest.load_log``."""
    log = _published(spark, out_root, "log")
    if log is None:
        raise FileNotFoundError(f"nothing is published in {out_root}")
    return log.drop("load")
