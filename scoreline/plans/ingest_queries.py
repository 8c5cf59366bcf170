"""Registered queries for loading: a raw match feed derived from the
adapter is written with the CSV sink (S8) under the shared checkpoint
folder, then loaded back with the tolerant reader (S1-S13).

The feed carries defects by fixed rules so every path of the loader runs:
a date in another layout, cut short or with text after it (rejected), a
fractional goal count (rejected), a team name with a comma, quotes and a line
break (must survive quoting), and missing
home goals (empty field, loaded as NULL)."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions import dates, ids, phases
from scoreline.session import scratch_path
from scoreline.sources import csv_ingest, landing, split_csv, tables

BAD_DATE_EVERY = 53
BAD_GOALS_EVERY = 59
QUOTED_NAME_EVERY = 61
QUOTED_SUFFIX = ', "B"\nreserves'


def raw_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Nine text columns per match, as a scraper would emit them."""
    m = tables.matches(spark, sf, keep_keys=True, balanced=True)
    season = phases.season_from_date(F.col("match_date"))
    home = F.when(F.col("l_partkey") % QUOTED_NAME_EVERY == 0,
                  F.concat(F.col("home_team"), F.lit(QUOTED_SUFFIX))).otherwise(F.col("home_team"))
    iso = dates.date_text(F.col("match_date"))
    m = m.select("*", season.alias("season"), home.alias("home_name"), iso.alias("iso_date"))
    m = phases.with_phase(m, "competition", F.col("match_date"), F.col("season"))
    return m.select(
        ids.match_id(F.col("competition"), F.col("season"), F.col("phase"), F.col("home_name"),
                     F.col("away_team"), F.col("iso_date")).alias("match_id"),
        "competition", "season", "phase",
        F.when(F.col("l_orderkey") % BAD_DATE_EVERY == 0,
               F.when(F.col("l_linenumber") % 3 == 0, F.date_format(F.col("match_date"), "dd/MM/yyyy"))
                .when(F.col("l_linenumber") % 3 == 1, F.date_format(F.col("match_date"), "yyyy"))
                .otherwise(F.concat("iso_date", F.lit(" or later"))))
         .otherwise(F.col("iso_date")).alias("match_date"),
        F.col("home_name").alias("home_team"), "away_team",
        F.col("home_goals").cast("string").alias("home_goals"),
        F.when(F.col("l_orderkey") % BAD_GOALS_EVERY == 0,
               F.concat(F.col("away_goals").cast("string"), F.lit(".5")))
         .otherwise(F.col("away_goals").cast("string")).alias("away_goals"),
    )


EMPTY_FILE, HEADER_FILE, BROKEN_FILE = ("UCL_empty_matches.csv", "UEL_header_matches.csv", "UECL_broken_matches.csv.gz")
CUT_FILE = "UECL_broken_00001_matches.csv.gz"
RETIRED_FILE = "UCL_champions_league_matches.csv_OLD.gz"


def _source_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """The file's name without part number and ``.gz``."""
    return df.withColumn("source_file", F.regexp_replace(name, r"(_([0-9a-f]{8}_)?\d{5})?_matches\.csv(\.gz)?$", "_matches.csv"))


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file into the landing folder, as a delivery would."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()


def _put_odd_files(spark: SparkSession, land: str) -> None:
    """An empty file, one with a header alone, a broken archive and one cut off
    midway."""
    header = ",".join(c.upper() for c in csv_ingest.RAW_MATCH_COLUMNS).encode() + b"\n"
    _put(spark, f"{land}/{EMPTY_FILE}", b"")
    _put(spark, f"{land}/{HEADER_FILE}", header)
    _put(spark, f"{land}/{BROKEN_FILE}", b"\x1f\x8b\x08 this is no archive")
    lines = b"".join(b"cut%d,UECL,,,,A%d,B,1,%d\n" % (i, i * 7919 % 9973, i % 7) for i in range(20_000))
    cut = gzip.compress(header + lines, mtime=0)
    _put(spark, f"{land}/{CUT_FILE}", cut[:len(cut) // 2])


def _landing(spark: SparkSession, sf: str, label: str) -> str:
    """A landing folder: the feed (UECL compressed), odd files and a retired file
    that must not be read."""
    land = f"{scratch_path(spark, label)}/landing"
    feed = raw_feed(spark, sf)
    csv_ingest.write_match_csv(feed.where(F.col("competition") != "UECL"), land)
    csv_ingest.write_match_csv(feed.where(F.col("competition") == "UECL"), land, compression="gzip")
    _put_odd_files(spark, land)
    header = ",".join(c.upper() for c in csv_ingest.RAW_MATCH_COLUMNS).encode() + b"\n"
    _put(spark, f"{land}/{RETIRED_FILE}", header + b"x,UCL,,,,A,B,1,1\n")
    return land


def _roundtrip(spark: SparkSession, sf: str) -> str:
    land = _landing(spark, sf, "csv-load")
    root = f"{land}-table"
    csv_ingest.load(spark, landing.list_files(spark, land), root, key="source_file", prepare=_source_name)
    return root


def q_csv_load_roundtrip(spark, sf):
    return csv_ingest.matches_table(spark, _roundtrip(spark, sf)).drop("load_datetime")


def q_csv_split_load(spark, sf):
    """S1 on files of any size: the same deliveries, uncompressed, read by as many
    tasks as they have splits."""
    land = f"{scratch_path(spark, 'csv-split')}/landing"
    csv_ingest.write_match_csv(raw_feed(spark, sf), land)
    return csv_ingest.accepted(csv_ingest.typed_with_reason(split_csv.read_raw_split(spark, land, glob=landing.MATCH_FILE_GLOB)))


def q_load_log(spark, sf):
    return csv_ingest.load_log(spark, _roundtrip(spark, sf)).drop("load_datetime")


def q_rejected_rows(spark, sf):
    return csv_ingest.rejects_table(spark, _roundtrip(spark, sf), "source_file").withColumnRenamed("source_file", "file_name")


def q_load_count(spark, sf):
    """Rows of the loaded table, all stamped."""
    table = csv_ingest.matches_table(spark, _roundtrip(spark, sf))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.count("load_datetime").alias("n_stamped"))


def q_file_inventory(spark, sf):
    """S6, O5 over the landing folder, without sizes and part numbers."""
    files = _source_name(landing.list_files(spark, _landing(spark, sf, "inventory")))
    named = files.groupBy(F.col("source_file").alias("file_name")).agg(F.min("path").alias("path"))
    return landing.inventory(named, 4).select("file_name", "place", "n_more")


def q_retired_names(spark, sf):
    """The landed files' names after retiring them; those retired before
    keep theirs."""
    land = _landing(spark, sf, "retire")
    landing.retire(spark, landing.retire_plan(landing.list_files(spark, land, glob="*")))
    files = landing.list_files(spark, land, glob="*")
    return files.select(F.regexp_replace("file_name", r"_([0-9a-f]{8}_)?\d{5}_matches", "_matches").alias("file_name")).distinct()


def q_publish_status(spark, sf):
    """A second delivery beside the first; names staged before are
    skipped, the others uploaded."""
    first = _source_name(landing.list_files(spark, _landing(spark, sf, "publish-1")))
    second = _source_name(landing.list_files(spark, _landing(spark, sf, "publish-2")))
    staged = first.select(F.col("source_file").alias("file_name")).where(~F.col("file_name").startswith("UECL")).distinct()
    offered = second.select(F.col("source_file").alias("file_name"), "path").groupBy("file_name").agg(F.min("path").alias("path"))
    return landing.status_counts(landing.upload_status(offered, staged))


def q_new_files(spark, sf):
    """Two deliveries land in one folder; after the first is logged as
    loaded only the second's files are new, though some bear the same names."""
    root = scratch_path(spark, "landing")
    feed = raw_feed(spark, sf)
    csv_ingest.write_match_csv(feed.where(F.col("competition") != "UECL"), f"{root}/batch1")
    glob = landing.MATCH_FILE_GLOB
    log = landing.list_files(spark, root, glob=glob, recursive=True)
    log.select("file_name", "path", "modification_time").write.parquet(f"{root}-log")
    log = spark.read.parquet(f"{root}-log")
    csv_ingest.write_match_csv(feed.where(F.col("competition") != "UEL"), f"{root}/batch2")
    new = landing.not_yet_loaded(landing.list_files(spark, root, glob=glob, recursive=True), log)
    raw = csv_ingest.read_raw(spark, [r.path for r in new.select("path").toLocalIterator()])
    rows = raw.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    new = _source_name(new.withColumn("path", F.regexp_replace("path", "^file:/+", "/")))
    rows = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return new.join(rows, "path").groupBy(
        F.regexp_extract("path", r"/(batch\d)/", 1).alias("batch"), F.col("source_file").alias("file_name")
    ).agg(F.sum("rows").alias("rows"))


def _streamed(spark: SparkSession, sf: str) -> str:
    """Two deliveries, the first beside a broken archive, one cut off midway and an
    empty file; each is drained by a run of the same stream."""
    from scoreline.streaming import file_stream
    root = scratch_path(spark, "stream")
    land, out, ckpt, away = (f"{root}/{d}" for d in ("landing", "out", "checkpoint", "quarantine"))
    feed = raw_feed(spark, sf)
    for i, batch in enumerate([feed.where(F.col("competition") != "UECL"),
                               feed.where(F.col("competition") == "UECL")]):
        csv_ingest.write_match_csv(batch, f"{land}/delivery{i}")
        if i == 0:
            _put_odd_files(spark, f"{land}/delivery0")
        q = file_stream.start_load(spark, land, out, ckpt, archive_dir=f"{root}/archive", key="source_file",
                                   prepare=_source_name, max_files_per_trigger=100, quarantine_dir=away)
        q.awaitTermination()
    return out


def q_stream_load(spark, sf):
    """S4+S5 as a stream: both deliveries' matches, each loaded once."""
    from scoreline.streaming import file_stream
    return file_stream.loaded_matches(spark, _streamed(spark, sf)).select(*csv_ingest.MATCH_COLUMNS)


def q_stream_log(spark, sf):
    """S10 of the stream: a log row for each file, broken and empty ones too."""
    from scoreline.streaming import file_stream
    return file_stream.loaded_log(spark, _streamed(spark, sf)).drop("load_datetime")


QUERIES = {
    "csv_load_roundtrip": q_csv_load_roundtrip,
    "csv_split_load": q_csv_split_load,
    "load_log": q_load_log,
    "rejected_rows": q_rejected_rows,
    "load_count": q_load_count,
    "file_inventory": q_file_inventory,
    "retired_names": q_retired_names,
    "publish_status": q_publish_status,
    "new_files": q_new_files,
    "stream_load": q_stream_load,
    "stream_log": q_stream_log,
}
