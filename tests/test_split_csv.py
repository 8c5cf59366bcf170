"""The splitting reader against the reader of whole files."""

import random

from scoreline.schemas import RAW_MATCH_COLUMNS
from scoreline.sources import csv_ingest, split_csv

HEADER = ",".join(c.upper() for c in RAW_MATCH_COLUMNS)


def both(spark, folder, size):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = split_csv.read_raw_split(spark, str(folder), glob="*.csv")
        tasks = split_csv._lines(spark, str(folder), "*.csv", False).rdd.getNumPartitions()
        got = sorted(map(repr, split.collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return got, sorted(map(repr, csv_ingest.read_raw(spark, str(folder), glob="*.csv").collect())), tasks


def test_state_of_a_line():
    for line, inside in ((b"a,b", False), (b'a,"b', True), (b'a,"b"', False), (b'a,"b""', True), (b'b",c', False), (b'b",c,"d', True),
                         (b'a"b,c', False), (b'"a""b",c', False), (b"", False), (b'""', False), (b' "x', True), (b'"a"b",c', False)):
        assert split_csv.ends_inside(line, False) == inside, line
        assert split_csv.ends_inside(line, True) == split_csv.ends_inside(b'"' + line, False), line


def test_equal_rows_at_any_split(spark, tmp_path):
    rng = random.Random(3)
    fields = ["x", "", "Zürich", '"with, comma"', '"line\nbreak"', '"two\n\nbreaks and ""quotes"""', '""', 'a "b" c', ' "padded" ', "12", '"\n"',
              '"ends with quote """', '"a,b\n,c""\n"",d"']
    for name in "abc":
        rows = [",".join(rng.choice(fields) for _ in range(rng.choice([9, 9, 9, 4, 11]))) for _ in range(30)]
        (tmp_path / f"{name}.csv").write_text("\n".join([HEADER, *rows[:15], "", *rows[15:]]) + "\n" * (name != "c"))
    (tmp_path / "crlf.csv").write_bytes("\r\n".join([HEADER, 'a,"b\r\nc",d,e,f,g,h,1,2', "x,y,z,1,2,3,4,5,6", ""]).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_text(HEADER + "\n")
    for size in (150, 1_000, 100_000):
        got, want, tasks = both(spark, tmp_path, size)
        assert got == want, (size, [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
        assert size > 1_000 or tasks >= 5


def test_a_record_over_many_splits_and_bad_bytes(spark, tmp_path):
    long = '"' + "line, of text\n" * 200 + '"'
    (tmp_path / "long.csv").write_bytes(f"{HEADER}\na,b,{long},d,e,f,g,1,2\nlast,".encode() + b"\xff\xfe,c\n")
    got, want, tasks = both(spark, tmp_path, 64)
    assert tasks > 5 and len(got) == 2 and got == want


def test_a_record_is_parsed_once_under_a_filter(spark, tmp_path):
    (tmp_path / "UCL_x_matches.csv").write_text(f"{HEADER}\na,UCL,s,p,2025-10-01,A,B,1,2\nb,UCL,s,p,no date,A,B,1,2\n")
    got = csv_ingest.accepted(csv_ingest.typed_with_reason(split_csv.read_raw_split(spark, str(tmp_path), glob="*.csv")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv(") == 1, plan
    assert [r.match_id for r in got.collect()] == ["a"]
