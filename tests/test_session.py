import os
import subprocess
import sys

import pytest

from scoreline.session import checkpoint_root, compiled_methods, scratch_path
from scoreline.sources import tables


def test_scratch_lives_under_session_checkpoint_dir(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == root
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(root) and a != b


def test_spread_only_when_the_session_says_so(spark):
    one = spark.range(0, 1000, numPartitions=1)
    assert tables.spread(one) is one                     # no setting: no shuffle
    spark.conf.set(tables.SCAN_PARTITIONS, "5")
    try:
        assert tables.spread(one).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(tables.SCAN_PARTITIONS)


def test_a_local_session_without_a_checkpoint_folder_gets_one():
    code = ("from scoreline.session import build_session, checkpoint_root, scratch_path\n"
            "s = build_session('local[1]')\n"
            "assert checkpoint_root(s) == checkpoint_root(s) and scratch_path(s, 'a').startswith(checkpoint_root(s))\n"
            "assert s.range(3).checkpoint().count() == 3\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=300, capture_output=True)


def test_the_method_size_setting_is_put_back(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), compiled_methods(spark):
        assert spark.conf.get(key) == "8000"
        raise ValueError
    assert spark.conf.get(key) == before
