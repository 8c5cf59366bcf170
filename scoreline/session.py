"""Session construction and the shared scratch location.

Everything that must outlive a task (written tables, checkpoints, landing
directories used by the file stream) lives under ``spark.checkpoint.dir``,
which on a cluster names a shared filesystem.  The session value is always
read first; only a local session that names none gets a private directory.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
#: private folders of local sessions that name none, by application
_PRIVATE: dict[str, str] = {}


# Settings for a large cluster (100 TB of input): many initial shuffle
# partitions that AQE coalesces to ~128 MB, 256 MB file splits, and skew
# splitting for joins.  Pass as ``build_session(extra=CLUSTER_CONF)``.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "scoreline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions",
                (extra or {}).get("spark.sql.shuffle.partitions", str(shuffle_partitions)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a local session (tests, a bench) may name none: it gets a private
    folder, remembered for the application (the setting itself cannot be changed
    in a running session) and given to ``DataFrame.checkpoint``.
    On a cluster executors could not see such a folder, so there it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get(_CKPT_KEY, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that driver and executors share")
        root = _PRIVATE.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="scoreline-ckpt-")
        _PRIVATE[context.applicationId] = root
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique sub-path of the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: the largest method, in bytes of code, that the Java virtual machine compiles
COMPILED_BYTES = 8000


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """For one job of many wide expressions: steps whose generated method the Java
    virtual machine would only interpret are evaluated outside whole-stage code,
    in methods that it compiles.  The session's setting is put back."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: shuffled bytes a task of costly rows reads at most, and its tasks for each core at least
COSTLY_BYTES, COSTLY_TASKS_PER_CORE = 8 << 20, 4


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """For one job that takes long for each shuffled byte: its narrow rows would be
    joined to tasks of minutes, hardly more than there are cores, of which a few
    would run alone at the end.  The session's settings are put back."""
    size, number = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionNum"
    before = {key: spark.conf.get(key, None) for key in (size, number)}
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(size, str(COSTLY_BYTES))
    spark.conf.set(number, str(max(int(before[number] or 1), COSTLY_TASKS_PER_CORE * cores)))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
