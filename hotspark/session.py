"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "hotspark", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; `conf` keys use _ in place of dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("_", "."), value)
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    _ship_package(spark)
    return spark


#: Bytes, by the planner's size check, up to which a step of many joins sends a side through the driver.
SMALL_SIDE = 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession):
    """Joins planned inside send a side through the driver only if it is tiny.

    A step joins its growing tables dozens of times; each of them may be just below the usual
    limit, so that the driver would receive all of them, every step.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    low = spark.conf.get(keys[0])
    for key in keys:
        spark.conf.set(key, "-1" if low.startswith("-") else f"{SMALL_SIDE}b")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="hotspark-code-"), "hotspark"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own (tests);
    on a cluster a missing setting is an error, since a machine-local folder
    would be lost with its executor.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = _local_dirs.get(sc.applicationId)
        if path is None:
            path = _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="hotspark-")
    return f"{path.rstrip('/')}/hotspark-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_out(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write a frame as parquet under the shared folder and return its path."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write once, read back.

    A lost executor then costs one re-read, not a replay of all rounds, and the
    reader sees true file sizes, so the join planner decides on checked numbers.
    """
    path = write_out(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_memo: dict[tuple[str, str, str], str] = {}
#: Seconds that each derived table took to build, and the names read since the list was last emptied (for the bench).
memo_seconds: dict[str, float] = {}
memo_reads: list[str] = []


def memo_table(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """A derived table kept for the session: built on first use, then re-read."""
    key = (spark.sparkContext.applicationId, scope, name)
    memo_reads.append(name)
    if key not in _memo:
        began = time.perf_counter()
        _memo[key] = write_out(build(), name)
        memo_seconds[name] = time.perf_counter() - began
    return spark.read.parquet(_memo[key])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of a Python group step over all cores.

    The step's cost is in Python time, not in bytes, so the planner must not
    squeeze its input into few tasks for being small.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
