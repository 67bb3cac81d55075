"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants; applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size shuffle partitions by bytes (advisory 64 MB), not by core count
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "faretrail", **conf) -> SparkSession:
    """Build (or attach to) a session with UTC time and AQE on.

    On a cluster call it without ``master``; the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of the files behind ``paths`` (globs allowed), from the
    file system's metadata; nothing is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in [paths] if isinstance(paths, str) else paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        for st in fs.globStatus(hp) or []:
            total += fs.getContentSummary(st.getPath()).getLength()
    return total


def size_shuffle_partitions(spark: SparkSession, nbytes: int, target_bytes: int = 256 << 20,
                            floor: int | None = None) -> int:
    """Set ``spark.sql.shuffle.partitions`` so a full-width shuffle of
    ``nbytes`` gives partitions of about ``target_bytes`` (AQE then only
    coalesces small ones; it cannot split a partition that is too big).
    Returns the number set."""
    floor = floor or spark.sparkContext.defaultParallelism
    n = max(floor, -(-nbytes // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts: ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests, laptops) may get a
    fresh temporary folder when the setting is unset; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="faretrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage (a lost executor recomputes from the written files, not from
    the raw scan and the window) and lets later reports read only the columns
    they need. Returns the re-read DataFrame; ``materialize_at`` also gives
    the folder, for ``release``.
    """
    return materialize_at(df, name, partition_by)[0]


def materialize_at(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``materialize`` that also returns the folder written."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "faretrail", f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path), path


#: Bytes of a method up to which HotSpot compiles it.
_COMPILED_BYTES = 8000


@contextmanager
def compiled_projections(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside have every generated method compiled.

    A stage with some dozens of computed columns becomes one method that is
    too long for HotSpot, which then interprets it for every row. Below this
    limit Spark generates such operators one by one, in methods of bounded
    length. The session's own limit is put back at the end.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), _COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession, paths) -> None:
    """Delete written intermediate tables from the shared folder (through the
    Hadoop FileSystem of each path, so any cluster store works)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
