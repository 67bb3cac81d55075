"""Spark helpers shared by the operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import faretrail
from faretrail.session import materialize_at, release

ARROW_BATCH_BYTES = 8 << 20
#: Most keys that ``semi_join`` sends to every executor (8-byte to 32-byte keys).
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Settings that the operators with Python tasks need.

    Arrow batches are bounded by bytes as well as by rows, so that batches of
    very long texts stay small in the JVM and in the Python workers. Workers
    also look for this package where the driver has it (a session that ships
    or installs it does not need that).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    root = str(Path(faretrail.__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


class Scratch:
    """Tables written to the cluster's shared folder while an operator runs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here, nothing is recomputed."""
        out, path = materialize_at(df, self.name)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        release(self.spark, [self._paths.pop(id(f))[1] for f in frames if id(f) in self._paths])

    def result(self, df: DataFrame) -> DataFrame:
        """Write ``df``, delete every other table of this run, and read it back.
        ``release_results`` deletes it once its reader is done."""
        old = [frame for frame, _ in self._paths.values()]
        out = self.keep(df)
        self.drop(*old)
        _RESULTS.append(self._paths[id(out)][1])
        return out


_RESULTS: list[str] = []


def release_results(spark: SparkSession) -> None:
    """Delete the tables of all results handed out by ``Scratch.result``."""
    release(spark, _RESULTS)
    _RESULTS.clear()


def semi_join(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``. The keys are counted first:
    up to ``limit`` they are broadcast, beyond it both sides are shuffled."""
    right = keys.select(on).distinct()
    if keys.count() <= limit:
        right = F.broadcast(right)
    return df.join(right, on, "left_semi")


def skew_join(left: DataFrame, right: DataFrame, on, weight: str, rows: int, shares: int = 10_000) -> DataFrame:
    """Inner join of ``left`` (``rows`` rows) with ``right``, which has one row
    per key and in ``weight`` the key's number of rows in ``left``.

    Keys above a ``shares``-th of all rows are broadcast: there are fewer than
    ``shares`` of them whatever the input. The rows of the other keys are
    shuffled, and no key of theirs is more than that share of them.
    """
    keys = [on] if isinstance(on, str) else list(on)
    heavy = F.col(weight) > max(rows // shares, 1_000)
    hot = right.where(heavy)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(right.where(~heavy), keys))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted number of ``rows`` allows it."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
