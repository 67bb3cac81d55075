"""Use every core even when a source is not splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``min_partitions`` (default: the cluster's
    default parallelism) only if its scan yields fewer partitions.

    A single-row-group Parquet file or a gzip CSV is read by one task; every
    per-row expression before the first shuffle would then run serially. A
    large input already has many splits and is returned unchanged (no extra
    shuffle).
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()  # plans the scan, runs nothing
    return df.repartition(want) if have < want else df
