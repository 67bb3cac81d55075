"""Delimited text with a header, typed by name.

Spark binds a user schema on CSV by *position*; a file whose header order
differs would silently swap columns. So every column is read as text with the
header, then selected by name and ``try_cast`` to the declared type (bad
values become null instead of failing the job). Schema inference (one more
pass over all files, and it turns ``07:30:00`` into a timestamp on today's
date) is only used when asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parallel import ensure_parallelism


def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
                   sep: str = "|", infer_schema: bool = False, with_file_path: bool = False,
                   parallel: int | None = None) -> DataFrame:
    """Read one path, a glob (S2) or a list of paths as one table.

    ``schema`` columns are looked up by header name and cast with
    ``try_cast``; a column missing from the files raises at analysis time.
    ``with_file_path`` adds ``file_path`` from the hidden ``_metadata``
    column (for S4). ``parallel`` spreads an input of fewer splits, such as one
    gzip file, over that many partitions (a shuffle of every row; off by default).
    """
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    if infer_schema and schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.option("inferSchema", False)
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = reader.csv(paths)
    # the hidden file column exists only on the scan itself: take it first
    extra = [F.col("_metadata.file_path").alias("file_path")] if with_file_path else []
    if schema is None:
        out = raw.select(*[F.col(f"`{c}`") for c in raw.columns], *extra)
    else:
        out = raw.select(
            *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields],
            *extra,
        )
    return ensure_parallelism(out, parallel) if parallel else out
