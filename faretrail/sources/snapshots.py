"""Card snapshot files, one file per date.

The reference loops over the files on the driver, reading each one two or
three times. Here all listed files are one scan; the snapshot date comes from
each row's file path through the hidden ``_metadata`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..schemas import CARD_SCHEMA, MANIFEST_SCHEMA
from .delimited import read_delimited

FILE_DATE_PATTERN = r"(\d{8})[^/]*$"


def read_manifest(spark: SparkSession, manifest_paths: str, path_col: str = "x") -> list[str]:
    """S3: the file list named in manifest CSV files (``,`` separated).

    Only the path column reaches the driver: the reader needs the list of
    files, which is not data.
    """
    df = read_delimited(spark, manifest_paths, MANIFEST_SCHEMA, sep=",").drop("_c0")
    rows = df.select(F.col(path_col).alias("path")).where(F.col("path").isNotNull()).collect()
    return [r.path for r in rows]


def qualified_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """``paths`` with the scheme, authority and folder that their file system
    gives them, so that each names a file as the scan does."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = [hadoop.Path(p) for p in paths]
    return [p.getFileSystem(conf).makeQualified(p).toString() for p in found]


def path_key(col: str = "file_path", encoded: bool = True) -> Column:
    """One spelling of a qualified file name: ``encoded`` undoes the escapes of
    the scan's ``_metadata.file_path``, and an empty authority is left out."""
    path = F.col(col)
    if encoded:  # in a URI path "+" is a plus sign
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def with_snapshot_date(df: DataFrame, path_col: str = "file_path",
                       pattern: str = FILE_DATE_PATTERN,
                       fmt: str = K.SNAPSHOT_FILE_DATE_FORMAT) -> DataFrame:
    """``snapshot_date`` (DATE) from the 8 digits in the file name."""
    digits = F.regexp_extract(F.col(path_col), pattern, 1)
    return df.withColumn("snapshot_date", F.try_to_date(F.nullif(digits, F.lit("")), fmt))


def snapshot_text(col: str = "snapshot_date", fmt: str = K.SNAPSHOT_DATE_TEXT_FORMAT):
    """The reference's ``dd-MMM-yyyy`` text of a snapshot date."""
    return F.date_format(F.col(col), fmt)


def read_card_snapshots(spark: SparkSession, paths, schema: T.StructType = CARD_SCHEMA,
                        sep: str = "|", keep_file: bool = False) -> DataFrame:
    """S2 + S4: every card file in one scan, with its ``snapshot_date``
    (and its ``file_path`` when ``keep_file``)."""
    df = with_snapshot_date(read_delimited(spark, paths, schema, sep=sep, with_file_path=True))
    return df if keep_file else df.drop("file_path")


def latest_snapshot(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Rows of the most recent snapshot (a scalar max, then a filter).

    Catalyst plans the max as a separate aggregate whose one-row result is
    broadcast; the rows are never gathered.
    """
    latest = df.agg(F.max(date_col).alias("__latest"))
    return df.join(F.broadcast(latest), F.col(date_col) == F.col("__latest"), "left_semi")
