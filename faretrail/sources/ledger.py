"""A6/A7 by a ledger of files: only files not counted yet are read.

The ledger is a Parquet table in the caller's folder, a row per (file, card
type) with the file's length and modification time. A run compares the listed
files with it (metadata only), reads those that are new or changed in one
scan, appends their counts and answers from the ledger. A file without rows
has an entry without a type, so it is not read again either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import aggregates as A
from ..operators import transfers as T
from ..schemas import CARD_SCHEMA
from .delimited import read_delimited
from .snapshots import FILE_DATE_PATTERN, path_key, qualified_paths, with_snapshot_date

_ENTRY = "file_path string, length long, modified long, snapshot_date date, CARD_TYP_CD string, typeCount long"


def file_states(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_path, length, modified) of the listed files, from the file system's metadata."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for p in qualified_paths(spark, paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        state = path.getFileSystem(conf).getFileStatus(path)
        rows.append((p, state.getLen(), state.getModificationTime()))
    return spark.createDataFrame(rows, "file_path string, length long, modified long").withColumn("file_path", path_key(encoded=False))


class CardLedger:
    """Counts per card file, kept under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, pattern: str = FILE_DATE_PATTERN, fmt: str = K.SNAPSHOT_FILE_DATE_FORMAT,
                 sep: str = "|"):
        self.spark, self.folder, self.pattern, self.fmt, self.sep = spark, folder, pattern, fmt, sep

    def entries(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(self.folder)

    def update(self, paths: Sequence[str]) -> list[str]:
        """Count the files that are new or changed; returns their paths."""
        states = file_states(self.spark, paths)
        known = self.entries().select("file_path", "length", "modified").distinct()
        new = states.join(known, ["file_path", "length", "modified"], "left_anti")
        todo = [r["file_path"] for r in new.collect()]  # file names, not data
        if not todo:
            return []
        listed = self.spark.createDataFrame([(p,) for p in todo], "file_path string").join(states, "file_path")
        dated = with_snapshot_date(listed, pattern=self.pattern, fmt=self.fmt)
        cards = read_delimited(self.spark, todo, CARD_SCHEMA, sep=self.sep, with_file_path=True).withColumn("file_path", path_key())
        counts = A.card_type_counts(T.clean_cards(cards), date_col="file_path")
        rows = dated.join(counts, "file_path", "left")
        marks = dated.withColumns({"CARD_TYP_CD": F.lit(None).cast("string"), "typeCount": F.lit(0).cast("long")})
        full = rows.where(F.col("typeCount").isNotNull()).select(*marks.columns).unionByName(marks)
        full.coalesce(1).write.mode("append").parquet(self.folder)  # a row per new file and type
        return todo

    def _current(self, paths: Sequence[str]) -> DataFrame:
        return self.entries().join(file_states(self.spark, paths), ["file_path", "length", "modified"], "left_semi")

    def data_count(self, paths: Sequence[str]) -> DataFrame:
        """(file_path, snapshot_date, cardCount) of every listed file."""
        self.update(paths)
        return self._current(paths).groupBy("file_path", "snapshot_date").agg(F.sum("typeCount").alias("cardCount"))

    def card_count(self, paths: Sequence[str]) -> DataFrame:
        """(file_path, snapshot_date, CARD_TYP_CD, typeCount)."""
        self.update(paths)
        return self._current(paths).where(F.col("typeCount") > 0).select("file_path", "snapshot_date", "CARD_TYP_CD", "typeCount")
