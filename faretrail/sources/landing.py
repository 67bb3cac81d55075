"""Dated landing of journeys: a new day is added without reading the others.

Journeys land as Parquet with a folder per tag-on date. Landing replaces the
folders of the dates it brings and leaves all others (dynamic partition
overwrite), so landing a day again is safe. Reading some days reads their
folders only; the transfer lookup works within a date, so cleaning a day needs
no other day.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JourneyConfig
from ..operators import transfers as T
from ..schemas import JOURNEY_COLUMNS

DATE = "TAG1_DT_FK"


def land_journeys(raw: DataFrame, folder: str, cfg: JourneyConfig | None = None, files_per_day: int = 1) -> None:
    """Select (F1, P1) and land the journeys of ``raw``, each date in
    ``files_per_day`` files, so one hot day is written by several tasks."""
    rows = T.select_journeys(raw, cfg)
    spread = F.pmod(F.xxhash64("JRNY_ID", "CARD_FK", "TAG1_TM"), F.lit(files_per_day))
    rows.repartition(F.col(DATE), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        DATE).parquet(folder)


def landed_journeys(spark: SparkSession, folder: str, days: Iterable[int] | None = None) -> DataFrame:
    """The landed journeys of some days (all by default), in the columns' order."""
    rows = spark.read.parquet(folder).withColumn(DATE, F.col(DATE).cast("int")).select(*JOURNEY_COLUMNS)
    return rows if days is None else rows.where(F.col(DATE).isin([int(d) for d in days]))


def clean_days(spark: SparkSession, folder: str, days: Iterable[int], cfg: JourneyConfig | None = None) -> DataFrame:
    """C10 of some landed days; only their folders are read."""
    return T.clean_journeys(landed_journeys(spark, folder, days), cfg)
