"""F6/F7 by a calendar table instead of lists of dates.

Lists of dates are literals in the plan, which suits a month and not decades.
A calendar is a DataFrame (``day`` as yyyyMMdd, ``day_class``); trips meet it in
a semi, anti or left join. Its days are counted: up to ``BROADCAST_DAYS`` they
are broadcast, so a hot date is not shuffled to one task. A null date is in no
class and on no list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JourneyConfig

#: Days that are sent to every executor (more than two thousand years of them).
BROADCAST_DAYS = 1_000_000


def calendar_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day of ``first`` to ``last`` (ISO dates) with its class by the
    calendar: ``sunday``, ``saturday`` or ``weekday``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    dow = F.dayofweek("d")
    kind = F.when(dow == 1, "sunday").when(dow == 7, "saturday").otherwise("weekday")
    return days.select(F.date_format("d", "yyyyMMdd").cast("int").alias("day"), kind.alias("day_class"))


def listed_days(spark: SparkSession, cfg: JourneyConfig) -> DataFrame:
    """The configured Sundays and Saturdays as a calendar (no weekdays)."""
    rows = [(d, "sunday") for d in cfg.sundays] + [(d, "saturday") for d in cfg.saturdays]
    return spark.createDataFrame(rows, "day int, day_class string")


def _keys(days: DataFrame) -> DataFrame:
    """One row per day; of several classes the smallest."""
    keys = days.where(F.col("day").isNotNull()).groupBy("day").agg(F.min("day_class").alias("day_class"))
    return F.broadcast(keys) if keys.count() <= BROADCAST_DAYS else keys


def on_days(df: DataFrame, days: DataFrame, date_col: str = "TAG1_DT_FK", exclude: bool = False) -> DataFrame:
    """rows on a day of the calendar; with ``exclude`` F7, rows on another day."""
    dated = df.where(F.col(date_col).isNotNull()) if exclude else df
    keys = _keys(days).select(F.col("day").alias("__day"))
    return dated.join(keys, F.col(date_col) == F.col("__day"), "left_anti" if exclude else "left_semi")


def with_day_class(df: DataFrame, days: DataFrame, date_col: str = "TAG1_DT_FK", other: str | None = "weekday",
                   out_col: str = "day_class") -> DataFrame:
    """Add the class of each row's day; a day that the calendar does not hold
    is ``other`` (-1 included, as with lists), a null date is in no class."""
    keys = _keys(days).select(F.col("day").alias("__day"), F.col("day_class").alias("__class"))
    found = F.when(F.col(date_col).isNotNull(), F.coalesce("__class", F.lit(other)))
    return df.join(keys, F.col(date_col) == F.col("__day"), "left").withColumn(out_col, found).drop("__day", "__class")
