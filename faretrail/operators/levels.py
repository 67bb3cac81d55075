"""V1 for columns of many levels: the level table.

``survey.encode_many`` puts a column's codes into the plan as a map, which suits
tens of labels. Here the distinct codes stay a table: their ranks come from
running totals (by ranges where a column has very many), their labels from a
join, and the codes of a column are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import GROUP_ROWS, running_total
from .survey import column_codes

#: Levels that are sent to every executor when rows are encoded.
BROADCAST_LEVELS = 1_000_000


def level_table(df: DataFrame, cols: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame:
    """(col, code, level): the distinct non-null codes of integer columns, one
    scan, with their 1-based rank within the column."""
    codes = column_codes(df, cols).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_total(codes, ["col"], ["code"], "__one", "level", limit)
    return ranked.select("col", "code", (F.col("level") + 1).alias("level"))


def labelled_levels(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """(col, code, level, label) by joining labels (col, level, label).

    Every column must have exactly as many codes as labels: a column where
    they differ raises with its name and both counts when the result is read.
    """
    found = levels.groupBy("col").agg(F.count(F.lit(1)).alias("__codes"))
    given = labels.groupBy(F.col("col").alias("__col")).agg(F.count(F.lit(1)).alias("__labels"))
    sizes = found.join(given, F.col("col") == F.col("__col"), "full").select(
        F.coalesce("col", "__col").alias("col"), F.coalesce("__codes", F.lit(0)).alias("__codes"),
        F.coalesce("__labels", F.lit(0)).alias("__labels"))  # one row per column
    wrong = F.raise_error(F.concat(F.col("col"), F.lit(": "), F.col("__codes"), F.lit(" distinct codes for "), F.col("__labels"),
                                   F.lit(" labels"))).cast("string")
    label = F.when(F.col("__codes") == F.col("__labels"), F.col("label")).otherwise(wrong)
    return levels.join(labels, ["col", "level"], "full").join(F.broadcast(sizes), "col").select(
        "col", "code", "level", label.alias("label"))


def encode_by_table(df: DataFrame, table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace the codes of ``cols`` by the labels of the table (null and
    unlisted codes become null). The table is counted once: small, it is
    broadcast; beyond ``BROADCAST_LEVELS`` rows meet it by shuffle, where AQE
    splits a hot code."""
    small = table.count() <= BROADCAST_LEVELS
    out = df
    for c in cols:
        own = table.where(F.col("col") == c).select(F.col("code").alias("__code"), F.col("label").alias("__label"))
        own = F.broadcast(own) if small else own
        out = out.join(own, F.col(c).cast("long") == F.col("__code"), "left").withColumn(c, F.col("__label")).drop("__code", "__label")
    return out.select(*df.columns)
