"""Grouped counts and averages.

All are hash aggregates with partial (map-side) aggregation: a hot key is
combined inside every map task before the shuffle, so it never becomes one
big group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import count_where


def segmented_count(df: DataFrame, keys: Sequence[str], where: Column | None = None,
                    count_col: str = "count") -> DataFrame:
    """A1: rows per key combination, optionally filtered."""
    src = df if where is None else df.filter(where)
    out = src.groupBy(*keys).count()
    return out if count_col == "count" else out.withColumnRenamed("count", count_col)


def fused_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column | None],
                 where: Column | None = None) -> DataFrame:
    """A2/A3 fused: one aggregate, one count column per condition.

    ``conditions`` maps an output column to a predicate (``None`` = all rows).
    Each single report is then ``select(keys, col).filter(col > 0)``: a plain
    filtered ``groupBy().count()`` never shows empty groups either.
    """
    src = df if where is None else df.filter(where)
    aggs = [
        (F.count(F.lit(1)) if cond is None else count_where(cond)).alias(name)
        for name, cond in conditions.items()
    ]
    return src.groupBy(*keys).agg(*aggs)


SET_COL = "key_set"


def grouping_sets(df: DataFrame, sets: Mapping[str, Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """A1-A5 for several key sets in one scan: one ``Expand`` and one aggregate.

    Returns a row per set and key combination: ``key_set`` (its name), every
    key column (null where the set does not have it) and the measures. The
    grouping id tells the sets apart, so a null key stays a group of its own.
    ``set_rows`` picks a set.
    """
    cols = list(dict.fromkeys(k for keys in sets.values() for k in keys))
    ids = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keys): name for name, keys in sets.items()}
    if len(ids) != len(sets):
        raise ValueError("two key sets are the same")
    names = F.create_map(*[x for i, name in ids.items() for x in (F.lit(i).cast("long"), F.lit(name))])
    grouped = df.groupingSets([[F.col(k) for k in keys] for keys in sets.values()], *[F.col(c) for c in cols])
    out = grouped.agg(F.grouping_id().cast("long").alias("__id"), *measures)
    return out.withColumn(SET_COL, names[F.col("__id")]).drop("__id")


def set_rows(grouped: DataFrame, name: str, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rows of one set of ``grouping_sets``: its own keys and the measures."""
    others = {k for keys in sets.values() for k in keys} - set(sets[name])
    return grouped.where(F.col(SET_COL) == name).drop(SET_COL, *others)


def peak_split_count(df: DataFrame, keys: Sequence[str], flag: str = "TAG1_OFF_PEAK_IND") -> DataFrame:
    """A2: total, off-peak and peak counts for one key set, one pass."""
    f = F.col(flag)
    return fused_counts(df, keys, {"total": None, "off_peak": f == F.lit(True), "peak": f == F.lit(False)})


def pick_count(fused: DataFrame, keys: Sequence[str], col: str, count_col: str = "count") -> DataFrame:
    """One report out of a fused aggregate: its keys and its non-zero count."""
    return fused.select(*keys, F.col(col).alias(count_col)).filter(F.col(count_col) > 0)


def rollup_count(fine: DataFrame, keys: Sequence[str], col: str, count_col: str = "count") -> DataFrame:
    """A coarser report from a finer fused aggregate (sum of its counts).

    The fine aggregate is already small (one row per group), so this second
    aggregate costs nothing next to a scan of the rows.
    """
    return (
        fine.groupBy(*keys)
        .agg(F.sum(col).alias(count_col))
        .filter(F.col(count_col) > 0)
    )


def trip_kpis(df: DataFrame, flag: Column, count_name: str) -> DataFrame:
    """A4: trips (count of JRNY_ID), total hours |sum(duration)/3600| and fare cents."""
    src = df.filter(flag)
    return src.agg(
        F.count("JRNY_ID").alias(count_name),
        F.abs(F.sum("JS_DURN_SEC") / F.lit(3600)).alias("TOTAL_TRIP_TM"),
        F.sum("JS_FARE_CENTS_AMT").alias("TOTAL_FARE_PAID"),
    )


def kpi_row(fused: DataFrame, tag: str, count_name: str) -> DataFrame:
    """One A4 row (off-peak or peak) from the sums of both (``JourneySuite.family("kpis")``)."""
    return fused.select(
        F.col(f"{tag}_trips").alias(count_name),
        F.abs(F.col(f"{tag}_dur") / F.lit(3600)).alias("TOTAL_TRIP_TM"),
        F.col(f"{tag}_fare").alias("TOTAL_FARE_PAID"),
    )


AVG_DURATION_COL = "avg(JS_DURN_SEC)"


def average_duration(df: DataFrame, key: str = "TAG1_DT_FK", where: Column | None = None) -> DataFrame:
    """A5: average duration per date; the output column keeps the reference's name."""
    src = df if where is None else df.filter(where)
    return src.groupBy(key).agg(F.avg("JS_DURN_SEC").alias(AVG_DURATION_COL))


def average_from_sums(sums: DataFrame, key: str = "TAG1_DT_FK", where: Column | None = None) -> DataFrame:
    """A5 from a sum and a count per date (sum / count as double, as ``avg`` computes it)."""
    src = sums if where is None else sums.filter(where)
    return src.select(
        key,
        (F.col("dur_sum").cast("double") / F.col("dur_n")).alias(AVG_DURATION_COL),
    )


def rows_per_snapshot(df: DataFrame, date_col: str = "snapshot_date", count_col: str = "cardCount",
                      expected: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows per snapshot (and per ``by`` columns, e.g. the file: two
    files of one date are two entries, as the reference counts per file).
    ``expected`` (columns ``by`` + ``date_col``) keeps snapshots with no
    rows as 0; a counted snapshot that is not expected raises."""
    keys = [*by, date_col]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    if expected is None:
        return counts
    listed = expected.withColumn("__listed", F.lit(True))
    cond = [listed[k].eqNullSafe(counts[k]) for k in keys]
    stray = F.raise_error(F.concat_ws(" ", F.lit("rows of a snapshot that is not listed:"),
                                      *[counts[k].cast("string") for k in keys])).cast("long")
    return listed.join(counts, cond, "full").select(
        *[listed[k] for k in keys],
        F.when(F.col("__listed"), F.coalesce(counts[count_col], F.lit(0))).otherwise(stray).alias(count_col),
    )


def card_type_counts(df: DataFrame, date_col: str = "snapshot_date", type_col: str = "CARD_TYP_CD",
                     by: Sequence[str] = ()) -> DataFrame:
    """Rows per (snapshot, card type) in one aggregate over all snapshots
    (and per ``by`` columns, e.g. the file)."""
    return df.groupBy(*by, date_col, type_col).agg(F.count(F.lit(1)).alias("typeCount"))
