"""The previous row and running totals within a group, for groups of any size.

A window function sorts each group in one task. That is right for groups of
a bounded size and wrong for a sentinel key that holds a third of all rows. So
groups are counted first (two columns, combined before the shuffle):

* groups of at most ``limit`` rows take a plain window, one shuffle of the rows;
* larger groups are dealt by ranges of (group, order), whatever the group. Each
  range is scanned by itself and gets what the ranges before it hand on: the
  last row, or the total of the group it goes on with. Only one row per range
  (and group) is scanned in order.

There are fewer than rows / ``limit`` larger groups, so their keys are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize_at

#: Rows of a group that one task sorts.
GROUP_ROWS = 1_000_000
_SALT, _RANGE, _LAST, _FILE, _ROW, _KEY = "__salt", "__range", "__last", "__file", "__row", "__key"


def _nameless(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in by])


def _ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def large_groups(df: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """The groups (no null in ``by``) with more than ``limit`` rows."""
    sizes = df.where(~_nameless(by)).groupBy(*by).agg(F.count(F.lit(1)).alias(_ROW))
    return sizes.where(F.col(_ROW) > limit).select(*by)


def previous_row(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str],
                 out_col: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Add ``out_col``: the ``carry`` values (a struct) of the previous row with
    the same ``by`` values in ``order`` (ascending, nulls first), else null.

    A row with a null in ``by`` has no group and no previous row. Rows equal in
    ``order`` may be taken in any order, so ``order`` should hold ``carry``
    where the result must not depend on it.
    """
    large = large_groups(df, by, limit)
    if large.isEmpty():
        return _by_group(df, by, order, carry, out_col)
    keys = F.broadcast(materialize_at(large, "large-groups")[0])
    few = _by_group(df.join(keys, list(by), "left_anti"), by, order, carry, out_col)
    many = by_ranges(df.join(keys, list(by), "left_semi"), by, order, carry, out_col)
    return few.unionByName(many)


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out_col: str,
                  limit: int = GROUP_ROWS, ranges: int | None = None) -> DataFrame:
    """Add ``out_col``: the sum of ``value`` over the rows of the same ``by``
    values that come before in ``order`` (0 for the first). ``order`` must tell
    the rows of a group apart; a null in ``by`` is a value like any other.
    """
    before = Window.partitionBy(*by).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn(out_col, F.coalesce(F.sum(value).over(before), F.lit(0)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(_ROW)) if by else df.agg(F.count(F.lit(1)).alias(_ROW))
    if sizes.where(F.col(_ROW) > limit).isEmpty():
        return plain
    cuts = [F.col(c) for c in (*by, *order)]
    dealt = df.repartitionByRange(ranges, *cuts) if ranges else df.repartitionByRange(*cuts)
    dealt, _ = materialize_at(dealt.withColumn(_RANGE, F.spark_partition_id()), "ordered-ranges")
    # a group that goes on over many ranges is one row in each
    totals = dealt.groupBy(*by, _RANGE).agg(F.sum(value).alias(_LAST))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(*by, _RANGE, F.coalesce(F.sum(_LAST).over(earlier), F.lit(0)).alias(_LAST))
    in_range = Window.partitionBy(*by, _RANGE).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, -1)
    h = handed.alias("h")
    cond = [F.col(f"d.{_RANGE}") == F.col(f"h.{_RANGE}"), *[F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]]
    inside = dealt.withColumn(out_col, F.coalesce(F.sum(value).over(in_range), F.lit(0))).alias("d")
    return inside.join(h, cond).select(*[F.col(f"d.{c}") for c in df.columns],
                                       (F.col(f"d.{out_col}") + F.col(f"h.{_LAST}")).alias(out_col))


def _by_group(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str], out_col: str) -> DataFrame:
    # rows without a group are spread by their order columns: they need no window
    salted = df.withColumn(_SALT, F.when(_nameless(by), F.xxhash64(*order)))
    w = Window.partitionBy(*by, _SALT).orderBy(*_ascending(order))
    prev = F.when(~_nameless(by), F.lag(F.struct(*carry)).over(w))
    return salted.withColumn(out_col, prev).drop(_SALT)


def by_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str], out_col: str,
              ranges: int | None = None) -> DataFrame:
    """``previous_row`` with no group in a task: a segmented prefix scan.

    The rows are written twice: as they come (their place tells equal rows
    apart, so these spread as well) and dealt by ranges. A lost executor
    recomputes from these files.
    """
    kept, _ = materialize_at(df, "ordered-rows")
    place = [F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)]
    full = [*by, *order, _FILE, _ROW]
    cuts = [F.col(c) for c in full]
    placed = kept.select(*kept.columns, *place)
    dealt = placed.repartitionByRange(ranges, *cuts) if ranges else placed.repartitionByRange(*cuts)
    dealt, _ = materialize_at(dealt.withColumn(_RANGE, F.spark_partition_id()), "ordered-ranges")
    row = F.struct(F.struct(*by).alias(_KEY), *[F.col(c) for c in carry])
    in_range = Window.partitionBy(_RANGE).orderBy(*_ascending(full))
    last = dealt.groupBy(_RANGE).agg(F.max_by(row, F.struct(*full)).alias(_LAST))
    handed = last.select(_RANGE, F.lag(_LAST).over(Window.orderBy(_RANGE)).alias(_LAST))  # one row per range
    above = F.coalesce(F.lag(row).over(in_range), F.col(_LAST))
    out = dealt.join(F.broadcast(handed), _RANGE).withColumn(_LAST, above)
    same = F.col(f"{_LAST}.{_KEY}") == F.struct(*by)
    return out.select(*df.columns, F.when(same & ~_nameless(by), F.struct(*[F.col(f"{_LAST}.{c}").alias(c) for c in carry])).alias(out_col))
