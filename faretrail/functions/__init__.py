"""Scalar Column helpers built only from ``pyspark.sql.functions``.

Everything here stays JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_epoch_seconds(date_col: str | Column, time_col: str | Column,
                      fmt: str = K.TAG_STAMP_FORMAT) -> Column:
    """Seconds since the epoch of ``<yyyyMMdd> <HH:mm:ss>``; null if unparsable.

    The date is an integer column and the time a text column, joined with a
    space as the reference does. ``try_to_timestamp`` gives null instead of
    an error for sentinels such as ``-1`` or ``UNKNOWN``; the session time
    zone applies (UTC in ``get_session``).
    """
    stamp = F.concat_ws(" ", _col(date_col).cast("string"), _col(time_col))
    return F.unix_seconds(F.try_to_timestamp(stamp, F.lit(fmt)))


def map_values(c: str | Column, mapping: Mapping, keep_others: bool = True) -> Column:
    """Look a value up in a literal map; unmatched values stay (or become null)."""
    if not mapping:
        return _col(c)
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(lookup, _col(c))
    return F.coalesce(found, _col(c)) if keep_others else found


def _in_list_sql(date_col: str, days: Iterable[int]) -> str:
    return f"`{date_col}` IN ({', '.join(str(int(d)) for d in days)})"


def in_days(date_col: str, days: Iterable[int]) -> Column:
    """Integer date is in a listed set (three-valued: null date gives null).

    One SQL ``IN`` expression (Catalyst turns long lists into a hash set).
    """
    days = list(days)
    return F.expr(_in_list_sql(date_col, days)) if days else F.lit(False)


def not_in_days(date_col: str, *day_sets: Iterable[int]) -> Column:
    """Date is in none of the listed sets; null date gives null (in no class)."""
    parts = [f"NOT ({_in_list_sql(date_col, list(d))})" for d in day_sets if list(d)]
    return F.expr(" AND ".join(parts)) if parts else F.col(date_col).isNotNull()


def count_where(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (null counts as false)."""
    return F.count(F.when(cond, F.lit(1)))
