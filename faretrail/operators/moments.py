"""A12 for wide blocks: sums of products in long form.

One aggregate expression per column pair suits a block of a few ratings; 300
columns have 44,850 pairs, which no generated aggregate holds. Here each task
multiplies its rows block by block (numpy, exact whole numbers) and returns one
row per pair, (i, j, n, si, sj, sij, rows); the pairs are then added in
DECIMAL(38,0). What is shuffled depends on tasks and columns, not on rows. The
rows are read once: every pair brings the number of all rows with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import compiled_projections, materialize
from .survey import EXACT, _integral

_SUMS = ("n", "si", "sj", "sij", "rows")
_SCHEMA = "i int, j int, " + ", ".join(f"{c} long" for c in _SUMS)
_ROOM = 1 << 62


def _product(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """x^T y over whole numbers with entries of x times entries of y at most
    ``most``: in doubles where every sum is exact there, else in integers."""
    if len(x) * most < 1 << 53:
        return (x.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return x.T @ y


def _pair_sums(k: int):
    upper = np.triu_indices(k)

    def rows(n, s, p, seen) -> pa.RecordBatch:
        i, j = upper
        return pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j]), pa.array(s[i, j]), pa.array(s[j, i]), pa.array(p[i, j]),
             pa.array(np.full(len(i), seen, np.int64))],
            names=["i", "j", *_SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros((k, k), np.int64)
        n, s, p, seen, bound = zero(), zero(), zero(), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                known = np.column_stack([np.asarray(c.is_valid()) for c in part.columns]).astype(np.int64)
                x = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in part.columns]).astype(np.int64)
                most = max(abs(int(x.min(initial=0))), int(x.max(initial=0)), 1)
                grown = len(x) * most * most
                if grown >= _ROOM:
                    raise OverflowError("products of these columns do not fit 64 bits")
                if bound + grown >= _ROOM:
                    yield rows(n, s, p, seen)
                    n, s, p, seen, bound = zero(), zero(), zero(), 0, 0
                n += _product(known, known, 1)
                s += _product(x, known, most)
                p += _product(x, x, most * most)
                seen += len(x)
                bound += grown
        yield rows(n, s, p, seen)

    return run


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, si, sj, sij, rows) of every column pair i <= j (places in
    ``cols``), over the rows where both are present, and the number of all
    rows; sums are DECIMAL(38,0). The sums are written out here, by one job."""
    if not _integral(df, cols):
        raise TypeError("pair_sums takes integer columns")
    longs = df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = longs.mapInArrow(_pair_sums(len(cols)), _SCHEMA)
    with compiled_projections(df.sparkSession):
        return materialize(parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast(EXACT)).cast(EXACT).alias(c) for c in _SUMS]), "pair_sums")


def wide_covariance(df: DataFrame, cols: Sequence[str], use: str = "everything") -> DataFrame:
    """A12 of a wide block: (col1, col2, covariance) of every pair i < j, in
    one job, equal to ``survey.pairwise_covariance``. ``use`` is
    ``everything`` (a null in either column makes the pair null) or
    ``pairwise``."""
    if use not in ("everything", "pairwise"):
        raise ValueError(f"unknown use {use!r}")
    names = F.array(*[F.lit(c) for c in cols])
    n, top = F.col("n"), F.col("n") * F.col("sij") - F.col("si") * F.col("sj")
    value = F.when(n > 1, F.try_divide(top.cast("double"), (n * (n - 1)).cast("double")))
    if use == "everything":
        value = F.when(n == F.col("rows"), value)
    return pair_sums(df, cols).where(F.col("i") < F.col("j")).select(
        names[F.col("i")].alias("col1"), names[F.col("j")].alias("col2"), value.alias("covariance")
    )
