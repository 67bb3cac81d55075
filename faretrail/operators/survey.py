"""Survey statistics: level labels, commuter split, frequency and cross-tab
counts, covariance, reliability, reshaping and box-plot summaries.

Every statistic is one aggregate over the rows (partial aggregation first), so
a hot category is combined map-side and never gathered in one task. Moments
of integer ratings are exact (DECIMAL(38,0) sums, one final division), which
makes results identical across engines and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordered import GROUP_ROWS, running_total

EXACT = "decimal(38,0)"


# ---------------------------------------------------------------------------
# V1, V2: categorical levels
# ---------------------------------------------------------------------------


def column_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col, code): the distinct non-null codes of integer columns, one scan."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("long").alias("code")) for c in cols
    ]))).where(F.col("code").isNotNull()).distinct()


def maps_from_codes(codes: DataFrame, labels_by_col: Mapping[str, Sequence[str]]) -> dict[str, dict]:
    """V1: code -> label of each column from its distinct codes (col, code),
    the i-th smallest code taking the i-th label.

    The codes of each column are counted first (a row per column reaches the
    driver); a column with another number of codes than labels raises with
    its own name and count. Only then are the codes read: as many as labels.
    """
    wanted = codes.where(F.col("col").isin(list(labels_by_col)))
    found = {r["col"]: r["n"] for r in wanted.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    wrong = [f"{c}: {found.get(c, 0)} distinct codes for {len(labels)} labels"
             for c, labels in labels_by_col.items() if found.get(c, 0) != len(labels)]
    if wrong:
        raise ValueError("; ".join(wrong))
    by_col: dict[str, list] = {c: [] for c in labels_by_col}
    for r in wanted.collect():
        by_col[r["col"]].append(r["code"])
    return {c: dict(zip(sorted(by_col[c]), labels)) for c, labels in labels_by_col.items()}


def level_codes(df: DataFrame, col: str, n_labels: int) -> list:
    """Sorted distinct non-null codes of ``col``; raise unless there are
    exactly ``n_labels``. They are counted before any reaches the driver."""
    kinds = df.select(F.col(col).alias("c")).where(F.col("c").isNotNull()).distinct()
    n = kinds.count()
    if n != n_labels:
        raise ValueError(f"{col}: {n} distinct codes for {n_labels} labels")
    return sorted(r.c for r in kinds.collect())


def level_maps(df: DataFrame, labels_by_col: Mapping[str, Sequence[str]]) -> dict[str, dict]:
    """V1 for several columns: integer columns from one scan
    (``maps_from_codes``), any other column in its own type by ``level_map``.
    Each column must have exactly as many codes as labels."""
    cols = [c for c in labels_by_col if _integral(df, [c])]
    out = {c: level_map(df, c, labels) for c, labels in labels_by_col.items() if c not in cols}
    return out | (maps_from_codes(column_codes(df, cols), {c: labels_by_col[c] for c in cols}) if cols else {})


def code_label(col: str | Column, labels: Mapping) -> Column:
    """The label of a code, null for a null or unlisted code."""
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(lookup, F.col(col) if isinstance(col, str) else col)


def encode_maps(df: DataFrame, maps: Mapping[str, Mapping]) -> DataFrame:
    """V1 on several columns from code-to-label maps (literal lookups, no join)."""
    integral = {c: _integral(df, [c]) for c in maps}
    return df.withColumns({
        c: code_label(F.col(c).cast("long") if integral[c] else F.col(c),
                      m)
        for c, m in maps.items()
    })


def encode_many(df: DataFrame, labels_by_col: Mapping[str, Sequence[str]]) -> DataFrame:
    """V1 on several columns (their codes are read once, then map lookups)."""
    return encode_maps(df, level_maps(df, labels_by_col))


def level_map(df: DataFrame, col: str, labels: Sequence[str], codes: Sequence | None = None) -> dict:
    """V1: code -> label, the i-th smallest distinct code taking the i-th label.

    ``codes`` declares the codes instead of reading them (no job runs).
    """
    codes = list(codes) if codes is not None else level_codes(df, col, len(labels))
    if len(codes) != len(labels):
        raise ValueError(f"{col}: {len(codes)} codes for {len(labels)} labels")
    return dict(zip(codes, labels))


def encode_levels(df: DataFrame, col: str, labels: Sequence[str], codes: Sequence | None = None,
                  out_col: str | None = None) -> DataFrame:
    """V1: replace integer codes by their labels (a literal map lookup,
    no join). Null stays null."""
    mapping = level_map(df, col, labels, codes)
    return df.withColumn(out_col or col, code_label(col, mapping))


def level_label(labels: Sequence[str], level: int) -> str:
    """V2: the label of a 1-based level."""
    return labels[level - 1]


# ---------------------------------------------------------------------------
# commuters
# ---------------------------------------------------------------------------


def split_commuters(df: DataFrame, col: str = "Q4", labels: Sequence[str] = K.FREQUENCY_LABELS,
                    level: int = K.NON_COMMUTER_LEVEL) -> tuple[DataFrame, DataFrame]:
    """(commuters, non-commuters) by the label of a frequency column.

    ``col`` must already carry labels (``encode_levels``). A null answer is
    in neither set.
    """
    never = F.lit(level_label(labels, level))
    return df.filter(F.col(col) != never), df.filter(F.col(col) == never)


# ---------------------------------------------------------------------------
# Counts and percentages
# ---------------------------------------------------------------------------


#: One question (its counts) or a pair of questions (their cross-tab).
Cell = tuple[str, ...]


def cell_name(cell: Cell) -> str:
    return " x ".join(cell)


def contingency(df: DataFrame, cells: Sequence[Cell], by: str) -> DataFrame:
    """A10/A11 in one scan: rows per (cell, row code, column code) and code of
    the splitting question ``by``.

    Each answer row becomes one small row per cell; these are counted map-side
    before the shuffle, so what is shuffled are the distinct cells of a task.
    A single question has a null column code. Null codes are counted as such.
    Frequency tables, cross-tabs, histograms and level codes are picked from
    the result with ``cell_rows``.
    """
    code = lambda c: F.col(c).cast("long")
    exploded = df.select(
        code(by).alias("by_code"),
        F.inline(F.array(*[
            F.struct(F.lit(cell_name(c)).alias("cell"), code(c[0]).alias("row_code"),
                     (code(c[1]) if len(c) > 1 else F.lit(None).cast("long")).alias("col_code"))
            for c in cells
        ])),
    )
    return exploded.groupBy("cell", "row_code", "col_code", "by_code").agg(F.count(F.lit(1)).alias("n"))


def cell_rows(counts: DataFrame, cells: Mapping[Cell, str], by_codes: Sequence | None = None) -> DataFrame:
    """Some cells of ``contingency`` under names: (name, row_code, col_code,
    n), optionally over the rows whose splitting question has one of
    ``by_codes``."""
    names = F.create_map(*[F.lit(x) for c, name in cells.items() for x in (cell_name(c), name)])
    rows = counts.where(F.col("cell").isin([cell_name(c) for c in cells]))
    if by_codes is not None:
        rows = rows.where(F.col("by_code").isin(list(by_codes)))
    return rows.groupBy(names[F.col("cell")].alias("name"), "row_code", "col_code").agg(F.sum("n").alias("n"))


def crosstab_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """A10: respondents per (row level, column level), long form."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))


def crosstab_wide(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """A10, wide form: one count column per declared column level."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1))).na.fill(0, subset=list(levels))


def code_counts(df: DataFrame, col: str) -> DataFrame:
    """(code, n) of a column's non-null codes."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def frequency_table(df: DataFrame, col: str, labels: Mapping, digits: int = 2) -> DataFrame:
    """Count and percentage per level: ``round(100 * n / sum(n), digits)``.

    ``labels`` maps each code to its label, in level order; a level without
    rows counts 0 and any other code raises. Nulls are not counted.
    """
    return frequency_from(code_counts(df, col), col, labels, digits)


def frequency_from(counts: DataFrame, col: str, labels: Mapping, digits: int = 2) -> DataFrame:
    """``frequency_table`` from the (code, n) rows of a column."""
    levels = counts.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("level"), F.lit(label).alias("label"),
                 F.lit(code).cast(counts.schema["code"].dataType).alias("known"))
        for i, (code, label) in enumerate(labels.items(), 1)
    ])))
    stray = F.raise_error(F.concat(F.lit(f"{col}: no label for code "), F.col("code").cast("string"))).cast("bigint")
    n = F.when(F.col("known").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(stray)
    # one row per level: the global window over them is tiny
    return levels.join(counts, F.col("known") == F.col("code"), "full").select(
        "level", "label", "code", n.alias("n")).withColumn("pct", _percent(digits))


def frequency_of_first(df: DataFrame, col: str, labels: Sequence[str], digits: int = 2) -> DataFrame:
    """A11 as the transport-mode chart takes it: the smallest codes only, as
    many as there are labels, whose counts alone form the denominator."""
    return frequency_of_first_from(code_counts(df, col), labels, digits)


def frequency_of_first_from(counts: DataFrame, labels: Sequence[str], digits: int = 2) -> DataFrame:
    """``frequency_of_first`` from the (code, n) rows of a column."""
    first = counts.orderBy("code").limit(len(labels))
    level = F.row_number().over(Window.orderBy("code"))  # over as many rows as labels
    return first.select(level.cast("bigint").alias("level"), "code", "n").select(
        "level", F.try_element_at(F.array(*[F.lit(x) for x in labels]), F.col("level").cast("int")).alias("label"),
        "code", "n").withColumn("pct", _percent(digits))


def _percent(digits: int) -> Column:
    return F.round(F.lit(100) * F.col("n") / F.sum("n").over(Window.partitionBy()), digits)


# ---------------------------------------------------------------------------
# Covariance and reliability (exact integer moments)
# ---------------------------------------------------------------------------


def _integral(df: DataFrame, cols: Sequence[str]) -> bool:
    types = dict(df.dtypes)
    return all(types[c] in ("tinyint", "smallint", "int", "bigint") for c in cols)


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pairwise_covariance(df: DataFrame, cols: Sequence[str], use: str = "everything") -> DataFrame:
    """Sample covariance of every column pair (i < j), long form
    ``(col1, col2, covariance)``, from one aggregate.

    cov = (n*Sxy - Sx*Sy) / (n*(n-1)) over exact sums, one final division:
    per-row products and sums stay BIGINT (exact; ANSI mode raises on
    overflow), only the final combination uses DECIMAL(38,0). ``use``
    follows R's ``cov``: ``everything`` (default: a null in either column
    makes that pair null), ``complete`` (drop rows with a null in the block
    first) or ``pairwise`` (each pair over the rows where both are present).
    Non-integer columns use ``covar_samp``.
    """
    src = df.select(*cols)
    if use == "complete":
        src = src.dropna()
    elif use not in ("everything", "pairwise"):
        raise ValueError(f"unknown use {use!r}")
    pairs = list(combinations(cols, 2))
    integral = _integral(src, cols)
    aggs = ["count(1) AS n"]
    rows = []
    for i, (a, b) in enumerate(pairs):
        qa, qb = _q(a), _q(b)
        if not integral:
            aggs += [f"covar_samp({qa}, {qb}) AS c{i}", f"count({qa}) AS na{i}", f"count({qb}) AS nb{i}"]
            value = f"CASE WHEN na{i} = n AND nb{i} = n THEN c{i} END"
        else:
            if use == "pairwise":
                both = f"{qa} IS NOT NULL AND {qb} IS NOT NULL"
                aggs += [f"count(CASE WHEN {both} THEN 1 END) AS n{i}",
                         f"sum(CASE WHEN {both} THEN CAST({qa} AS BIGINT) END) AS sa{i}",
                         f"sum(CASE WHEN {both} THEN CAST({qb} AS BIGINT) END) AS sb{i}"]
                n, ok = f"CAST(n{i} AS {EXACT})", f"n{i} > 1"
            else:
                aggs += [f"count({qa}) AS na{i}", f"count({qb}) AS nb{i}",
                         f"sum(CAST({qa} AS BIGINT)) AS sa{i}", f"sum(CAST({qb} AS BIGINT)) AS sb{i}"]
                n, ok = f"CAST(n AS {EXACT})", f"na{i} = n AND nb{i} = n AND n > 1"
            aggs.append(f"sum(CAST({qa} AS BIGINT) * CAST({qb} AS BIGINT)) AS p{i}")
            num = f"{n} * CAST(p{i} AS {EXACT}) - CAST(sa{i} AS {EXACT}) * CAST(sb{i} AS {EXACT})"
            value = (f"CASE WHEN {ok} THEN try_divide(CAST({num} AS DOUBLE), "
                     f"CAST({n} * ({n} - 1) AS DOUBLE)) END")
        rows.append(f"named_struct('col1', {_lit(a)}, 'col2', {_lit(b)}, 'covariance', {value})")
    m = src.agg(*[F.expr(a) for a in aggs])
    return m.selectExpr(f"inline(array({', '.join(rows)}))")


def cronbach_alpha(df: DataFrame, cols: Sequence[str], name: str | None = None) -> DataFrame:
    """Cronbach's alpha over complete rows, one aggregate.

    alpha = k/(k-1) * (1 - sum(var(item)) / var(total)); with exact sums this
    is k*(D - N) / ((k-1)*D), N = sum(n*Sxx - Sx^2) over items and
    D = n*STT - ST^2 for the row total T. Null when D = 0. Sums are BIGINT,
    the final combination DECIMAL(38,0), one division.
    """
    k = len(cols)
    src = df.select(*cols).dropna()
    if not _integral(src, cols):
        raise TypeError("cronbach_alpha takes integer item columns")
    longs = [f"CAST({_q(c)} AS BIGINT)" for c in cols]
    total = " + ".join(longs)
    aggs = ["count(1) AS n", f"sum({total}) AS st", f"sum(({total}) * ({total})) AS stt"]
    for i, x in enumerate(longs):
        aggs += [f"sum({x}) AS s{i}", f"sum({x} * {x}) AS ss{i}"]
    m = src.agg(*[F.expr(a) for a in aggs])
    n = f"CAST(n AS {EXACT})"
    num = " + ".join(
        f"({n} * CAST(ss{i} AS {EXACT}) - CAST(s{i} AS {EXACT}) * CAST(s{i} AS {EXACT}))" for i in range(k)
    )
    den = f"({n} * CAST(stt AS {EXACT}) - CAST(st AS {EXACT}) * CAST(st AS {EXACT}))"
    alpha = f"try_divide(CAST({k} * ({den} - ({num})) AS DOUBLE), CAST({k - 1} * {den} AS DOUBLE))"
    return m.selectExpr(
        f"{_lit(name or '+'.join(cols))} AS block",
        f"{k} AS items",
        "n",
        f"CASE WHEN {den} <> 0 THEN {alpha} END AS alpha",
    )


# ---------------------------------------------------------------------------
# reshaping
# ---------------------------------------------------------------------------


def melt(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
         var_name: str = "Aspects", value_name: str = "Ratings") -> DataFrame:
    """Wide -> long, one row per (row, value column)."""
    return df.unpivot(list(id_cols), list(value_cols), var_name, value_name)


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """U4: rename values of a column through a literal map (others stay)."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.try_element_at(lookup, F.col(col)), F.col(col)))


# ---------------------------------------------------------------------------
# Box-plot statistics
# ---------------------------------------------------------------------------


def histogram(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """(group, value, weight): rows per group and distinct non-null value."""
    return (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, F.col(value_col).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def quantiles(hist: DataFrame, group_cols: Sequence[str], probabilities: Mapping[str, float],
              limit: int = GROUP_ROWS) -> DataFrame:
    """Exact quantiles per group (linear interpolation, R's type 7) of a
    ``histogram``, with the number of rows ``n``; a column per probability.

    Rank selection: a value covers the ranks behind the running total of the
    weights before it, and a quantile lies between two ranks. Nothing holds a
    group's values: the totals come from a window over groups of at most
    ``limit`` distinct values and from ranges beyond it (``running_total``),
    the picks from one aggregate combined before the shuffle.
    """
    g = list(group_cols)
    if not g:
        return quantiles(hist.withColumn("__all", F.lit(0)), ["__all"], probabilities, limit).drop("__all")
    placed = running_total(hist, g, ["value"], "weight", "__before", limit)
    totals = hist.groupBy(*g).agg(F.sum("weight").alias("n"))
    p, t = placed.alias("p"), totals.alias("t")
    rows = p.join(t, [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in g])
    aggs, out = [], []
    for name, q in probabilities.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        low = F.floor(at)

        def pick(rank):
            return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("weight")), F.col("value")))

        aggs += [pick(low).alias(f"__lo_{name}"), pick(F.least(low + 1, F.col("n") - 1)).alias(f"__hi_{name}")]
        part = at - low
        out.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * part).alias(name))
    keyed = rows.select(*[F.col(f"p.{c}").alias(c) for c in g], "value", "weight", "__before", "n")
    return keyed.groupBy(*g, "n").agg(*aggs).select(*g, "n", *out)


QUARTILES = {"lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75}


def fenced(hist: DataFrame, group_cols: Sequence[str], whisker: float, limit: int = GROUP_ROWS) -> DataFrame:
    """A histogram with its group's quartiles and whether each value is within
    ``whisker`` IQRs of them."""
    g = list(group_cols)
    if not g:
        return fenced(hist.withColumn("__all", F.lit(0)), ["__all"], whisker, limit).drop("__all")
    h, s = hist.alias("h"), quantiles(hist, g, QUARTILES, limit).alias("s")
    cond = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in g]
    lq, uq, v = F.col("lower_quartile"), F.col("upper_quartile"), F.col("value")
    reach = F.lit(whisker) * (uq - lq)
    return h.join(s, cond, "inner").select(
        *[F.col(f"s.{c}").alias(c) for c in g], "n", "lower_quartile", "median", "upper_quartile", "value", "weight",
        ((v >= lq - reach) & (v <= uq + reach)).alias("__inside"))


def box_stats(df: DataFrame, group_cols: Sequence[str], value_col: str,
              whisker: float = K.WHISKER_IQR) -> DataFrame:
    """Per group n, quartiles (linear interpolation, R's type 7),
    whisker ends (the range of the quartiles and the values within
    ``whisker`` IQRs of them) and the number of outliers beyond them.
    Nulls are ignored. The rows are read once, into a histogram."""
    return box_stats_from(fenced(histogram(df, group_cols, value_col), group_cols, whisker), group_cols)


def box_stats_from(points: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``box_stats`` from the rows of ``fenced``."""
    g, inside = list(group_cols), F.col("__inside")
    return points.groupBy(*g, "n", "lower_quartile", "median", "upper_quartile").agg(
        F.least("lower_quartile", F.min(F.when(inside, F.col("value")))).alias("lower_whisker"),
        F.greatest("upper_quartile", F.max(F.when(inside, F.col("value")))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("weight"))), F.lit(0)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 whisker: float = K.WHISKER_IQR) -> DataFrame:
    """A8, the points a box plot draws on their own: per group each value
    beyond the fences and its number of rows."""
    return box_outliers_from(fenced(histogram(df, group_cols, value_col), group_cols, whisker), group_cols)


def box_outliers_from(points: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``box_outliers`` from the rows of ``fenced``."""
    return points.where(~F.col("__inside")).select(*group_cols, "value", F.col("weight").alias("count"))
