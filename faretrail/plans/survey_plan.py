"""The survey script as Spark plans, plus the DuckDB statement of each result.

R's flow: label Q1-Q4 (V1) -> split commuters (F11) -> covariance and
reliability of the rating blocks on commuters with numeric ratings -> Q5
labels on commuters -> frequency tables on all respondents -> cross-tabs on
commuters -> box plots of every rating by occupation -> melted blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import sinks
from ..config import SurveyConfig
from ..operators import survey as S
from ..session import materialize_at, release
from ..sources import adapters as AD

Query = Callable[[SparkSession, str], DataFrame]

PROFILE_LABELS = {
    "Q1": K.GENDER_LABELS,
    "Q2": K.AGE_LABELS,
    "Q3": K.OCCUPATION_LABELS,
    "Q4": K.FREQUENCY_LABELS,
}
BOXED = K.Q9_COLUMNS + K.Q10_COLUMNS + ("Q12",)
Q9_ASPECT_MAP = dict(zip(K.Q9_COLUMNS, K.Q9_ASPECTS))
Q10_ASPECT_MAP = dict(zip(K.Q10_COLUMNS, K.Q10_ASPECTS))


FREQUENCIES = ("Q1", "Q2", "Q3", "Q4", "Q5")
CROSSTABS = (("Q1", "Q3"), ("Q2", "Q3"), ("Q3", "Q4"), ("Q3", "Q5"))


class SurveyPlan:
    """Lazy survey tables.

    ``materialize_data`` writes the answers once as Parquet in the shared
    folder and counts them in one scan into the cells of ``S.contingency``:
    every frequency table, cross-tab, bar chart, histogram of a rating by
    occupation and every level code (V1) then comes from these few rows.
    Without it each result counts its own cell.
    """

    def __init__(self, raw: DataFrame, cfg: SurveyConfig | None = None, materialize_data: bool = False):
        self.cfg = cfg or SurveyConfig()
        self._written: list[str] = []
        self._cells: DataFrame | None = None
        if materialize_data:
            raw = self._keep(raw, "survey")
            self._cells = self._keep(S.contingency(raw, self.all_cells(), self.cfg.frequency), "survey-cells")
        self.raw = raw
        self.levels = self._levels(PROFILE_LABELS)
        data = S.encode_maps(raw, self.levels)
        self.data = data
        self.commuters1, self.non_commuters = S.split_commuters(
            data, self.cfg.frequency, K.FREQUENCY_LABELS, self.cfg.non_commuter_level
        )
        self.non_commuters = self.non_commuters.select("Q1", "Q2", "Q3", "Q4")
        self._commuter_levels: dict[str, dict] = {}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = materialize_at(df, name)
        self._written.append(path)
        return df

    def close(self) -> None:
        """Delete the written tables (if any)."""
        release(self.raw.sparkSession, self._written)
        self._written = []

    # -- cells ---------------------------------------------------------------
    def all_cells(self) -> list[S.Cell]:
        return [(q,) for q in FREQUENCIES] + list(CROSSTABS) + [(self.cfg.occupation, c) for c in BOXED]

    def commuter_codes(self) -> list:
        """The frequency codes of commuters (a null answer is none)."""
        never = S.level_label(K.FREQUENCY_LABELS, self.cfg.non_commuter_level)
        return [code for code, label in self.levels[self.cfg.frequency].items() if label != never]

    def counts(self, cells: dict[S.Cell, str], commuters: bool = False) -> DataFrame:
        """(name, row_code, col_code, n) of some cells, by their names here."""
        counted = self._cells if self._cells is not None else S.contingency(self.raw, list(cells), self.cfg.frequency)
        return S.cell_rows(counted, cells, self.commuter_codes() if commuters else None)

    def _levels(self, labels: dict, commuters: bool = False) -> dict[str, dict]:
        """V1 of several columns; from the cells where they are written."""
        if self._cells is None:
            return S.level_maps(self.commuters1 if commuters else self.raw, labels)
        if commuters:
            rows, code = self.counts({(self.cfg.occupation, c): c for c in labels}, True), "col_code"
        else:
            rows, code = self.counts({(c,): c for c in labels}), "row_code"
        codes = rows.select(F.col("name").alias("col"), F.col(code).alias("code")).where(F.col("code").isNotNull())
        return S.maps_from_codes(codes.distinct(), labels)

    def _commuter_maps(self, labels: dict) -> dict[str, dict]:
        if not set(labels) <= set(self._commuter_levels):
            self._commuter_levels |= self._levels(labels, commuters=True)
        return {c: self._commuter_levels[c] for c in labels}

    def _label(self, code: str, question: str) -> Column:
        """The label of a code column, as commuters carry it."""
        if question == self.cfg.mode:
            return S.code_label(code, self._commuter_maps({question: K.MODE_LABELS})[question])
        return S.code_label(code, self.levels[question])

    # -- tables --------------------------------------------------------------
    def commuters(self) -> DataFrame:
        """Commuters with transport mode labelled on the commuter subset
        (its level codes are read once per plan)."""
        return S.encode_maps(self.commuters1, self._commuter_maps({self.cfg.mode: K.MODE_LABELS}))

    def commuters_labelled(self) -> DataFrame:
        """Commuters with the mode and all ratings labelled, as the script
        leaves them (the level codes of all columns are read in one job)."""
        return S.encode_maps(self.commuters1, self._commuter_maps({self.cfg.mode: K.MODE_LABELS, **K.RATING_LABELS}))

    def frequency(self, col: str) -> DataFrame:
        counts = self.counts({(col,): col}).where(F.col("row_code").isNotNull()).select(
            F.col("row_code").cast(self.raw.schema[col].dataType).alias("code"), "n")
        if col == self.cfg.mode:
            # all respondents, raw codes, the first four codes form the total
            return S.frequency_of_first_from(counts, K.MODE_LABELS)
        return S.frequency_from(counts, col, self.levels[col])

    def crosstab(self, row: str, col: str) -> DataFrame:
        return self.counts({(row, col): row}, commuters=True).select(
            self._label("row_code", row).alias(row), self._label("col_code", col).alias(col), F.col("n").alias("count"))

    def covariance(self, block: tuple[str, ...]) -> DataFrame:
        return S.pairwise_covariance(self.commuters1, block)

    def reliability(self, block: tuple[str, ...], name: str) -> DataFrame:
        return S.cronbach_alpha(self.commuters1, block, name)

    def bars(self) -> DataFrame:
        occ = self.cfg.occupation
        counts = self.counts({(occ,): occ}, commuters=True)
        return counts.select(self._label("row_code", occ).alias(occ), F.col("n").alias("count"))

    def ratings(self, value_cols: tuple[str, ...] = BOXED) -> DataFrame:
        """The histogram of rating columns by (occupation, rating); ``rating``
        names the source column."""
        occ = self.cfg.occupation
        rows = self.counts({(occ, c): c for c in value_cols}, commuters=True).where(F.col("col_code").isNotNull())
        return rows.select(self._label("row_code", occ).alias(occ), F.col("name").alias("rating"),
                           F.col("col_code").cast("double").alias("value"), F.col("n").alias("weight"))

    def box(self, value_col: str) -> DataFrame:
        occ = self.cfg.occupation
        return S.box_stats_from(S.fenced(self.ratings((value_col,)).drop("rating"), [occ], K.WHISKER_IQR), [occ])

    def fenced(self, value_cols: tuple[str, ...] = BOXED) -> DataFrame:
        """The points of all box plots by occupation; box statistics and
        outliers are both taken from it."""
        points = S.fenced(self.ratings(value_cols), [self.cfg.occupation, "rating"], K.WHISKER_IQR)
        return self._keep(points, "survey-points") if self._cells is not None else points

    def boxes(self, points: DataFrame | None = None) -> DataFrame:
        """A8 for all rating columns at once."""
        return S.box_stats_from(points if points is not None else self.fenced(), [self.cfg.occupation, "rating"])

    def outliers(self, points: DataFrame | None = None) -> DataFrame:
        """The outlying ratings of all box plots by occupation."""
        return S.box_outliers_from(points if points is not None else self.fenced(), [self.cfg.occupation, "rating"])

    def box_from(self, fused: DataFrame, value_col: str) -> DataFrame:
        """One column's box statistics out of ``boxes()``."""
        return fused.filter(F.col("rating") == F.lit(value_col)).drop("rating")

    def box_melted_from(self, fused: DataFrame, block: tuple[str, ...], aspects: dict) -> DataFrame:
        """A melted block's box statistics out of ``boxes()``: the same
        groups (occupation, column), with the aspect names."""
        out = fused.filter(F.col("rating").isin(list(block))).withColumnsRenamed(
            {self.cfg.occupation: "Occupation", "rating": "Aspects"})
        return S.relabel(out, "Aspects", aspects).select(
            "Occupation", "Aspects", "n", "lower_quartile", "median", "upper_quartile",
            "lower_whisker", "upper_whisker", "n_outliers")

    def melted(self, block: tuple[str, ...], aspects: dict) -> DataFrame:
        long = S.melt(self.commuters1.select(self.cfg.occupation, *block), [self.cfg.occupation], block)
        long = long.withColumnRenamed(self.cfg.occupation, "Occupation")
        return S.relabel(long, "Aspects", aspects)

    def box_melted(self, block: tuple[str, ...], aspects: dict) -> DataFrame:
        return S.box_stats(self.melted(block, aspects), ["Occupation", "Aspects"], "Ratings")


def _plan(spark: SparkSession, d: str) -> SurveyPlan:
    return SurveyPlan(AD.survey(spark, d))


def survey_contingency(p: SurveyPlan) -> DataFrame:
    """All five frequency tables and four cross-tabs, from the cells of one
    scan: (result, level, label, other, n, pct)."""
    out = None
    for q in FREQUENCIES:
        part = p.frequency(q).select(F.lit(q).alias("result"), "level", "label", F.lit(None).cast("string").alias("other"), "n", "pct")
        out = part if out is None else out.unionByName(part)
    for a, b in CROSSTABS:
        out = out.unionByName(p.crosstab(a, b).select(
            F.lit(f"{a} x {b}").alias("result"), F.lit(None).cast("bigint").alias("level"), F.col(a).alias("label"), F.col(b).alias("other"),
            F.col("count").alias("n"), F.lit(None).cast("double").alias("pct")))
    return out


PRICE_QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def price_quantiles(spark: SparkSession, d: str, limit: int = 500) -> DataFrame:
    """Exact quantiles of a continuous column: the extended price by return
    flag, a group of which holds about half of all rows. ``limit`` makes the
    larger groups take the ranges already on small tables."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    hist = S.histogram(rows, ["l_returnflag"], "l_extendedprice")
    out = S.quantiles(hist, ["l_returnflag"], PRICE_QUANTILES, limit)
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in PRICE_QUANTILES])  # engines interpolate with other last bits


def survey_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "survey_labelled": lambda s, d: _plan(s, d).data,
        "commuters_labelled": lambda s, d: _plan(s, d).commuters_labelled(),
        "non_commuters": lambda s, d: _plan(s, d).non_commuters,
        "box_outliers": lambda s, d: _plan(s, d).outliers(),
        "freq_gender": lambda s, d: _plan(s, d).frequency("Q1"),
        "freq_age": lambda s, d: _plan(s, d).frequency("Q2"),
        "freq_occupation": lambda s, d: _plan(s, d).frequency("Q3"),
        "freq_frequency": lambda s, d: _plan(s, d).frequency("Q4"),
        "freq_mode": lambda s, d: _plan(s, d).frequency("Q5"),
        "crosstab_gender_occupation": lambda s, d: _plan(s, d).crosstab("Q1", "Q3"),
        "crosstab_age_occupation": lambda s, d: _plan(s, d).crosstab("Q2", "Q3"),
        "crosstab_occupation_frequency": lambda s, d: _plan(s, d).crosstab("Q3", "Q4"),
        "crosstab_occupation_mode": lambda s, d: _plan(s, d).crosstab("Q3", "Q5"),
        "crosstab_wide_occupation_mode": lambda s, d: S.crosstab_wide(
            _plan(s, d).commuters(), "Q3", "Q5", K.MODE_LABELS),
        "indexed_covariance_q9": lambda s, d: sinks.with_row_index(
            _plan(s, d).covariance(K.Q9_COLUMNS), ["col1", "col2"]),
        "covariance_q9": lambda s, d: _plan(s, d).covariance(K.Q9_COLUMNS),
        "covariance_q10": lambda s, d: _plan(s, d).covariance(K.Q10_COLUMNS),
        "cronbach_q9": lambda s, d: _plan(s, d).reliability(K.Q9_COLUMNS, "Q9"),
        "cronbach_q10": lambda s, d: _plan(s, d).reliability(K.Q10_COLUMNS, "Q10"),
        "survey_contingency": lambda s, d: survey_contingency(SurveyPlan(AD.survey(s, d), materialize_data=True)),
        "price_quantiles": lambda s, d: price_quantiles(s, d),
        "bar_occupation": lambda s, d: _plan(s, d).bars(),
        "melt_q9": lambda s, d: _plan(s, d).melted(K.Q9_COLUMNS, Q9_ASPECT_MAP),
        "melt_q10": lambda s, d: _plan(s, d).melted(K.Q10_COLUMNS, Q10_ASPECT_MAP),
        "box_melted_q9": lambda s, d: _plan(s, d).box_melted(K.Q9_COLUMNS, Q9_ASPECT_MAP),
        "box_melted_q10": lambda s, d: _plan(s, d).box_melted(K.Q10_COLUMNS, Q10_ASPECT_MAP),
    }
    for col in BOXED:
        q[f"box_{col.lower()}"] = (lambda c: lambda s, d: _plan(s, d).box(c))(col)
    return q


# ---------------------------------------------------------------------------
# DuckDB statements
# ---------------------------------------------------------------------------

_SURVEY_SQL = """survey AS (SELECT
  CAST(1 + l_suppkey % 2 AS INTEGER) AS Q1, CAST(1 + l_partkey % 6 AS INTEGER) AS Q2,
  CAST(1 + l_partkey % 9 AS INTEGER) AS Q3, CAST(1 + l_orderkey % 5 AS INTEGER) AS Q4,
  CAST(1 + l_suppkey % 4 AS INTEGER) AS Q5,
  CAST(1 + l_quantity % 9 AS INTEGER) AS Q9_A, CAST(1 + round(l_discount * 100) % 8 AS INTEGER) AS Q9_B,
  CAST(1 + round(l_tax * 100) % 9 AS INTEGER) AS Q9_C, CAST(1 + (l_quantity + l_linenumber) % 9 AS INTEGER) AS Q9_D,
  CAST(1 + (l_quantity + round(l_tax * 100)) % 8 AS INTEGER) AS Q9_E,
  CAST(1 + (l_quantity + l_linenumber) % 8 AS INTEGER) AS Q9_F, CAST(1 + l_suppkey % 8 AS INTEGER) AS Q9_G,
  CAST(1 + floor(l_extendedprice) % 9 AS INTEGER) AS Q10_A, CAST(1 + l_quantity % 9 AS INTEGER) AS Q10_B,
  CAST(1 + round(l_discount * 100) % 8 AS INTEGER) AS Q10_C, CAST(1 + round(l_tax * 100) % 9 AS INTEGER) AS Q10_D,
  CAST(1 + (l_linenumber + round(l_discount * 100)) % 8 AS INTEGER) AS Q10_E,
  CAST(1 + (l_quantity + round(l_tax * 100)) % 9 AS INTEGER) AS Q10_F,
  CASE l_quantity WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 49 THEN 4 WHEN 50 THEN 5 ELSE 3 END AS Q12
FROM lineitem)"""


def _list(labels) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in labels) + "]"


def _levels_cte(name: str, src: str, col: str) -> str:
    return (f"{name} AS (SELECT code, row_number() OVER (ORDER BY code) AS i FROM "
            f"(SELECT DISTINCT {col} AS code FROM {src} WHERE {col} IS NOT NULL) t)")


def survey_head() -> str:
    levels = ",\n".join(_levels_cte(f"lv_{c}", "survey", c) for c in PROFILE_LABELS)
    repl = ", ".join(f"{_list(lab)}[lv_{c}.i] AS {c}" for c, lab in PROFILE_LABELS.items())
    joins = " ".join(f"LEFT JOIN lv_{c} ON s.{c} = lv_{c}.code" for c in PROFILE_LABELS)
    return f"""WITH {_SURVEY_SQL},
{levels},
data AS (SELECT s.* REPLACE ({repl}) FROM survey s {joins}),
commuters1 AS (SELECT * FROM data WHERE Q4 <> 'Never use PT'),
{_levels_cte('lv_Q5', 'commuters1', 'Q5')},
commuters AS (SELECT c.* REPLACE ({_list(K.MODE_LABELS)}[lv_Q5.i] AS Q5) FROM commuters1 c LEFT JOIN lv_Q5 ON c.Q5 = lv_Q5.code)
"""


def _freq_sql(col: str, labels, first: int | None) -> str:
    keep = f"WHERE level <= {first}" if first else ""
    if first:
        return f"""cnt AS (SELECT {col} AS code, count(*) AS n FROM survey WHERE {col} IS NOT NULL GROUP BY {col}),
rk AS (SELECT *, row_number() OVER (ORDER BY code) AS level FROM cnt),
kept AS (SELECT * FROM rk {keep})
SELECT level, {_list(labels)}[level] AS label, code, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM kept"""
    return f"""cnt AS (SELECT {col} AS code, count(*) AS n FROM survey WHERE {col} IS NOT NULL GROUP BY {col}),
rk AS (SELECT *, row_number() OVER (ORDER BY code) AS level FROM cnt),
lv AS (SELECT i AS level, {_list(labels)}[i] AS label FROM range(1, {len(labels) + 1}) r(i)),
kept AS (SELECT lv.level, lv.label, rk.code, coalesce(rk.n, 0) AS n FROM lv LEFT JOIN rk ON lv.level = rk.level)
SELECT level, label, code, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM kept"""


def _contingency_sql(labels: dict) -> str:
    parts = []
    for q, lab in labels.items():
        pick = f"(SELECT {q} AS code, count(*) AS n FROM survey WHERE {q} IS NOT NULL GROUP BY {q} ORDER BY code LIMIT {len(lab)})"
        parts.append(f"SELECT '{q}' AS result, row_number() OVER (ORDER BY code) AS level, {_list(lab)}[row_number() OVER (ORDER BY code)] AS label, "
                     f"CAST(NULL AS VARCHAR) AS other, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM {pick}")
    for a, b in CROSSTABS:
        parts.append(f"SELECT '{a} x {b}' AS result, CAST(NULL AS BIGINT) AS level, {a} AS label, {b} AS other, count(*) AS n, "
                     f"CAST(NULL AS DOUBLE) AS pct FROM commuters GROUP BY {a}, {b}")
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts)


def _cov_sql(block) -> str:
    from itertools import combinations

    parts = []
    for a, b in combinations(block, 2):
        parts.append(
            f"SELECT '{a}' AS col1, '{b}' AS col2, CASE WHEN count({a}) = count(*) AND count({b}) = count(*) "
            f"AND count(*) > 1 THEN CAST(CAST(count(*) AS HUGEINT) * sum(CAST({a} AS HUGEINT) * {b}) "
            f"- sum(CAST({a} AS HUGEINT)) * sum(CAST({b} AS HUGEINT)) AS DOUBLE) "
            f"/ CAST(CAST(count(*) AS HUGEINT) * (count(*) - 1) AS DOUBLE) END AS covariance FROM commuters1"
        )
    return " UNION ALL ".join(parts)


def _alpha_sql(block, name: str) -> str:
    k = len(block)
    total = " + ".join(f"CAST({c} AS HUGEINT)" for c in block)
    num = " + ".join(f"(n * s2_{c} - s_{c} * s_{c})" for c in block)
    sums = ", ".join(f"sum(CAST({c} AS HUGEINT)) AS s_{c}, sum(CAST({c} AS HUGEINT) * {c}) AS s2_{c}" for c in block)
    return f"""cc AS (SELECT {', '.join(block)}, {total} AS t FROM commuters1 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in block)}),
m AS (SELECT CAST(count(*) AS HUGEINT) AS n, sum(t) AS st, sum(t * t) AS stt, {sums} FROM cc),
r AS (SELECT n, n * stt - st * st AS den, {num} AS num FROM m)
SELECT '{name}' AS block, {k} AS items, CAST(n AS BIGINT) AS n,
  CASE WHEN den <> 0 THEN CAST({k} * (den - num) AS DOUBLE) / CAST({k - 1} * den AS DOUBLE) END AS alpha FROM r"""


def _box_sql(src: str, groups, value: str) -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM f.{c}" for c in groups)
    fg = ", ".join(f"f.{c}" for c in groups)
    return f"""b AS (SELECT {g}, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL),
q AS (SELECT {g}, count(*) AS n, quantile_cont(v, 0.25) AS lower_quartile, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.75) AS upper_quartile FROM b GROUP BY {g}),
f AS (SELECT *, lower_quartile - 1.5 * (upper_quartile - lower_quartile) AS lo,
      upper_quartile + 1.5 * (upper_quartile - lower_quartile) AS hi FROM q)
SELECT {fg}, f.n, f.lower_quartile, f.median, f.upper_quartile,
  least(f.lower_quartile, min(CASE WHEN v >= lo AND v <= hi THEN v END)) AS lower_whisker,
  greatest(f.upper_quartile, max(CASE WHEN v >= lo AND v <= hi THEN v END)) AS upper_whisker,
  count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers
FROM b JOIN f ON {on} GROUP BY {fg}, f.n, f.lower_quartile, f.median, f.upper_quartile"""


def _melt_sql(block, aspects: dict) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in aspects.items())
    return f"""mblock AS (SELECT Q3, {', '.join(block)} FROM commuters1),
long AS (SELECT * FROM mblock UNPIVOT INCLUDE NULLS (Ratings FOR Aspects IN ({', '.join(block)}))),
melted AS (SELECT Q3 AS Occupation, CASE Aspects {case} ELSE Aspects END AS Aspects, Ratings FROM long)"""


def _labelled_sql() -> str:
    """Commuters with every rating labelled (Q5 already is in ``commuters``)."""
    levels = ", ".join(_levels_cte(f"lv_{c}", "commuters1", c) for c in K.RATING_LABELS)
    repl = ", ".join(f"{_list(lab)}[lv_{c}.i] AS {c}" for c, lab in K.RATING_LABELS.items())
    joins = " ".join(f"LEFT JOIN lv_{c} ON c.{c} = lv_{c}.code" for c in K.RATING_LABELS)
    return f", {levels} SELECT c.* REPLACE ({repl}) FROM commuters c {joins}"


def _outliers_sql() -> str:
    return f""", long AS (SELECT * FROM (SELECT Q3, {', '.join(BOXED)} FROM commuters1)
  UNPIVOT (v FOR rating IN ({', '.join(BOXED)}))),
f AS (SELECT Q3, rating, quantile_cont(CAST(v AS DOUBLE), 0.25) AS lq, quantile_cont(CAST(v AS DOUBLE), 0.75) AS uq
  FROM long GROUP BY Q3, rating)
SELECT long.Q3, long.rating, CAST(v AS DOUBLE) AS value, count(*) AS "count" FROM long JOIN f
  ON long.Q3 = f.Q3 AND long.rating = f.rating
WHERE v < lq - 1.5 * (uq - lq) OR v > uq + 1.5 * (uq - lq) GROUP BY long.Q3, long.rating, v"""


def survey_sql() -> dict[str, str]:
    h = survey_head()
    out = {
        "survey_labelled": h + "SELECT * FROM data",
        "commuters_labelled": h + _labelled_sql(),
        "box_outliers": h + _outliers_sql(),
        "non_commuters": h + "SELECT Q1, Q2, Q3, Q4 FROM data WHERE Q4 = 'Never use PT'",
        "freq_gender": h + ", " + _freq_sql("Q1", K.GENDER_LABELS, None),
        "freq_age": h + ", " + _freq_sql("Q2", K.AGE_LABELS, None),
        "freq_occupation": h + ", " + _freq_sql("Q3", K.OCCUPATION_LABELS, None),
        "freq_frequency": h + ", " + _freq_sql("Q4", K.FREQUENCY_LABELS, None),
        "freq_mode": h + ", " + _freq_sql("Q5", K.MODE_LABELS, len(K.MODE_LABELS)),
        "crosstab_gender_occupation": h + 'SELECT Q1, Q3, count(*) AS "count" FROM commuters GROUP BY Q1, Q3',
        "crosstab_age_occupation": h + 'SELECT Q2, Q3, count(*) AS "count" FROM commuters GROUP BY Q2, Q3',
        "crosstab_occupation_frequency": h + 'SELECT Q3, Q4, count(*) AS "count" FROM commuters GROUP BY Q3, Q4',
        "crosstab_occupation_mode": h + 'SELECT Q3, Q5, count(*) AS "count" FROM commuters GROUP BY Q3, Q5',
        "crosstab_wide_occupation_mode": h + "SELECT Q3, " + ", ".join(
            f"count(*) FILTER (WHERE Q5 = '{m}') AS \"{m}\"" for m in K.MODE_LABELS) + " FROM commuters GROUP BY Q3",
        "indexed_covariance_q9": h + "SELECT row_number() OVER (ORDER BY col1, col2) AS row, * FROM ("
        + _cov_sql(K.Q9_COLUMNS) + ")",
        "covariance_q9": h + _cov_sql(K.Q9_COLUMNS),
        "covariance_q10": h + _cov_sql(K.Q10_COLUMNS),
        "cronbach_q9": h + ", " + _alpha_sql(K.Q9_COLUMNS, "Q9"),
        "cronbach_q10": h + ", " + _alpha_sql(K.Q10_COLUMNS, "Q10"),
        "bar_occupation": h + 'SELECT Q3, count(*) AS "count" FROM commuters1 GROUP BY Q3',
        "melt_q9": h + ", " + _melt_sql(K.Q9_COLUMNS, Q9_ASPECT_MAP) + " SELECT * FROM melted",
        "melt_q10": h + ", " + _melt_sql(K.Q10_COLUMNS, Q10_ASPECT_MAP) + " SELECT * FROM melted",
        "box_melted_q9": h + ", " + _melt_sql(K.Q9_COLUMNS, Q9_ASPECT_MAP) + ", "
        + _box_sql("melted", ["Occupation", "Aspects"], "Ratings"),
        "box_melted_q10": h + ", " + _melt_sql(K.Q10_COLUMNS, Q10_ASPECT_MAP) + ", "
        + _box_sql("melted", ["Occupation", "Aspects"], "Ratings"),
    }
    labels = {"Q1": K.GENDER_LABELS, "Q2": K.AGE_LABELS, "Q3": K.OCCUPATION_LABELS, "Q4": K.FREQUENCY_LABELS, "Q5": K.MODE_LABELS}
    out["survey_contingency"] = h + _contingency_sql(labels)
    out["price_quantiles"] = (
        "SELECT l_returnflag, count(l_extendedprice) AS n, " + ", ".join(
            f"round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {q}), 6) AS {c}" for c, q in PRICE_QUANTILES.items())
        + " FROM lineitem GROUP BY l_returnflag")
    for col in BOXED:
        out[f"box_{col.lower()}"] = h + ", " + _box_sql("commuters1", ["Q3"], col)
    return out
