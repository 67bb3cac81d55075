"""Queries over files and wide tables: delimited text, card files by manifest
and by ledger, dated landing, calendar, level table and wide covariance.

Each writes what it needs from the given tables into the shared folder and
reads it back through the library's own readers.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..config import JourneyConfig
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import transfers as T
from ..operators.calendar import calendar_days, with_day_class
from ..operators.levels import encode_by_table, labelled_levels, level_table
from ..operators.moments import wide_covariance
from ..schemas import CARD_SCHEMA, JOURNEY_COLUMNS, JOURNEY_SCHEMA
from ..session import shared_dir
from ..sources import adapters as AD
from ..sources.delimited import read_delimited
from ..sources.landing import clean_days, land_journeys
from ..sources.ledger import CardLedger
from ..sources.snapshots import read_manifest, snapshot_text, with_snapshot_date
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]

STAMP = r"stamp=(\d{8})"
DAYS = (20240105, 20240106, 20240107)
WIDE = 60


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "faretrail", f"{name}-{uuid.uuid4().hex}")


# -- delimited text ------------------------------------------------------------


def _journey_files(spark: SparkSession, d: str, cfg: JourneyConfig) -> str:
    folder = _folder(spark, "journeys")
    sinks.write_delimited(T.select_journeys(AD.journeys(spark, d), cfg), folder, sep="|")
    return folder


def delimited_round_trip(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """Journeys written as ``|`` text and read back by a glob."""
    return read_delimited(spark, os.path.join(_journey_files(spark, d, cfg), "part-*"), JOURNEY_SCHEMA)


def delimited_inferred(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """The same files with inferred types; sums of columns found to be numbers."""
    raw = read_delimited(spark, _journey_files(spark, d, cfg), infer_schema=True)
    numbers = [c for c, t in raw.dtypes if t in ("int", "bigint")]
    return raw.groupBy("TS_TYP_CD").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in numbers])


def columns_by_position(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """Columns dropped by name and by place, then kept by place."""
    named = T.select_journeys(AD.journeys(spark, d), cfg).drop("IMTT_DESC")
    return C.keep_positions(C.drop_positions(named, (1, 2, 3, 8)), (1, 3, 2))


# -- card files ------------------------------------------------------------------


def _card_files(spark: SparkSession, d: str) -> str:
    """Card rows as one text file per snapshot date under ``stamp=<date>``."""
    folder = _folder(spark, "cards")
    rows = AD.cards(spark, d)
    stamped = rows.select(*[f.name for f in CARD_SCHEMA.fields], F.date_format("snapshot_date", "yyyyMMdd").alias("stamp"))
    stamped.repartition("stamp").write.option("header", True).option("sep", "|").partitionBy("stamp").csv(folder)
    return folder


def _manifest(spark: SparkSession, folder: str) -> str:
    """A manifest (S3) that lists the files of a folder."""
    files = spark.read.option("header", True).option("sep", "|").csv(folder).select(F.col("_metadata.file_path").alias("x")).distinct()
    path = _folder(spark, "manifest")
    files.select(F.crc32("x").alias("_c0"), F.url_decode("x").alias("x")).write.option("header", True).csv(path)
    return path


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """The files of a manifest in one scan, dated by their names."""
    paths = read_manifest(spark, _manifest(spark, _card_files(spark, d)))
    rows = with_snapshot_date(read_delimited(spark, paths, CARD_SCHEMA, with_file_path=True), pattern=STAMP)
    return A.rows_per_snapshot(rows).select(snapshot_text().alias("date"), "cardCount")


def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    """A7 by the ledger: half of the files first, then all of them, so that
    the second run reads the other half only."""
    paths = sorted(read_manifest(spark, _manifest(spark, _card_files(spark, d))))
    ledger = CardLedger(spark, _folder(spark, "ledger"), pattern=STAMP)
    ledger.update(paths[: len(paths) // 2])
    return ledger.card_count(paths).select(snapshot_text().alias("date"), F.col("CARD_TYP_CD").alias("type"), "typeCount")


# -- days --------------------------------------------------------------------------


def landed_days(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """Journeys landed by date, one day landed again, three days cleaned."""
    folder, raw = _folder(spark, "landing"), AD.journeys(spark, d)
    land_journeys(raw, folder, cfg)
    land_journeys(raw.where(F.col("TAG1_DT_FK") == DAYS[0]), folder, cfg, files_per_day=3)
    return clean_days(spark, folder, DAYS, cfg)


def calendar_departures(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """F6, F7, A3 by a calendar of 18,263 days."""
    clean = T.clean_journeys(T.select_journeys(AD.journeys(spark, d), cfg), cfg)
    dated = with_day_class(clean, calendar_days(spark, "1990-01-01", "2040-01-01"))
    return A.segmented_count(dated, ["day_class", "TAG1_TS_NM"])


# -- wide tables ---------------------------------------------------------------------


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    """V1 by the level table: every part key of the order lines is a level."""
    lines = AD.table(spark, d, "lineitem").select("l_partkey")
    levels = level_table(lines, ["l_partkey"])
    labels = levels.select("col", "level", F.concat(F.lit("Level "), F.col("level")).alias("label"))
    coded = encode_by_table(lines, labelled_levels(levels, labels), ["l_partkey"])
    return A.segmented_count(coded, ["l_partkey"])


def wide_columns() -> dict[str, str]:
    """Integer columns of an order line, as SQL."""
    return {f"c{k}": f"CAST((CAST(l_quantity AS BIGINT) * {k + 3} + l_linenumber * {k} + l_partkey) % {k + 5} AS INTEGER)" for k in range(WIDE)}


def wide_block(spark: SparkSession, d: str) -> DataFrame:
    """A12 of 60 columns: 1770 pairs in one job."""
    cols = wide_columns()
    rows = AD.table(spark, d, "lineitem").selectExpr(*[f"{sql} AS {c}" for c, sql in cols.items()])
    return wide_covariance(rows, list(cols))


def saved_session(spark: SparkSession, d: str, cfg: JourneyConfig) -> DataFrame:
    """K5: two results saved and read back."""
    rows = T.select_journeys(AD.journeys(spark, d), cfg)
    written = sinks.save_results({c: A.segmented_count(rows, [c]) for c in ("TS_TYP_CD", "PSNGR_TYP_CD")}, _folder(spark, "session"))
    parts = [spark.read.parquet(p).select(F.lit(c).alias("result"), F.col(c).alias("value"), "count") for c, p in written.items()]
    return parts[0].unionByName(parts[1])


def file_queries(cfg: JourneyConfig) -> dict[str, Query]:
    return {
        "delimited_round_trip": lambda s, d: delimited_round_trip(s, d, cfg),
        "delimited_inferred": lambda s, d: delimited_inferred(s, d, cfg),
        "columns_by_position": lambda s, d: columns_by_position(s, d, cfg),
        "manifest_counts": manifest_counts,
        "ledger_counts": ledger_counts,
        "landed_days": lambda s, d: landed_days(s, d, cfg),
        "calendar_departures": lambda s, d: calendar_departures(s, d, cfg),
        "level_counts": level_counts,
        "wide_covariance": wide_block,
        "saved_session": lambda s, d: saved_session(s, d, cfg),
    }


# ---------------------------------------------------------------------------
# DuckDB statements
# ---------------------------------------------------------------------------


def _wide_sql() -> str:
    cols = wide_columns()
    sums = ", ".join(f"sum(CAST({c} AS HUGEINT)) AS s_{c}" for c in cols)
    products = ", ".join(f"sum(CAST({a} AS HUGEINT) * {b}) AS p_{a}_{b}" for a, b in combinations(cols, 2))
    rows = ", ".join(f"{{'col1': '{a}', 'col2': '{b}', 'covariance': CAST(n * p_{a}_{b} - s_{a} * s_{b} AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)}}"
                     for a, b in combinations(cols, 2))
    return (f"WITH w AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in cols.items())} FROM lineitem), "
            f"m AS (SELECT CAST(count(*) AS HUGEINT) AS n, {sums}, {products} FROM w) SELECT unnest([{rows}], recursive := true) FROM m")


def file_sql(cfg: JourneyConfig, cards: dict[str, str]) -> dict[str, str]:
    h = O.journey_ctes(cfg)
    numbers = ("CARD_FK", "JRNY_ID", "JS_FARE_CENTS_AMT", "JS_DURN_SEC", "TAG1_DT_FK", "TAG2_DT_FK", "ROUTE_val_ID")
    kept = [c for i, c in enumerate([c for c in JOURNEY_COLUMNS if c != "IMTT_DESC"], 1) if i not in (1, 2, 3, 8)]
    return {
        "delimited_round_trip": h + "SELECT * FROM selected",
        "delimited_inferred": h + "SELECT TS_TYP_CD, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in numbers)
        + " FROM selected GROUP BY TS_TYP_CD",
        "columns_by_position": h + f"SELECT {kept[0]}, {kept[2]}, {kept[1]} FROM selected",
        "manifest_counts": cards["r49_data_count"],
        "ledger_counts": cards["r50_card_count"],
        "landed_days": h + f"SELECT * FROM journey WHERE TAG1_DT_FK IN {DAYS}",
        "calendar_departures": h + """SELECT CASE WHEN TAG1_DT_FK = -1 THEN 'weekday' ELSE
            CASE dayofweek(strptime(CAST(TAG1_DT_FK AS VARCHAR), '%Y%m%d')) WHEN 0 THEN 'sunday' WHEN 6 THEN 'saturday' ELSE 'weekday' END END
            AS day_class, TAG1_TS_NM, count(*) AS "count" FROM journey GROUP BY 1, 2""",
        "level_counts": """SELECT 'Level ' || level AS l_partkey, count(*) AS "count" FROM
            (SELECT dense_rank() OVER (ORDER BY l_partkey) AS level FROM lineitem) GROUP BY level""",
        "wide_covariance": _wide_sql(),
        "saved_session": h + """SELECT 'TS_TYP_CD' AS result, TS_TYP_CD AS value, count(*) AS "count" FROM selected GROUP BY TS_TYP_CD
            UNION ALL SELECT 'PSNGR_TYP_CD', PSNGR_TYP_CD, count(*) FROM selected GROUP BY PSNGR_TYP_CD""",
    }
