"""Stand-in inputs: the driver's test tables shaped as the reference's inputs.

These only give rows in the schema the jobs expect (simple arithmetic on
existing columns, so Spark and DuckDB produce the same rows); they do none of
the jobs' work. The jobs themselves take any data of that schema.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import JOURNEY_SCHEMA, SURVEY_QUESTION_COLUMNS
from .parallel import ensure_parallelism

# Code -> label tables used to dress integer test columns as card data.
PASSENGER_BY_MOD4 = ("Adult", "Child/Youth", "Concession", "Senior/Pensioner")
CARD_TYPE_BY_MOD11 = {
    0: "Senior/Pensioner",
    1: "Adult",
    2: "Free Travel",
    3: "School Student",
    4: "Child/Youth",
    5: "Employee",
    6: "Concession",
    8: "Sgl Trip Rail Adult",
    9: "Sgl Trip Ferry",
}
DISCOUNT_BY_MOD5 = ("No DE", "Concession", "Senior/Pensioner", "School Student", "Employee")
MODE_BY_EVENT = {"click": "Bus", "view": "Train", "purchase": "Ferry", "signup": "Light rail", "error": "UNKNOWN"}
STATUS_BY_MOD7 = {0: "UNKNOWN", 1: "HOTLISTED", 2: "BLOCKED", 3: "EXPIRED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a single-row-group file is spread over all cores."""
    return ensure_parallelism(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def _pick(code: Column, labels, default: str | None = None) -> Column:
    items = labels.items() if isinstance(labels, dict) else enumerate(labels)
    out = None
    for k, v in items:
        out = (F.when(code == k, F.lit(v)) if out is None else out.when(code == k, F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def journeys_from_events(events: DataFrame) -> DataFrame:
    """``events`` -> journey rows (JOURNEY_SCHEMA)."""
    k = F.get_json_object("props", "$.k").cast("int")
    t1 = F.date_trunc("second", F.col("ts"))
    dur = F.floor(F.col("value") * 60).cast("bigint")
    base = events.select(
        "event_id", "user_id", "event_type", "value",
        k.alias("k"), t1.alias("t1"), dur.alias("dur"),
    )
    base = base.withColumns(
        {
            "t2": F.timestamp_add("SECOND", F.col("dur"), F.col("t1")),
            "k2": (F.col("k") * 7 + 3) % 100,
            "no_tag_off": (F.col("event_id") % 17) == 0,
        }
    )
    no_off = F.col("no_tag_off")
    stop = lambda kk: F.concat(F.lit("Stop "), kk.cast("string"))
    out = base.select(
        F.col("user_id").alias("CARD_FK"),
        _pick(F.col("user_id") % 4, PASSENGER_BY_MOD4).alias("PSNGR_TYP_CD"),
        _pick(F.col("user_id") % 11, CARD_TYPE_BY_MOD11, "UNKNOWN").alias("CARD_TYP_CD"),
        F.col("event_id").alias("JRNY_ID"),
        _pick(F.col("user_id") % 5, DISCOUNT_BY_MOD5).alias("DISC_ENT_DESC"),
        _pick(F.col("event_type"), MODE_BY_EVENT).alias("TS_TYP_CD"),
        F.round(F.col("value") * 100).cast("bigint").alias("JS_FARE_CENTS_AMT"),
        F.when(F.col("event_id") % 13 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("dur")).alias("JS_DURN_SEC"),
        F.lit(None).cast("string").alias("IMTT_DESC"),
        F.when(F.col("event_id") % 29 == 0, F.lit(-1))
        .otherwise(F.date_format("t1", "yyyyMMdd").cast("int")).alias("TAG1_DT_FK"),
        F.when(no_off, F.lit(-1)).otherwise(F.date_format("t2", "yyyyMMdd").cast("int")).alias("TAG2_DT_FK"),
        F.date_format("t1", "HH:mm:ss").alias("TAG1_TM"),
        F.when(no_off, F.lit("UNKNOWN")).otherwise(F.date_format("t2", "HH:mm:ss")).alias("TAG2_TM"),
        stop(F.col("k")).alias("TAG1_TS_NM"),
        (F.lit(-33.0) - F.col("k") / 100).alias("TAG1_LAT_VAL"),
        (F.lit(151.0) + F.col("k") / 100).alias("TAG1_LONG_VAL"),
        F.when(no_off, F.lit("UNKNOWN")).otherwise(stop(F.col("k2"))).alias("TAG2_TS_NM"),
        (F.lit(-33.0) - F.col("k2") / 100).alias("TAG2_LAT_VAL"),
        (F.lit(151.0) + F.col("k2") / 100).alias("TAG2_LONG_VAL"),
        (~F.hour("t1").isin(7, 8, 16, 17)).alias("TAG1_OFF_PEAK_IND"),
        (~F.hour("t2").isin(7, 8, 16, 17)).alias("TAG2_OFF_PEAK_IND"),
        F.when(F.col("k") % 10 == 0, F.lit(-1)).otherwise(F.col("k") % 10).cast("int").alias("ROUTE_val_ID"),
        F.concat(F.lit("Route "), (F.col("k") % 10).cast("string")).alias("ROUTE_val_NM"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOURNEY_SCHEMA.fields])


def cards_from_orders(orders: DataFrame) -> DataFrame:
    """``orders`` -> card snapshot rows; the snapshot is the order month."""
    return orders.select(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date"),
        _pick(F.col("o_orderkey") % 11, CARD_TYPE_BY_MOD11, "UNKNOWN").alias("CARD_TYP_CD"),
        _pick(F.col("o_custkey") % 5, DISCOUNT_BY_MOD5).alias("DISC_ENT_DESC"),
        _pick(F.col("o_custkey") % 4, PASSENGER_BY_MOD4).alias("PSNGR_TYP_DESC"),
        _pick(F.col("o_orderkey") % 7, STATUS_BY_MOD7, "ISSUED").alias("CARD_STAT_CD"),
    )


def survey_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` -> survey answers (integer codes)."""
    q, disc, tax = F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    ln, sk, pk, ok = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey")

    def r(expr: Column, m: int) -> Column:
        return (F.lit(1) + expr % m).cast("int")

    cols = {
        "Q1": r(sk, 2), "Q2": r(pk, 6), "Q3": r(pk, 9), "Q4": r(ok, 5), "Q5": r(sk, 4),
        # as many codes as the reference has labels for the column
        "Q9_A": r(q, 9), "Q9_B": r(disc, 8), "Q9_C": r(tax, 9), "Q9_D": r(q + ln, 9),
        "Q9_E": r(q + tax, 8), "Q9_F": r(q + ln, 8), "Q9_G": r(sk, 8),
        "Q10_A": r(F.floor(F.col("l_extendedprice")), 9),
        "Q10_B": r(q, 9), "Q10_C": r(disc, 8), "Q10_D": r(tax, 9), "Q10_E": r(ln + disc, 8), "Q10_F": r(q + tax, 9),
        # mostly one answer, so that box plots have outliers
        "Q12": F.when(q == 1, 1).when(q == 2, 2).when(q == 49, 4).when(q == 50, 5).otherwise(3),
    }
    return lineitem.select(*[cols[c].alias(c) for c in SURVEY_QUESTION_COLUMNS])


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys_from_events(table(spark, sf_dir, "events"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards_from_orders(table(spark, sf_dir, "orders"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_from_lineitem(table(spark, sf_dir, "lineitem"))
