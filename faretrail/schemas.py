"""Declared input schemas (never inferred: see README, "Hazards")."""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as K

JOURNEY_SCHEMA = T.StructType(
    [
        T.StructField("CARD_FK", T.LongType()),
        T.StructField("PSNGR_TYP_CD", T.StringType()),
        T.StructField("CARD_TYP_CD", T.StringType()),
        T.StructField("JRNY_ID", T.LongType()),
        T.StructField("DISC_ENT_DESC", T.StringType()),
        T.StructField("TS_TYP_CD", T.StringType()),
        T.StructField("JS_FARE_CENTS_AMT", T.LongType()),
        T.StructField("JS_DURN_SEC", T.LongType()),
        T.StructField("IMTT_DESC", T.StringType()),
        T.StructField("TAG1_DT_FK", T.IntegerType()),
        T.StructField("TAG2_DT_FK", T.IntegerType()),
        T.StructField("TAG1_TM", T.StringType()),
        T.StructField("TAG2_TM", T.StringType()),
        T.StructField("TAG1_TS_NM", T.StringType()),
        T.StructField("TAG1_LAT_VAL", T.DoubleType()),
        T.StructField("TAG1_LONG_VAL", T.DoubleType()),
        T.StructField("TAG2_TS_NM", T.StringType()),
        T.StructField("TAG2_LAT_VAL", T.DoubleType()),
        T.StructField("TAG2_LONG_VAL", T.DoubleType()),
        T.StructField("TAG1_OFF_PEAK_IND", T.BooleanType()),
        T.StructField("TAG2_OFF_PEAK_IND", T.BooleanType()),
        T.StructField("ROUTE_val_ID", T.IntegerType()),
        T.StructField("ROUTE_val_NM", T.StringType()),
    ]
)

# Columns the journey job keeps (plus the two route columns its route report needs).
JOURNEY_COLUMNS = tuple(f.name for f in JOURNEY_SCHEMA.fields)

CARD_SCHEMA = T.StructType(
    [
        T.StructField("CARD_TYP_CD", T.StringType()),
        T.StructField("DISC_ENT_DESC", T.StringType()),
        T.StructField("PSNGR_TYP_DESC", T.StringType()),
        T.StructField("CARD_STAT_CD", T.StringType()),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [T.StructField("_c0", T.StringType()), T.StructField("x", T.StringType())]
)

SURVEY_QUESTION_COLUMNS = (
    ("Q1", "Q2", "Q3", "Q4", "Q5") + K.Q9_COLUMNS + K.Q10_COLUMNS + ("Q12",)
)
SURVEY_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in SURVEY_QUESTION_COLUMNS]
)

# Stop keys of the departure (tag-on) and destination (tag-off) reports.
DEPARTURE_KEYS = ("TAG1_TS_NM", "TAG1_LAT_VAL", "TAG1_LONG_VAL")
DESTINATION_KEYS = ("TAG2_TS_NM", "TAG2_LAT_VAL", "TAG2_LONG_VAL")
