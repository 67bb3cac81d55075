"""Hand-made journey rows for unit tests."""

from __future__ import annotations

from faretrail.schemas import JOURNEY_SCHEMA

BASE = {
    "CARD_FK": 1,
    "PSNGR_TYP_CD": "Adult",
    "CARD_TYP_CD": "Adult",
    "JRNY_ID": 1,
    "DISC_ENT_DESC": "No Discount",
    "TS_TYP_CD": "Bus",
    "JS_FARE_CENTS_AMT": 100,
    "JS_DURN_SEC": 600,
    "IMTT_DESC": None,
    "TAG1_DT_FK": 20160801,
    "TAG2_DT_FK": 20160801,
    "TAG1_TM": "08:00:00",
    "TAG2_TM": "08:10:00",
    "TAG1_TS_NM": "A",
    "TAG1_LAT_VAL": -33.0,
    "TAG1_LONG_VAL": 151.0,
    "TAG2_TS_NM": "B",
    "TAG2_LAT_VAL": -33.1,
    "TAG2_LONG_VAL": 151.1,
    "TAG1_OFF_PEAK_IND": False,
    "TAG2_OFF_PEAK_IND": False,
    "ROUTE_val_ID": 5,
    "ROUTE_val_NM": "R5",
}


def journeys(spark, rows):
    """DataFrame of journey rows; each row is a dict of overrides of BASE.

    ``JRNY_ID`` defaults to the row's position (1-based).
    """
    full = []
    for i, r in enumerate(rows, start=1):
        d = dict(BASE, JRNY_ID=i)
        d.update(r)
        full.append(tuple(d[f.name] for f in JOURNEY_SCHEMA.fields))
    return spark.createDataFrame(full, JOURNEY_SCHEMA)


def by_id(df, col):
    return {r["JRNY_ID"]: r[col] for r in df.select("JRNY_ID", col).collect()}


def document(folder):
    """The records of an ``{"Info":[...]}`` document: its parts in name order."""
    import json
    import os

    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return json.loads("".join(open(os.path.join(folder, f)).read() for f in parts))["Info"]
