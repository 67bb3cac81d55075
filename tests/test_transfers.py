"""Transfer detection: boundaries, null cards, ranges, and equivalence with
the reference's one-window-per-date formulation."""

import random

from helpers import by_id, journeys
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faretrail.config import JourneyConfig
from faretrail.operators import cleaning as C
from faretrail.operators import transfers as T
from faretrail.operators.ordered import by_ranges

NO = "No inter-modal transfer"


def _imtt(spark, rows, **kw):
    df = journeys(spark, rows)
    return by_id(T.detect_transfers(T.previous_trip(df, **kw)), "IMTT_DESC")


def test_gap_boundaries(spark):
    rows = [
        {"CARD_FK": 1, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00"},
        {"CARD_FK": 1, "TS_TYP_CD": "Train", "TAG1_TM": "09:09:59", "TAG2_TM": "09:20:00"},  # gap 3599
        {"CARD_FK": 2, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00"},
        {"CARD_FK": 2, "TS_TYP_CD": "Train", "TAG1_TM": "09:10:00", "TAG2_TM": "09:20:00"},  # gap 3600
    ]
    out = _imtt(spark, rows)
    assert out == {1: NO, 2: "Bus to train", 3: NO, 4: NO}


def test_negative_gap_same_mode_and_null_card(spark):
    rows = [
        # previous tag-off after this tag-on: |gap| is used
        {"CARD_FK": 1, "TS_TYP_CD": "Ferry", "TAG1_TM": "08:00:00", "TAG2_TM": "08:30:00"},
        {"CARD_FK": 1, "TS_TYP_CD": "Bus", "TAG1_TM": "08:20:00", "TAG2_TM": "08:40:00"},
        # same mode is no transfer
        {"CARD_FK": 3, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00"},
        {"CARD_FK": 3, "TS_TYP_CD": "Bus", "TAG1_TM": "08:20:00", "TAG2_TM": "08:30:00"},
        # null cards never transfer
        {"CARD_FK": None, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00"},
        {"CARD_FK": None, "TS_TYP_CD": "Train", "TAG1_TM": "08:20:00", "TAG2_TM": "08:30:00"},
    ]
    out = _imtt(spark, rows)
    assert out == {1: NO, 2: "Ferry to bus", 3: NO, 4: NO, 5: NO, 6: NO}


def test_other_day_and_zero_duration_predecessor(spark):
    rows = [
        {"CARD_FK": 1, "TS_TYP_CD": "Bus", "TAG1_DT_FK": 20160801, "TAG1_TM": "23:50:00", "TAG2_TM": "23:59:00"},
        {"CARD_FK": 1, "TS_TYP_CD": "Train", "TAG1_DT_FK": 20160802, "TAG2_DT_FK": 20160802,
         "TAG1_TM": "00:05:00", "TAG2_TM": "00:20:00"},                        # first trip of its day
        {"CARD_FK": 5, "TS_TYP_CD": "Ferry", "JS_DURN_SEC": 0, "TAG1_TM": "10:00:00", "TAG2_TM": "10:00:00"},
        {"CARD_FK": 5, "TS_TYP_CD": "Bus", "TAG1_TM": "10:30:00", "TAG2_TM": "10:40:00"},
    ]
    out = _imtt(spark, rows)
    # a zero-duration trip is still the previous trip; it is dropped only later
    assert out == {1: NO, 2: NO, 3: NO, 4: "Ferry to bus"}


def test_same_second_ties_and_ranges(spark):
    rows = [
        {"CARD_FK": 7, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:00:30"},
        {"CARD_FK": 7, "TS_TYP_CD": "Train", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00"},
        {"CARD_FK": 7, "TS_TYP_CD": "Ferry", "TAG1_TM": "08:00:40", "TAG2_TM": "08:30:00"},
        {"CARD_FK": 7, "TS_TYP_CD": "Light rail", "TAG1_TM": "08:45:00", "TAG2_TM": "09:00:00"},
    ]
    for kw in ({}, {"group_rows": 1}, {"group_rows": 3}):
        out = _imtt(spark, rows, **kw)
        assert out == {1: NO, 2: "Bus to train", 3: "Train to ferry", 4: "Ferry to light rail"}, kw


def test_clean_journeys_end_to_end(spark):
    rows = [
        {"CARD_FK": 1, "TS_TYP_CD": "Train", "TAG1_TM": "08:00:00", "TAG2_TM": "08:10:00", "CARD_TYP_CD": "UNKNOWN",
         "DISC_ENT_DESC": "No DE"},
        {"CARD_FK": 1, "TS_TYP_CD": "Bus", "TAG1_TM": "08:20:00", "TAG2_TM": "08:30:00", "CARD_TYP_CD": "Sgl x"},
        {"CARD_FK": 1, "TS_TYP_CD": "UNKNOWN", "TAG1_TM": "08:40:00"},
        {"CARD_FK": 1, "TS_TYP_CD": "Ferry", "JS_DURN_SEC": -1, "TAG1_TM": "09:00:00", "TAG2_DT_FK": -1,
         "TAG2_TM": "UNKNOWN"},
    ]
    out = T.clean_journeys(journeys(spark, rows), JourneyConfig())
    got = {r.JRNY_ID: (r.IMTT_DESC, r.CARD_TYP_CD) for r in out.collect()}
    assert got == {1: (NO, "Adult"), 2: ("Rail to bus", "Sgl Trip Ticket")}


def _random_rows(seed, n):
    rnd = random.Random(seed)
    modes = ["Bus", "Train", "Ferry", "Light rail"]
    rows = []
    for _ in range(n):
        t1 = rnd.randrange(0, 86400, rnd.choice([1, 60, 600]))
        t2 = t1 + rnd.randrange(0, 4000)
        fmt = lambda s: f"{s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
        rows.append({
            "JRNY_ID": rnd.randrange(1, n + 1),  # duplicate ids: ties on (time, id)
            "CARD_FK": rnd.choice([None, 1, 2, 3, 4]),
            "TS_TYP_CD": rnd.choice(modes),
            "TAG1_DT_FK": rnd.choice([20160801, 20160802]),
            "TAG2_DT_FK": rnd.choice([20160801, 20160802, -1]),
            "TAG1_TM": rnd.choice([fmt(t1), fmt(t1), None]),
            "TAG2_TM": fmt(t2),
            "JS_DURN_SEC": rnd.choice([-1, 0, 60, 600]),
        })
    return rows


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), n=st.integers(1, 60), group_rows=st.sampled_from([1, 4, 1000]))
def test_grouped_lookup_equals_per_date_window(spark, seed, n, group_rows):
    """H6: windows and ranges per (date, card) give the same transfers as the
    reference's single window per date ordered by card and time."""
    df = T.repair_journeys(journeys(spark, _random_rows(seed, n)), JourneyConfig())
    def labels(out):
        return sorted(((r.JRNY_ID, r.TS_TYP_CD, r.TAG2_TM, r.JS_DURN_SEC, r.IMTT_DESC) for r in out.collect()),
                      key=repr)

    ours = labels(T.detect_transfers(T.previous_trip(df, group_rows=group_rows)))
    ref = labels(T.detect_transfers(T.previous_trip_by_day(df)))
    assert ours == ref


def test_filter_stays_above_window(spark):
    df = T.clean_journeys(journeys(spark, [{}]), JourneyConfig())
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # JS_DURN_SEC > 0 is applied after the Window, not pushed below it
    first_window = next(i for i, ln in enumerate(lines) if "Window [" in ln)
    above = [ln for ln in lines[:first_window] if "Filter" in ln and "JS_DURN_SEC" in ln and "> 0" in ln]
    below = [ln for ln in lines[first_window:] if "Filter" in ln and "JS_DURN_SEC" in ln and "> 0)" in ln]
    assert above and not below


def test_unknown_reports_keep_raw_tag_off_date(spark):
    df = journeys(spark, [{"TS_TYP_CD": "UNKNOWN", "TAG2_DT_FK": -1}, {"TAG1_DT_FK": -1, "TAG2_DT_FK": 20160807}])
    out = T.clean_unknown(df)
    assert sorted(r.TAG2_DT_FK for r in out.collect()) == [-1, 20160807]
    wk = C.day_class_filter(out, "weekday", "TAG2_DT_FK")
    assert [r.TAG2_DT_FK for r in wk.collect()] == [-1]


def test_tied_trips_are_deterministic(spark):
    # two trips with the same card, time and id but other modes: the later
    # trip must see the last of them in one fixed order, whatever the ranges
    rows = [
        {"CARD_FK": 9, "JRNY_ID": 5, "TS_TYP_CD": "Train", "TAG1_TM": "08:00:00", "TAG2_TM": "08:05:00"},
        {"CARD_FK": 9, "JRNY_ID": 5, "TS_TYP_CD": "Bus", "TAG1_TM": "08:00:00", "TAG2_TM": "08:06:00"},
        {"CARD_FK": 9, "JRNY_ID": 6, "TS_TYP_CD": "Ferry", "TAG1_TM": "08:10:00", "TAG2_TM": "08:30:00"},
    ]
    outs = []
    for kw in ({}, {"group_rows": 1}, {"group_rows": 3}):
        df = T.detect_transfers(T.previous_trip(journeys(spark, rows), **kw))
        outs.append(sorted((r.JRNY_ID, r.TS_TYP_CD, r.IMTT_DESC) for r in df.collect()))
    # order among the tie: (Bus, ...) < (Train, ...), so Train is last before the ferry
    assert outs[0] == [(5, "Bus", NO), (5, "Train", "Bus to train"), (6, "Ferry", "Train to ferry")]
    assert outs[0] == outs[1] == outs[2]


def test_a_sentinel_card_with_junk_times_spreads_over_ranges(spark):
    """A third of all trips on one card and day, most without a usable time:
    no task holds the card's trips, and every one finds its previous trip."""
    n = 3_000
    trips = spark.range(n).select(
        F.col("id").alias("JRNY_ID"), F.lit(20160801).alias("TAG1_DT_FK"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900 + 100).alias("CARD_FK"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("UNKNOWN")).alias("TAG1_TM"),
        F.concat(F.lit("m"), F.col("id")).alias("TS_TYP_CD"), F.lit(20160801).alias("TAG2_DT_FK"),
        F.lit("08:00:00").alias("TAG2_TM"), F.lit(60).alias("JS_DURN_SEC"))
    out = T.previous_trip(trips, group_rows=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "__range" in plan  # the card's day is in no window over (date, card)
    got = {r["JRNY_ID"]: r["PREV_TS_TYP_CD"] for r in out.collect()}
    want = {r["JRNY_ID"]: r["PREV_TS_TYP_CD"] if r["PREV_CARD_FK"] is not None else None for r in T.previous_trip_by_day(trips).collect()}
    assert got == want and sum(v is not None for v in got.values()) > n / 3 - 10


def test_ranges_hold_equal_rows_apart_and_hand_over_across_empty_ones(spark):
    rows = spark.range(200).select(F.lit("k").alias("k"), F.lit(1).alias("t"), F.lit("v").alias("v"))
    out = by_ranges(rows, ["k"], ["t", "v"], ["v"], "prev", ranges=16)
    assert sorted((r["prev"] is None) for r in out.collect()).count(True) == 1
    few = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 2, "w"), ("b", 0, "q")], "k string, t int, v string")
    got = {(r["k"], r["t"]): r["prev"]["v"] if r["prev"] else None for r in by_ranges(few, ["k"], ["t"], ["v"], "prev", ranges=9).collect()}
    assert got == {("a", 1): None, ("a", 2): "x", (None, 1): None, (None, 2): None, ("b", 0): None}
    none = by_ranges(few.where("false"), ["k"], ["t"], ["v"], "prev")
    assert none.collect() == [] and none.columns == ["k", "t", "v", "prev"]
