"""Row-level tests of every cleaning rule, with null and sentinel cases."""

from helpers import by_id, journeys

from faretrail.config import JourneyConfig
from faretrail.operators import cleaning as C
from faretrail.operators import transfers as T


def test_known_and_unknown_trips_keep_three_valued_logic(spark):
    df = journeys(spark, [
        {},                                            # 1 known
        {"TS_TYP_CD": None},                           # 2 neither (null mode)
        {"TAG1_DT_FK": None},                          # 3 neither (null date)
        {"TS_TYP_CD": "UNKNOWN"},                      # 4 unknown
        {"TAG1_DT_FK": -1},                            # 5 unknown
        {"TS_TYP_CD": "UNKNOWN", "TAG1_DT_FK": -1},    # 6 unknown
        {"TS_TYP_CD": None, "TAG1_DT_FK": -1},         # 7 unknown (other arm true)
    ])
    known = {r.JRNY_ID for r in C.known_trips(df).collect()}
    unknown = {r.JRNY_ID for r in C.unknown_trips(df).collect()}
    assert known == {1}
    assert unknown == {4, 5, 6, 7}


def test_exclude_dates_drops_null_dates_too(spark):
    df = journeys(spark, [{"TAG1_DT_FK": 20160718}, {"TAG1_DT_FK": None}, {}])
    assert [r.JRNY_ID for r in C.exclude_dates(df, [20160718]).collect()] == [3]


def test_discount_then_card_type(spark):
    df = journeys(spark, [
        {"DISC_ENT_DESC": "No DE", "CARD_TYP_CD": "UNKNOWN"},
        {"DISC_ENT_DESC": "Concession", "CARD_TYP_CD": "UNKNOWN"},
        {"DISC_ENT_DESC": "No DE", "CARD_TYP_CD": "UNKNOWN-X"},
        {"DISC_ENT_DESC": None, "CARD_TYP_CD": "UNKNOWN"},
    ])
    j = C.infer_card_type(C.normalise_discount(df), "journey")
    assert by_id(j, "DISC_ENT_DESC") == {1: "No Discount", 2: "Concession", 3: "No Discount", 4: None}
    # journey mode: substring replace, only without discount
    assert by_id(j, "CARD_TYP_CD") == {1: "Adult", 2: "UNKNOWN", 3: "Adult-X", 4: "UNKNOWN"}
    u = C.infer_card_type(C.normalise_discount(df), "unknown")
    assert by_id(u, "CARD_TYP_CD") == {1: "Adult", 2: "Concession", 3: "Adult-X", 4: "UNKNOWN"}
    c = C.infer_card_type(C.normalise_discount(df), "card")
    assert by_id(c, "CARD_TYP_CD") == {1: "Adult", 2: "UNKNOWN", 3: "UNKNOWN-X", 4: "UNKNOWN"}


def test_fold_single_trip_needs_two_words(spark):
    df = journeys(spark, [
        {"CARD_TYP_CD": "Sgl Trip Rail Adult"},
        {"CARD_TYP_CD": "Sgl Trip Rail Child/Youth x"},
        {"CARD_TYP_CD": "Sgl Trip Rail"},
        {"CARD_TYP_CD": None},
    ])
    out = by_id(C.fold_single_trip(df), "CARD_TYP_CD")
    assert out == {1: "Sgl Trip Ticket", 2: "Sgl Trip Ticket", 3: "Sgl Trip Rail", 4: None}


def test_fold_to_allowed_keeps_null(spark):
    allowed = JourneyConfig().allowed_card_types
    df = journeys(spark, [{"CARD_TYP_CD": t} for t in allowed] + [{"CARD_TYP_CD": "UNKNOWN"}, {"CARD_TYP_CD": None}])
    out = by_id(C.fold_to_allowed(df), "CARD_TYP_CD")
    n = len(allowed)
    assert [out[i + 1] for i in range(n)] == list(allowed)
    assert out[n + 1] == "Sgl Trip Ticket"
    assert out[n + 2] is None


def test_card_rules(spark):
    rows = [
        ("Child/Youth", "No DE", "Adult", "HOTLISTED"),
        ("Child/Youth", "Concession", "Adult", "ISSUED"),
        ("Adult", "No DE", "Adult", None),
        ("UNKNOWN", "No DE", "Adult", "EXPIRED"),
    ]
    df = spark.createDataFrame(rows, "CARD_TYP_CD string, DISC_ENT_DESC string, PSNGR_TYP_DESC string, CARD_STAT_CD string")
    out = T.clean_cards(df).collect()
    assert [r.PSNGR_TYP_DESC for r in out] == ["Child/Youth", "Adult", "Adult", "Adult"]
    assert [r.CARD_STAT_CD for r in out] == ["TEMPORARY", "ISSUED", None, "TEMPORARY"]
    assert [r.CARD_TYP_CD for r in out] == ["Child/Youth", "Child/Youth", "Adult", "Adult"]


def test_tag_off_imputation_reads_original_date(spark):
    df = journeys(spark, [
        {"TAG2_DT_FK": -1, "TAG2_TM": "UNKNOWN", "TAG2_TS_NM": "UNKNOWN", "TAG2_OFF_PEAK_IND": None},
        {"TAG2_DT_FK": 20160802, "TAG2_TM": "00:10:00"},                  # next day
        {"TAG1_DT_FK": 20160731, "TAG2_DT_FK": 20160801},                # keep date
        {"TAG2_DT_FK": None},
    ])
    out = C.clamp_tag_off_date(C.impute_tag_off(df), [20160731]).collect()
    r1, r2, r3, r4 = out
    assert (r1.TAG2_TM, r1.TAG2_TS_NM, r1.TAG2_LAT_VAL, r1.TAG2_OFF_PEAK_IND, r1.TAG2_DT_FK) == (
        "08:00:00", "A", -33.0, False, 20160801)
    assert (r2.TAG2_DT_FK, r2.TAG2_TM) == (20160801, "00:10:00")
    assert r3.TAG2_DT_FK == 20160801
    assert r4.TAG2_DT_FK is None and r4.TAG2_TM == "08:10:00"


def test_duration_repair(spark):
    df = journeys(spark, [
        {"JS_DURN_SEC": -1},                                              # 600 s from stamps
        {"JS_DURN_SEC": 0},
        {"JS_DURN_SEC": 1},
        {"JS_DURN_SEC": -1, "TAG2_DT_FK": -1, "TAG2_TM": "UNKNOWN"},      # -> 0 -> dropped
        {"JS_DURN_SEC": -1, "TAG2_DT_FK": 20160802, "TAG2_TM": "00:10:00", "TAG1_TM": "23:50:00"},
        {"JS_DURN_SEC": -1, "TAG1_TM": "bad"},                            # unparsable -> null
    ])
    rep = T.repair_journeys(df, JourneyConfig())
    out = by_id(rep, "JS_DURN_SEC")
    # trip past midnight is clamped to the tag-on date: |00:10 - 23:50| = 23h40m
    assert out == {1: 600, 2: 0, 3: 1, 4: 0, 5: 85200, 6: None}
    kept = {r.JRNY_ID for r in C.positive_duration(rep).collect()}
    assert kept == {1, 3, 5}


def test_relabel_transfers(spark):
    labels = ["Bus to train", "Ferry to train", "Light rail to train", "Train to ferry",
              "Train to bus", "Train to light rail", "Bus to ferry", None]
    df = journeys(spark, [{"IMTT_DESC": x} for x in labels])
    out = by_id(C.relabel_transfers(df), "IMTT_DESC")
    assert [out[i + 1] for i in range(len(labels))] == [
        "Bus to rail", "Ferry to rail", "Light rail to rail", "Rail to ferry",
        "Rail to bus", "Rail to light rail", "Bus to ferry", None]


def test_read_by_name_not_position(spark, tmp_dir):
    """H2: a header in another order must not swap columns."""
    import os

    from faretrail.schemas import CARD_SCHEMA
    from faretrail.sources.delimited import read_delimited

    p = os.path.join(tmp_dir, "c.csv")
    with open(p, "w") as f:
        f.write("CARD_STAT_CD|PSNGR_TYP_DESC|CARD_TYP_CD|DISC_ENT_DESC|EXTRA\nISSUED|Adult|Adult|No DE|x\n")
    r = read_delimited(spark, p, CARD_SCHEMA).collect()[0]
    assert (r.CARD_TYP_CD, r.DISC_ENT_DESC, r.PSNGR_TYP_DESC, r.CARD_STAT_CD) == ("Adult", "No DE", "Adult", "ISSUED")


def test_declared_types_survive_bad_values(spark, tmp_dir):
    import os

    from faretrail.schemas import JOURNEY_SCHEMA
    from faretrail.sources.delimited import read_delimited

    names = [f.name for f in JOURNEY_SCHEMA.fields]
    vals = {n: "" for n in names}
    vals.update(CARD_FK="12", JRNY_ID="x7", TAG1_DT_FK="20160801", TAG1_TM="07:30:00", TAG1_OFF_PEAK_IND="true")
    p = os.path.join(tmp_dir, "j.csv")
    with open(p, "w") as f:
        f.write("|".join(names) + "\n" + "|".join(vals[n] for n in names) + "\n")
    r = read_delimited(spark, p, JOURNEY_SCHEMA).collect()[0]
    assert r.CARD_FK == 12 and r.JRNY_ID is None and r.TAG1_TM == "07:30:00"
    assert r.TAG1_DT_FK == 20160801 and r.TAG1_OFF_PEAK_IND is True


def test_day_rules(spark):
    from dataclasses import replace

    df = journeys(spark, [{"TAG1_DT_FK": d} for d in (20160807, 20160806, 20160731, 20160801, -1, None)])
    lists = JourneyConfig()
    dow = replace(lists, day_rule="dayofweek")

    def ids(which, cfg):
        return sorted(r.JRNY_ID for r in C.day_class_filter(df, which, "TAG1_DT_FK", cfg).collect())

    assert (ids("sunday", lists), ids("saturday", lists), ids("weekday", lists)) == ([1], [2], [3, 4, 5])
    # 2016-07-31 is a Sunday by the calendar; -1 has no weekday
    assert (ids("sunday", dow), ids("saturday", dow), ids("weekday", dow)) == ([1, 3], [2], [4])


def test_wrap_midnight_option(spark):
    df = journeys(spark, [{"JS_DURN_SEC": -1, "TAG2_DT_FK": 20160802, "TAG2_TM": "00:10:00", "TAG1_TM": "23:50:00"}])
    df = C.clamp_tag_off_date(df)
    assert by_id(C.repair_duration(df), "JS_DURN_SEC") == {1: 85200}
    assert by_id(C.repair_duration(df, wrap_midnight=True), "JS_DURN_SEC") == {1: 1200}
