"""The fused report plan equals running each report on its own, and the
report partitions hold (peak + off-peak + null = total, day classes)."""

import pytest
from conftest import SF0001

from faretrail.config import JourneyConfig
from faretrail.operators import aggregates as A
from faretrail.plans import journey_reports as JR
from faretrail.sources import adapters as AD

CFG = JourneyConfig.for_test_events()


@pytest.fixture(scope="module")
def suite(spark):
    return JR.JourneySuite(AD.journeys(spark, SF0001), CFG)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("report", JR.REPORTS, ids=lambda r: r.key)
def test_fused_equals_direct(spark, suite, report):
    direct = JR.report_df(report, suite.bases[report.base], CFG)
    fused = suite.report(report.key)
    assert sorted(direct.columns) == sorted(fused.columns)
    cols = direct.columns
    assert _rows(direct.select(*cols)) == _rows(fused.select(*cols))


def test_peak_split_partitions_total(suite):
    j = suite.bases["journey"]
    fused = A.peak_split_count(j, ["TAG1_TS_NM"]).collect()
    for r in fused:
        assert r.off_peak + r.peak <= r.total
    assert sum(r.total for r in fused) == j.count()


def test_day_classes_partition_dated_rows(suite):
    fam = suite.family("dep").collect()
    for r in fam:
        assert r.sunday1 + r.saturday1 + r.weekday1 == r["all"]


def test_materialized_suite_matches(spark):
    lazy = JR.JourneySuite(AD.journeys(spark, SF0001), CFG)
    mat = JR.JourneySuite(AD.journeys(spark, SF0001), CFG, materialize_bases=True)
    for key in ("r13_departure_intermodal", "r30_average_duration", "r47_offpeak_kpis", "r41_unknown_card_sunday"):
        a, b = lazy.report(key), mat.report(key)
        assert _rows(a) == _rows(b.select(*a.columns)), key


def test_kpis_on_empty_input(spark):
    j = JR.JourneySuite(AD.journeys(spark, SF0001).limit(0), CFG)
    r = j.report("r48_peak_kpis").collect()
    assert len(r) == 1 and r[0].TOTAL_PEAK_TRIPS == 0 and r[0].TOTAL_FARE_PAID is None


def test_document_lines_equal_per_report_json(spark, suite):
    from faretrail import sinks

    docs = {r.name: suite.report(r.key) for r in JR.REPORTS if r.sink in ("info_json", "console")}
    want = sorted(tuple(r) for r in sinks.report_lines(docs).collect())
    got = sorted(tuple(r) for r in suite.document_lines().collect())
    assert got == want


def test_journey_job_writes_documents(spark, tmp_dir):
    import json
    import os

    from helpers import document

    from faretrail.plans.jobs import journey_job

    out = journey_job(AD.journeys(spark, SF0001), os.path.join(tmp_dir, "out"), CFG)
    folder = os.path.join(out["documents"], "report=departureIntermodal")
    direct = JR.JourneySuite(AD.journeys(spark, SF0001), CFG).report("r13_departure_intermodal")
    assert sorted(json.dumps(x, sort_keys=True) for x in document(folder)) == sorted(
        json.dumps(r.asDict(), sort_keys=True) for r in direct.collect())
    assert os.path.isdir(out["timeStation"]) and os.path.isdir(out["timeMode"])


def test_close_deletes_written_tables(spark):
    import os

    suite = JR.JourneySuite(AD.journeys(spark, SF0001), CFG, materialize_bases=True)
    dirs = [p.replace("file:", "") for p in suite._written]
    assert dirs and all(os.path.isdir(d) for d in dirs)
    suite.report("r01_departure").collect()
    suite.close()
    assert not any(os.path.exists(d) for d in dirs)


def test_dayofweek_rule_on_test_calendar(spark):
    """The test data's listed Sundays/Saturdays are real Sundays/Saturdays,
    so both rules agree except on dates outside the lists."""
    from dataclasses import replace

    dow = replace(CFG, day_rule="dayofweek")
    a = JR.JourneySuite(AD.journeys(spark, SF0001), CFG).report("r21_departure_sunday")
    b = JR.JourneySuite(AD.journeys(spark, SF0001), dow).report("r21_departure_sunday")
    assert _rows(a) == _rows(b.select(*a.columns))
