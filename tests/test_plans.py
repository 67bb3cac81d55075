"""Plan shape: pushdown, pruning, one full-width shuffle, no extra shuffle
for inputs that are already split."""

import os

import pytest
from conftest import SF0001

from pyspark.sql import functions as F

from faretrail.config import JourneyConfig
from faretrail.operators import aggregates as A
from faretrail.operators import transfers as T
from faretrail.plans import journey_reports as JR
from faretrail.sources import adapters as AD
from faretrail.sources.parallel import ensure_parallelism

CFG = JourneyConfig.for_test_events()


def _plan(df):
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def journey_parquet(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("j") / "journey")
    AD.journeys(spark, SF0001).write.parquet(p)
    return p


def test_filters_reach_the_scan(spark, journey_parquet):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = T.clean_journeys(T.select_journeys(spark.read.parquet(journey_parquet), CFG), CFG)
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "PushedFilters: [IsNotNull(TAG1_DT_FK), IsNotNull(TS_TYP_CD)" in plan
    assert "Not(EqualTo(TS_TYP_CD,UNKNOWN))" in plan
    # exactly one exchange carries whole journey rows: the card-day window's
    full_width = [ln for ln in plan.split("\n")
                  if ln.startswith("Arguments: hashpartitioning(TAG1_DT_FK") and "__salt" in ln]
    assert len(full_width) == 1


def _read_schemas(df):
    return [ln.split("ReadSchema: ")[1] for ln in _plan(df).split("\n") if "ReadSchema" in ln]


def _scans(df, folder):
    return sum(folder in ln for ln in _plan(df).split("\n") if ln.startswith("Location: "))


def test_all_reports_scan_the_cleaned_table_once(spark):
    suite = JR.JourneySuite(AD.journeys(spark, SF0001), CFG, materialize_bases=True)
    df, measures = suite._measured("journey")
    fused = A.grouping_sets(df, JR.JOURNEY_SETS, measures)
    assert _scans(fused, "/journey-") == 1 and "Expand" in _plan(fused)
    (schema,) = _read_schemas(fused)
    assert {f.split(":")[0] for f in schema[len("struct<"):-1].split(",")} < set(suite.bases["journey"].columns)
    # the reports read the written key sets, each only its own set and columns
    lines = suite.document_lines()
    assert _scans(lines, "/journey-sets-") > 0 and _scans(lines, "/journey-") == _scans(lines, "/journey-sets-")
    assert _scans(lines, "/unknowns-") == _scans(lines, "/unknowns-sets-")
    assert _read_schemas(suite.report("r18_passenger")) == ["struct<PSNGR_TYP_CD:string,all:bigint>"]
    assert "PartitionFilters: [isnotnull(key_set" in _plan(suite.report("r18_passenger"))
    suite.close()


def test_grouping_sets_keep_null_keys_apart(spark):
    rows = spark.createDataFrame([(None, "x"), (None, None), ("a", None), ("a", "x")], "k string, l string")
    sets = {"both": ["k", "l"], "one": ["k"], "none": []}
    out = A.grouping_sets(rows, sets, [F.count(F.lit(1)).alias("n")])
    got = lambda name: sorted(map(tuple, A.set_rows(out, name, sets).collect()), key=str)
    assert got("both") == sorted([(None, "x", 1), (None, None, 1), ("a", None, 1), ("a", "x", 1)], key=str)
    assert got("one") == sorted([(None, 2), ("a", 2)], key=str) and got("none") == [(4,)]
    with pytest.raises(ValueError):
        A.grouping_sets(rows, {"a": ["k"], "b": ["k"]}, [])


@pytest.mark.parametrize("key", ["r18_passenger", "r20_transport_mode", "r43_time_mode", "r45_time_station"])
def test_single_report_is_one_aggregate(spark, journey_parquet, key):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report = JR.BY_KEY[key]
        base = spark.read.parquet(journey_parquet)  # stands for a written cleaned table
        plan = _plan(JR.report_df(report, base, CFG))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(ln.startswith("Arguments: hashpartitioning") for ln in plan.split("\n")) == 1


def test_ensure_parallelism_only_spreads_small_splits(spark, tmp_dir):
    one = spark.read.parquet(os.path.join(SF0001, "events.parquet"))
    assert one.rdd.getNumPartitions() == 1
    assert ensure_parallelism(one, 4).rdd.getNumPartitions() == 4
    many = spark.range(0, 1000, 1, 8)
    same = ensure_parallelism(many, 4)
    assert same is many


def test_shuffle_partitions_follow_input_size(spark, tmp_dir):
    from faretrail.session import input_bytes, size_shuffle_partitions

    for i in range(3):
        with open(os.path.join(tmp_dir, f"f{i}.csv"), "w") as f:
            f.write("x" * 1000)
    assert input_bytes(spark, os.path.join(tmp_dir, "*.csv")) == 3000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffle_partitions(spark, 100 * 2**40) == 409_600  # 100 TB: no ceiling
        assert size_shuffle_partitions(spark, 10 * 2**30) == 40
        assert size_shuffle_partitions(spark, 10, floor=3) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
