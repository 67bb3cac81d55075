"""Dated landing, file ledger, calendar, level table and wide covariance."""

import os

import numpy as np
import pytest
from helpers import journeys
from pyspark.sql import functions as F

from faretrail.config import JourneyConfig
from faretrail.operators import cleaning as C
from faretrail.operators import survey as S
from faretrail.operators import transfers as T
from faretrail.operators.calendar import calendar_days, listed_days, on_days, with_day_class
from faretrail.operators.levels import encode_by_table, labelled_levels, level_table
from faretrail.operators.moments import pair_sums, wide_covariance
from faretrail.sources.landing import clean_days, land_journeys, landed_journeys
from faretrail.sources.ledger import CardLedger
from faretrail.sources.snapshots import read_card_snapshots

HEADER = "CARD_TYP_CD|DISC_ENT_DESC|PSNGR_TYP_DESC|CARD_STAT_CD\n"


def _days(n):
    return [{"CARD_FK": i % 5, "TAG1_DT_FK": 20160801 + i % 3, "TAG2_DT_FK": 20160801 + i % 3, "TS_TYP_CD": ["Bus", "Ferry"][i % 2],
             "TAG1_TM": f"{8 + i // 20:02d}:{i % 20:02d}:00"} for i in range(n)]


def test_a_new_day_lands_without_touching_the_others(spark, tmp_dir):
    folder, cfg = os.path.join(tmp_dir, "landing"), JourneyConfig()
    raw = journeys(spark, _days(90))
    land_journeys(raw.where("TAG1_DT_FK < 20160803"), folder, cfg)
    before = {f: os.stat(os.path.join(folder, "TAG1_DT_FK=20160801", f)).st_mtime_ns for f in os.listdir(os.path.join(folder, "TAG1_DT_FK=20160801"))}
    for _ in range(2):  # landing a day again replaces it
        land_journeys(raw.where("TAG1_DT_FK = 20160803"), folder, cfg, files_per_day=4)
    after = {f: os.stat(os.path.join(folder, "TAG1_DT_FK=20160801", f)).st_mtime_ns for f in os.listdir(os.path.join(folder, "TAG1_DT_FK=20160801"))}
    assert before == after
    assert landed_journeys(spark, folder).count() == 90
    day = landed_journeys(spark, folder, [20160803])
    plan = spark._jvm.PythonSQLUtils.explainString(day._jdf.queryExecution(), "formatted")
    filters = [ln for ln in plan.split("\n") if ln.startswith("PartitionFilters: ")]
    assert len(filters) == 1 and "20160803" in filters[0]
    key = lambda df: sorted(map(str, df.collect()))
    whole = T.clean_journeys(T.select_journeys(raw, cfg), cfg).where("TAG1_DT_FK <> 20160802")
    assert key(clean_days(spark, folder, [20160801, 20160803], cfg)) == key(whole)


def _card_file(folder, day, rows):
    path = os.path.join(folder, f"cards_{day}_Cards.csv")
    with open(path, "w") as f:
        f.write(HEADER + "".join("|".join(r) + "\n" for r in rows))
    return path


def test_only_new_and_changed_files_are_counted(spark, tmp_dir):
    adult, child = ("Adult", "No DE", "Adult", "ISSUED"), ("Child/Youth", "No DE", "Adult", "ISSUED")
    paths = [_card_file(tmp_dir, "20160801", [adult] * 3 + [child]), _card_file(tmp_dir, "20160808", [])]
    ledger = CardLedger(spark, os.path.join(tmp_dir, "ledger"))

    def full():
        cards = T.clean_cards(read_card_snapshots(spark, paths, keep_file=True))
        return sorted(tuple(r) for r in cards.groupBy("snapshot_date", "CARD_TYP_CD").count().collect())

    def kept():
        return sorted((r.snapshot_date, r.CARD_TYP_CD, r.typeCount) for r in ledger.card_count(paths).collect())

    assert kept() == full() and ledger.update(paths) == []  # an empty file is not read again either
    paths.append(_card_file(tmp_dir, "20160815", [child] * 2))
    assert [os.path.basename(p) for p in ledger.update(paths)] == ["cards_20160815_Cards.csv"]
    assert kept() == full()
    _card_file(tmp_dir, "20160801", [adult] * 5)  # grown since: counted anew, the old entry no longer counts
    assert [os.path.basename(p) for p in ledger.update(paths)] == ["cards_20160801_Cards.csv"]
    assert kept() == full()
    counts = {r.snapshot_date.isoformat(): r.cardCount for r in ledger.data_count(paths).collect()}
    assert counts == {"2016-08-01": 5, "2016-08-08": 0, "2016-08-15": 2}
    assert {r.cardCount for r in ledger.data_count(paths[1:2]).collect()} == {0}  # only the listed files


def test_calendar_equals_listed_dates(spark):
    cfg = JourneyConfig()
    df = journeys(spark, [{"TAG1_DT_FK": d} for d in (None, -1, 20160806, 20160807, 20160808, 20160814, *cfg.sundays, *cfg.saturdays)])
    days = listed_days(spark, cfg)
    ids = lambda x: sorted(r.JRNY_ID for r in x.collect())
    for kind in ("sunday", "saturday"):
        assert ids(on_days(df, days.where(F.col("day_class") == kind))) == ids(C.day_class_filter(df, kind, cfg=cfg))
    assert ids(on_days(df, days, exclude=True)) == ids(C.day_class_filter(df, "weekday", cfg=cfg))
    classed = with_day_class(df, days)
    for kind in ("sunday", "saturday", "weekday"):
        assert ids(classed.where(F.col("day_class") == kind)) == ids(C.day_class_filter(df, kind, cfg=cfg))
    assert classed.where("day_class is null").count() == 1 and classed.count() == df.count()


def test_a_calendar_of_decades_agrees_with_the_day_of_week(spark):
    days = calendar_days(spark, "1990-01-01", "2040-01-01")
    assert days.count() == 18_263
    df = journeys(spark, [{"TAG1_DT_FK": int(f"2016{m:02d}{d:02d}")} for m in range(1, 13) for d in range(1, 29)])
    rule = JourneyConfig(day_rule="dayofweek")
    for kind in ("sunday", "saturday", "weekday"):
        got = on_days(df, days.where(F.col("day_class") == kind))
        assert got.count() == C.day_class_filter(df, kind, cfg=rule).count() > 40
    assert "BroadcastHashJoin" in spark._jvm.PythonSQLUtils.explainString(on_days(df, days)._jdf.queryExecution(), "simple")


def test_a_hundred_thousand_levels(spark):
    n = 100_000
    df = spark.range(2 * n).select((F.col("id") % n * 7 - 3).alias("q"), (F.col("id") % 3).cast("int").alias("r")).withColumn(
        "q", F.when(F.col("q") != 4, F.col("q")))
    levels = level_table(df, ["q", "r"], limit=20_000)  # q takes the ranges, r too
    got = {(r["col"], r["code"]): r["level"] for r in levels.collect()}
    codes = sorted(x * 7 - 3 for x in range(n) if x * 7 - 3 != 4)
    assert got == {("q", c): i for i, c in enumerate(codes, 1)} | {("r", i): i + 1 for i in range(3)}
    labels = levels.select("col", "level", F.concat("col", "level").alias("label"))
    out = encode_by_table(df, labelled_levels(levels, labels), ["q", "r"])
    assert out.where("q is null").count() == 2 and out.select("q").distinct().count() == n
    short = labels.where("not (col = 'r' and level = 3)")
    with pytest.raises(Exception, match="r: 3 distinct codes for 2 labels"):
        labelled_levels(levels, short).collect()


def test_wide_covariance_of_300_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 1000, size=(400, 300))
    cols = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{c} int" for c in cols)).repartition(3)
    got = {(r.col1, r.col2): r.covariance for r in wide_covariance(df, cols).collect()}
    want = np.cov(x, rowvar=False, ddof=1)
    assert len(got) == 300 * 299 // 2
    assert max(abs(v - want[int(a[1:]), int(b[1:])]) for (a, b), v in got.items()) < 1e-6


def test_wide_covariance_with_nulls_equals_the_narrow_one(spark):
    rows = [(1, 2, None, 4), (2, 5, 3, 1 << 40), (3, 1, 8, -(1 << 40)), (4, None, 9, 5), (9, 7, 7, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d long")
    for use in ("everything", "pairwise"):
        narrow = {(r.col1, r.col2): r.covariance for r in S.pairwise_covariance(df.select("a", "b", "c"), ["a", "b", "c"], use).collect()}
        wide = {(r.col1, r.col2): r.covariance for r in wide_covariance(df, ["a", "b", "c"], use).collect()}
        assert narrow == wide
    with pytest.raises(Exception, match="do not fit 64 bits"):
        pair_sums(df, ["a", "d"]).collect()
    assert all(r.covariance is None for r in wide_covariance(df.where("false"), ["a", "b", "c"]).collect())


def test_wide_covariance_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cols = [f"c{k}" for k in range(60)]
    wide = spark.range(1_000).selectExpr(*[f"IF(id % 7 = 0 AND {k} = 3, NULL, CAST(id * {k + 3} % {k + 5} AS INT)) AS c{k}" for k in range(60)])
    df = wide.mapInArrow(counted, wide.schema)
    got = {(r.col1, r.col2): r.covariance for r in wide_covariance(df, cols).collect()}
    assert seen.value == 1_000
    x = np.array([[i * (k + 3) % (k + 5) for k in range(60)] for i in range(1_000)])
    want = np.cov(x, rowvar=False, ddof=1)
    assert len(got) == 60 * 59 // 2
    for (a, b), v in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert (v is None) if 3 in (i, j) else abs(v - want[i, j]) < 1e-9


def test_wide_rows_are_computed_by_compiled_code(spark):
    from faretrail.session import compiled_projections

    key, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    limits = []
    with compiled_projections(spark):
        limits.append(spark.conf.get(key))
        with pytest.raises(ZeroDivisionError), compiled_projections(spark):
            limits.append(spark.conf.get(key))
            1 / 0
    assert [int(x) <= 8000 for x in limits] == [True, True] and spark.conf.get(key) == before
