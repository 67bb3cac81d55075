"""The three applications from delimited files on disk, through the CLI entry."""

import glob
import os

from conftest import SF0001
from helpers import document

from faretrail.plans import jobs
from faretrail.plans import journey_reports as JR
from faretrail.schemas import SURVEY_QUESTION_COLUMNS
from faretrail.sources import adapters as AD


def test_journey_cli_from_csv(spark, tmp_dir):
    src = os.path.join(tmp_dir, "Journey")
    # journeys as the operator delivers them: '|' text files with a header, two files
    AD.journeys(spark, SF0001).repartition(2).write.option("header", True).option("sep", "|").csv(src)
    out = os.path.join(tmp_dir, "out")
    jobs.main(["journey", "--input", os.path.join(src, "*.csv"), "--out", out])
    # the default calendar is the reference's; the report itself does not depend on it
    doc = document(os.path.join(out, "documents", "report=transportMode"))
    want = JR.JourneySuite(AD.journeys(spark, SF0001)).report("r20_transport_mode").collect()
    assert sorted((d["TS_TYP_CD"], d["count"]) for d in doc) == sorted((r.TS_TYP_CD, r["count"]) for r in want)
    assert glob.glob(os.path.join(out, "timeStation.csv", "part-*"))


def test_survey_cli_from_csv(spark, tmp_dir):
    answers = AD.survey(spark, SF0001)
    # raw file: 24 columns, the script drops positions 1, 7, 8, 9 and 23
    q = list(SURVEY_QUESTION_COLUMNS)
    raw_cols = ["id"] + q[:5] + ["u7", "u8", "u9"] + q[5:18] + ["u23", "Q12"]
    from pyspark.sql import functions as F

    raw = answers.select(
        F.monotonically_increasing_id().alias("id"), *[F.col(c) for c in q[:5]],
        F.lit(0).alias("u7"), F.lit(0).alias("u8"), F.lit(0).alias("u9"),
        *[F.col(c) for c in q[5:18]], F.lit(0).alias("u23"), F.col("Q12"))
    assert raw.columns == raw_cols
    src = os.path.join(tmp_dir, "survey")
    raw.coalesce(1).write.option("header", True).csv(src)
    out = os.path.join(tmp_dir, "out")
    jobs.main(["survey", "--input", glob.glob(os.path.join(src, "*.csv"))[0], "--out", out])
    cov = spark.read.parquet(os.path.join(out, "results", "covariance"))
    assert cov.where("block = 'Q9'").count() == 21 and cov.where("block = 'Q10'").count() == 15
    boxes = spark.read.parquet(os.path.join(out, "results", "box_by_occupation"))
    assert boxes.select("rating").distinct().count() == 14
    assert boxes.where("aspect = 'Toilet fac.'").count() == 9
    tables = {t: spark.read.parquet(os.path.join(out, "results", t)) for t in ("data", "commuters", "melt_q9", "melt_q10")}
    n = tables["commuters"].count()
    assert 0 < n < tables["data"].count() and tables["melt_q9"].count() == 7 * n
    assert tables["commuters"].where("Q12 = 'Average'").count() > 0
    assert spark.read.parquet(os.path.join(out, "results", "box_outliers")).count() > 0
    lines = open(glob.glob(os.path.join(out, "Q9_cov.csv", "part-*"))[0]).read().splitlines()
    assert lines[0] == "row,col1,col2,covariance" and lines[1].startswith("1,Q9_A,Q9_B,")


def test_cards_cli_from_manifest(spark, tmp_dir):
    cards = AD.cards(spark, SF0001)
    months = [r.snapshot_date for r in cards.select("snapshot_date").distinct().orderBy("snapshot_date").limit(3).collect()]
    paths = []
    for m in months:
        p = os.path.join(tmp_dir, f"tmp_{m:%Y%m%d}")
        (cards.where(F_eq(m)).drop("snapshot_date").coalesce(1)
         .write.option("header", True).option("sep", "|").csv(p))
        named = os.path.join(tmp_dir, f"0{len(paths) + 1}_{m:%Y%m%d}_Cards.csv")
        with open(glob.glob(os.path.join(p, "*.csv"))[0]) as fi, open(named, "w") as fo:
            fo.write(fi.read())
        paths.append(named)
    man = os.path.join(tmp_dir, "manifest", "01_Cards.csv")
    os.makedirs(os.path.dirname(man))
    with open(man, "w") as f:
        f.write('"","x"\n' + "".join(f'"{i}","{p}"\n' for i, p in enumerate(paths, 1)))
    out = os.path.join(tmp_dir, "out")
    jobs.main(["cards", "--manifest", man, "--out", out])
    data = document(out + "/dataCount.json")
    counts = [d["cardCount"] for d in data]
    assert counts == sorted(counts) and len(counts) == 3
    assert sorted(d["date"] for d in data) == sorted(f"{m:%d-%b-%Y}" for m in months)
    assert sum(counts) == cards.where(cards.snapshot_date.isin(months)).count()


def F_eq(m):
    from pyspark.sql import functions as F

    return F.col("snapshot_date") == F.lit(m)
