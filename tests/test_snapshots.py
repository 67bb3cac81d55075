"""Card snapshot files on disk: manifest, dates from file names, one scan,
empty files counted as 0, latest snapshot."""

import os

import pytest
from helpers import document

from faretrail.operators.aggregates import rows_per_snapshot
from faretrail.plans.jobs import card_job
from faretrail.sources.snapshots import latest_snapshot, read_card_snapshots, read_manifest, snapshot_text

HEADER = "CARD_TYP_CD|DISC_ENT_DESC|PSNGR_TYP_DESC|CARD_STAT_CD\n"


def _write(path, rows):
    with open(path, "w") as f:
        f.write(HEADER + "".join("|".join(r) + "\n" for r in rows))


def _fixture(tmp_dir):
    files = {
        "20160801": [("Adult", "No DE", "Adult", "ISSUED"), ("Sgl Trip Rail Adult", "No DE", "Adult", "BLOCKED"),
                     ("UNKNOWN", "No DE", "Adult", "ISSUED")],
        "20160808": [("Child/Youth", "No DE", "Adult", "ISSUED")],
        "20160815": [],  # header only
    }
    paths = []
    for d, rows in files.items():
        p = os.path.join(tmp_dir, f"cards_{d}_Cards.csv")
        _write(p, rows)
        paths.append(p)
    man = os.path.join(tmp_dir, "01_Cards.csv")
    with open(man, "w") as f:
        f.write('"","x"\n' + "".join(f'"{i}","{p}"\n' for i, p in enumerate(paths, start=1)))
    return paths, man


def test_manifest_and_one_scan(spark, tmp_dir):
    paths, man = _fixture(tmp_dir)
    assert read_manifest(spark, man) == paths
    df = read_card_snapshots(spark, paths)
    got = sorted((r.d, r.n) for r in df.groupBy(snapshot_text().alias("d")).count().withColumnRenamed(
        "count", "n").collect())
    assert got == [("01-Aug-2016", 3), ("08-Aug-2016", 1)]
    latest = latest_snapshot(df).collect()
    assert [r.CARD_TYP_CD for r in latest] == ["Child/Youth"]


def test_card_job_counts_empty_files(spark, tmp_dir):
    paths, man = _fixture(tmp_dir)
    out = card_job(spark, read_manifest(spark, man), os.path.join(tmp_dir, "out"))
    data = document(out["dataCount"])
    # ordered by count ascending (O1)
    assert [(d["date"], d["cardCount"]) for d in data] == [
        ("15-Aug-2016", 0), ("08-Aug-2016", 1), ("01-Aug-2016", 3)]
    cards = document(out["cardCount"])
    # ordered by date text, then type (O2)
    assert [(d["date"], d["type"], d["typeCount"]) for d in cards] == [
        ("01-Aug-2016", "Adult", 2), ("01-Aug-2016", "Sgl Trip Ticket", 1), ("08-Aug-2016", "Child/Youth", 1)]


def test_two_files_of_one_date_are_two_entries(spark, tmp_dir):
    d1, d2 = os.path.join(tmp_dir, "a b"), os.path.join(tmp_dir, "c")
    os.makedirs(d1)
    os.makedirs(d2)
    p1, p2 = os.path.join(d1, "x_20160801_Cards.csv"), os.path.join(d2, "x_20160801_Cards.csv")
    _write(p1, [("Adult", "No DE", "Adult", "ISSUED")])
    _write(p2, [("Adult", "No DE", "Adult", "ISSUED"), ("Adult", "No DE", "Adult", "ISSUED")])
    out = card_job(spark, [p1, p2], os.path.join(tmp_dir, "out"))
    data = document(out["dataCount"])
    assert [(d["date"], d["cardCount"]) for d in data] == [("01-Aug-2016", 1), ("01-Aug-2016", 2)]


def test_paths_without_scheme_relative_and_with_odd_names(spark, tmp_dir):
    odd = os.path.join(tmp_dir, "a b+c%20d")
    os.makedirs(odd)
    one, two, three = (os.path.join(odd, f"x_2016080{i}_Cards.csv") for i in (1, 2, 3))
    row = ("Adult", "No DE", "Adult", "ISSUED")
    _write(one, [row])
    _write(two, [row] * 2)
    _write(three, [row] * 3)
    out = card_job(spark, [one, "file:" + two, os.path.relpath(three)], os.path.join(tmp_dir, "out"))
    assert [d["cardCount"] for d in document(out["dataCount"])] == [1, 2, 3]


def test_unlisted_snapshot_raises(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "f string")
    listed = spark.createDataFrame([("a",), ("c",)], "f string")
    assert sorted(map(tuple, rows_per_snapshot(rows.where("f = 'a'"), "f", expected=listed).collect())) == [("a", 1), ("c", 0)]
    with pytest.raises(Exception, match="not listed: b"):
        rows_per_snapshot(rows, "f", expected=listed).collect()
