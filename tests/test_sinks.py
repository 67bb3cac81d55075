"""Sink round trips: JSON document, delimited file, indexed CSV, Parquet."""

import os

import pytest
from helpers import document

from faretrail import sinks


def _part(path, prefix="part-"):
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith(prefix)]


def test_info_json_round_trip_omits_nulls(spark, tmp_dir):
    df = spark.createDataFrame([("A", 2, None), ("B", 1, 1.5)], "name string, count long, x double")
    p = os.path.join(tmp_dir, "r.json")
    sinks.write_info_json(df, p)
    assert sorted(document(p), key=lambda r: r["name"]) == [{"name": "A", "count": 2}, {"name": "B", "count": 1, "x": 1.5}]


@pytest.fixture()
def many_ranges(spark):
    """Ranges stay apart, so that one report is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_document_of_many_parts_in_order(spark, tmp_dir, many_ranges):
    df = spark.range(1000).selectExpr("id % 7 AS k", "500 - id AS n").repartition(5)
    p = os.path.join(tmp_dir, "r.json")
    sinks.write_info_json(df, p, order_by=["n"])
    assert len(_part(p)) > 1
    assert [r["n"] for r in document(p)] == list(range(-499, 501))


def test_documents_with_an_empty_report_and_equal_rows(spark, tmp_dir, many_ranges):
    same = spark.range(500).selectExpr("1 AS x")
    p = sinks.write_info_documents({"same": same, "none": same.where("x > 1"), "one": same.limit(1)},
                                   os.path.join(tmp_dir, "docs"))
    assert document(os.path.join(p, "report=same")) == [{"x": 1}] * 500
    assert document(os.path.join(p, "report=none")) == []
    assert document(os.path.join(p, "report=one")) == [{"x": 1}]
    # equal rows are dealt over several tasks
    assert len(_part(os.path.join(p, "report=same"))) > 1


def test_undeclared_report_raises(spark, tmp_dir):
    lines = spark.createDataFrame([("a", "{}"), ("b", "{}")], "report string, line string")
    with pytest.raises(Exception, match="undeclared report"):
        sinks.write_documents_from_lines(lines, os.path.join(tmp_dir, "docs"), ["a"])


def test_documents_plan_gathers_no_report(spark):
    lines = spark.createDataFrame([("a", "{}"), ("a", "{}")], "report string, line string")
    plan = sinks.document_rows(lines, ["a"])[0]._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan


def test_delimited_single_file(spark, tmp_dir):
    df = spark.range(100).selectExpr("id", "id % 3 AS k").repartition(4)
    p = os.path.join(tmp_dir, "t.csv")
    sinks.write_delimited(df, p, sep="|", single_file=True)
    files = _part(p)
    assert len(files) == 1
    lines = open(files[0]).read().splitlines()
    assert lines[0] == "id|k" and len(lines) == 101
    with pytest.raises(Exception):
        sinks.write_delimited(df, p)  # exists: error, as the reference's save


def test_indexed_csv_and_parquet(spark, tmp_dir):
    df = spark.createDataFrame([("b", "c", 0.5), ("a", "b", -1.0)], "col1 string, col2 string, covariance double")
    p = os.path.join(tmp_dir, "cov.csv")
    sinks.write_indexed_csv(df, p, ["col1", "col2"])
    lines = open(_part(p)[0]).read().splitlines()
    assert lines == ["row,col1,col2,covariance", "1,a,b,-1.0", "2,b,c,0.5"]
    out = sinks.save_results({"cov": df}, os.path.join(tmp_dir, "res"))
    back = spark.read.parquet(out["cov"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_info_json_order_and_record_columns(spark, tmp_dir):
    df = spark.createDataFrame([("b", 3, 1), ("a", 1, 2), ("c", 2, 3)], "name string, n long, k int")
    p = os.path.join(tmp_dir, "r.json")
    sinks.write_info_json(df, p, order_by=["n"], record_cols=["name", "n"])
    assert document(p) == [{"name": "a", "n": 1}, {"name": "c", "n": 2}, {"name": "b", "n": 3}]


def test_row_index_over_many_ranges(spark, many_ranges):
    df = spark.range(300).selectExpr("id % 10 AS k", "id").repartition(4)
    got = [(r.row, r.k, r.id) for r in sinks.with_row_index(df, ["k"]).collect()]
    assert sorted(r[0] for r in got) == list(range(1, 301))
    assert [k for _, k, _ in sorted(got)] == sorted(i % 10 for i in range(300))


def test_many_parts_become_one_valid_file(spark, tmp_dir, many_ranges):
    import json

    df = spark.range(2000).selectExpr("id % 7 AS k", "1000 - id AS n", "'a\\r\\u2028b' AS s").repartition(5)
    folder = os.path.join(tmp_dir, "r.json")
    sinks.write_info_json(df, folder, order_by=["n"])
    assert len(_part(folder)) > 1
    want = document(folder)
    target = sinks.one_file(spark, folder, os.path.join(tmp_dir, "out", "r.json"))
    assert os.path.isfile(target) and not os.path.exists(folder)
    with open(target) as f:
        got = json.load(f)["Info"]
    assert got == want and [r["n"] for r in got] == list(range(-999, 1001))
    empty = os.path.join(tmp_dir, "empty.json")
    sinks.write_info_json(df.where("n > 5000"), empty)
    with open(sinks.one_file(spark, empty, os.path.join(tmp_dir, "out", "empty.json"))) as f:
        assert json.load(f) == {"Info": []}
    again = os.path.join(tmp_dir, "again.json")
    sinks.write_info_json(df.limit(1), again)
    with pytest.raises(FileExistsError):
        sinks.one_file(spark, again, target)
