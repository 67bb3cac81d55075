"""The filter audit against its DuckDB statement and against plain counting."""

import itertools
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from faretrail.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n long, mask int, part string, digest string"
LABELS = "doc_id long, quality int, toxic int, n long, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    long = " ".join(f"word{i}" for i in range(50_000))
    docs = [(1, "same text", "en"), (2, "same text", "en"), (2, "same text", "de"), (None, "same text", "en"), (3, None, None), (4, "", None),
            (5, "A B C", "en"), (6, long, ""), (7, long + " $", ""), (8, "x " * 200, "fr"), (9, "Same text", "fr"), (9, "Same text", "fr"),
            (10, "ÄÖ É 100% \n\t\x0b", None)]
    labels = [(1, 1, 0), (1, None, 1), (2, 1, 1), (5, 1, 0), (None, 1, 1), (8, 0, None), (9, 2, 1)]
    return docs, labels


def tables(spark, docs, labels):
    return (spark.createDataFrame([(*d, None, 7, 8, "p", "q") for d in docs], DOCS),
            spark.createDataFrame([(*x, 9, "z") for x in labels], LABELS))


def brute(docs, labels):
    lab = {}
    for i, q, t in labels:
        g, x = lab.get(i, (0, 0))
        lab[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    out = {}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((lang or "", {c for c, f in fails.items() if f}, lab.get(i, (0, 0)) if i is not None else (0, 0)))
    shapley = Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                own = [(f, lb) for p, f, lb in rows if p == part]
                here = [(f, lb) for f, lb in own if c in f and not f & before]
                shapley[part, c] += len(here)
                out[part, order, step] = [sum(not f & set(order[:step]) for f, _ in own), len(here), sum(c in f and bool(f & before) for f, _ in own),
                                          sum(f == {c} for f, _ in own), sum(lb[0] for _, lb in here), sum(lb[1] for _, lb in here)]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_matches_plain_counting_on_awkward_rows(spark):
    docs, labels = awkward_rows()
    got = [tuple(r) for r in filter_audit.filter_audit(*tables(spark, docs, labels)).collect()]
    assert len(got) == len(set(got)) == 600 * 4
    assert set(got) == brute(docs, labels)


def test_statement_agrees(spark):
    docs, labels = awkward_rows()
    d, lb = tables(spark, docs, labels)
    con = duckdb.connect()
    con.register("documents", d.toPandas()[["doc_id", "text", "lang"]])
    con.execute("CREATE TABLE l AS SELECT * FROM (VALUES (1, 1, 0), (1, NULL, 1), (2, 1, 1), (5, 1, 0), (NULL, 1, 1), (8, 0, NULL), (9, 2, 1)) t(doc_id, quality, toxic)")
    con.execute("CREATE VIEW labels AS SELECT * FROM l")
    assert set(con.execute(filter_audit.SQL).fetchall()) == brute(docs, labels)


def test_empty_tables_and_a_hot_text(spark):
    d, lb = tables(spark, [], [])
    assert filter_audit.filter_audit(d, lb).collect() == []
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"), F.lit("en").alias("lang"))
    got = {r["filter_order"]: r for r in filter_audit.filter_audit(hot, lb).where("step = 1").collect()}
    assert got["EABCD"]["removed"] == 2999 and got["EABCD"]["kept"] == 1 and got["ABCDE"]["removed"] == 3000
