"""Line deduplication on words, and texts without their repeated lines."""

import itertools
import re

import numpy as np

from faretrail.llm import line_dedup

DOCS = "doc_id long, text string, source string, _r int, _d int, id string, removed string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, "x", "y") for i, t in rows], DOCS)


def test_single_words_as_tokens_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 60, 20)]
    lines = [" ".join(base), " ".join([*base[:7], "changed", *base[8:]]), "all rights reserved 2019 acme corp of the north sea and the south",
             "all rights reserved 2020 acme corp of the north sea and the south", "short line", "Short LINE", "", "   "]
    lines += [" ".join(f"w{i}" for i in rng.integers(0, 40, rng.integers(1, 14))) for _ in range(120)]
    rows = [(k, "\n".join(lines[k * 8 : k * 8 + 8])) for k in range(16)]
    sets = [(k, n, frozenset(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))) for k, text in rows for n, t in enumerate(text.split("\n"))]
    gone = set()
    for a, b in itertools.combinations(sets, 2):
        if a[2] and b[2] and 100 * len(a[2] & b[2]) >= 80 * len(a[2] | b[2]):
            gone.add(b[:2])
    got = line_dedup.line_decisions(table(spark, rows), k=1).where("removed").collect()
    assert {(r["doc_id"], r["line"]) for r in got} == gone
    assert {(0, 1), (0, 3), (0, 5)} <= gone


def test_texts_lose_their_repeated_lines_and_rows_their_nothing_else(spark):
    line = "this line of eight words stands more often"
    rows = [(1, f"first\n{line}\n\nlast"), (2, f"{line}\nother words of their own here\n"), (3, None), (4, ""), (None, f"{line}\nnameless words of this one row")]
    docs = table(spark, rows)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        1: f"first\n{line}\n\nlast", 2: "other words of their own here\n", 3: None, 4: "", None: "nameless words of this one row"}
    assert all((r["_r"], r["_d"], r["id"], r["removed"]) == (1, 2, "x", "y") for r in got.values())
    assert line_dedup.without_repeated_lines(docs.where("false")).collect() == []
