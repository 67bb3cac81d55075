"""Suffix arrays against sorting, and the operator against comparing all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faretrail.llm import suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, row long, data string, s int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_is_the_sorted_order(symbols):
    s = [*symbols, 0]
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_dedup.suffix_array(s) == want
    rank, shared = suffix_dedup.neighbour_prefixes(s, want)
    for r in range(1, len(s)):
        a, b = s[want[r - 1] :], s[want[r] :]
        assert shared[r] == next(i for i in range(len(s)) if i >= min(len(a), len(b)) or a[i] != b[i])
        assert rank[want[r]] == r


@pytest.mark.parametrize("s", [[1] * 30_000, [1, 2] * 15_000, list(range(1, 30_000)), list(range(30_000, 0, -1))])
def test_suffix_array_of_long_runs_takes_linear_time(s):
    got = suffix_dedup.suffix_array([*s, 0])
    assert sorted(got) == list(range(len(s) + 1)) and got[0] == len(s)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 5, "x", 3) for i, t in rows], DOCS)


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for at in range(len(t) - length + 1):
            if seen[t[at : at + length]] > 1:
                gone[at : at + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def corpus(rng, n=120):
    word = lambda: "".join(rng.choice(list("abé"), int(rng.integers(1, 4))))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, line = prose(60), prose(12)
    rows = []
    for i in range(n):
        text = prose(int(rng.integers(0, 60)))
        if i % 3 == 0:  # a hot passage in different surroundings
            text = f"{prose(4)}{passage}{prose(4)}"
        elif i % 5 == 0:
            text = f"{prose(9)}{line}{prose(9)}{line[3:]}"
        elif i % 7 == 0:
            text = (text + " ") * 2 + "z" * int(rng.integers(0, 90))
        elif i % 4 == 0 and rows and rows[-1][1]:  # a near copy
            text = rows[-1][1][:40] + "#" + rows[-1][1][40:]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("length", [12, 25, 40])
def test_removal_matches_comparing_all_strings(spark, length):
    rows = corpus(np.random.default_rng(length))
    got = suffix_dedup.suffix_dedup(table(spark, rows).repartition(7), length).collect()
    assert Counter(map(tuple, got)) == brute(rows, length)
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("group, width", [(2, 8), (2, 3), (5, 8)])
def test_large_groups_are_cut_finer(spark, monkeypatch, group, width):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "FINER", (width, 1))
    rows = corpus(np.random.default_rng(9))
    got = suffix_dedup.suffix_dedup(table(spark, rows), 25).collect()
    assert Counter(map(tuple, got)) == brute(rows, 25)


def test_awkward_rows(spark):
    long = " ".join(f"token{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, "y" * 300), (4, long), (5, "-" + long), (6, long[:199]), (7, "é" * 150), (7, "é" * 150),
            (8, long[1000:1200] + "a" + long[7000:7199]), (None, None)]
    got = suffix_dedup.suffix_dedup(table(spark, rows), texts=True).collect()
    out = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert len(got) == len(rows)
    assert all(hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"] for r in got)
    assert out[4, len(long)]["n_removed"] == len(long) and out[5, len(long) + 1]["kept_bytes"] == b"-"
    assert out[None, 300]["n_removed"] == 300 and out[7, 300]["n_removed"] == 300 and out[7, 300]["n_spans"] == 1
    assert out[6, 199]["n_removed"] == 0 and out[8, 400]["n_removed"] == 200 and len(out[8, 400]["kept_bytes"]) == 200
    assert out[1, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.suffix_dedup(table(spark, [])).collect() == []
