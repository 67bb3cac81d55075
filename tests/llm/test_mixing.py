"""Each source's words come near its target, whatever the sizes; checked on the result alone."""

from collections import Counter

import numpy as np
import pytest

from faretrail.llm import source_mixing

DOCS = "doc_id long, text string, source string, rid long, _k int, _copy int, e double, z string, doc string, gap int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4.0, "z", "d", 5) for i, t, s in rows], DOCS)


def words(n):
    return "w " * n


def near(rows, max_copies=3):
    """The miss of each source is at most half of the smallest document left out."""
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    for own in sources.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        left = [r["size"] for r in own if r["size"] and r["copies"] < max_copies]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= min(left, default=0) / 2 + 1e-6
        assert all(0 <= r["copies"] <= max_copies and r["taken"] == r["size"] * r["copies"] for r in own)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_very_long_document_does_not_keep_a_source_from_its_target(spark, seed):
    rows = [(i, words(40), f"s{i % 12:02}") for i in range(2_400)]
    rows += [(10_000 + s, words(20_000 + 900 * s), f"s{s:02}") for s in range(12)]
    got = source_mixing.mix_sources(table(spark, rows), seed=seed).collect()
    by_source = Counter()
    for r in got:
        by_source[r["source"], r["target"]] += r["taken"]
    # 200 documents of 40 words beside the long one close gaps to half of 40 words, as far as three copies of them reach
    assert len(by_source) == 12 and all(abs(taken - target) <= 20 or taken == 24_000 > 0.95 * target for (_, target), taken in by_source.items())
    near(got)


def test_odds_differ_within_a_source_and_long_documents_are_likelier(spark):
    rows = [(i, words(4 if i % 2 else 100), "ab"[i % 4 // 2]) for i in range(4_000)]
    got = [r for r in source_mixing.mix_sources(table(spark, rows), (1, 3)).collect() if r["source"] == "a"]
    share = {n: np.mean([r["copies"] for r in got if r["size"] == n]) for n in (4, 100)}
    assert share[100] == pytest.approx(5 * share[4], rel=0.3)
    near(got)


def test_mixed_documents_keep_rows_with_clashing_names_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 2 if i % 5 else None, words(int(rng.integers(0, 30))), ["a", "b", None][i % 3]) for i in range(300)]
    rows += [(7, words(9), "a")] * 40 + [(8, None, "b"), (9, "", None)]
    docs = table(spark, rows)
    plan = source_mixing.mix_sources(docs).collect()
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in mixed.collect())
    want = Counter()
    for r in plan:
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    assert got == +want
    again = source_mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, plan))
    assert source_mixing.mixed_documents(table(spark, [])).collect() == []
    near(plan)
