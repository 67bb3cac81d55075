"""Survey statistics against brute force on small hand-made tables."""

import numpy as np
import pytest

from faretrail.operators import survey as S


def _df(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))


def test_encode_levels_by_sorted_codes_and_mismatch(spark):
    df = _df(spark, ["q"], [(7,), (3,), (9,), (3,), (None,)])
    out = S.encode_levels(df, "q", ["low", "mid", "high"])
    assert [r.q for r in out.collect()] == ["mid", "low", "high", "low", None]
    with pytest.raises(ValueError):
        S.encode_levels(df, "q", ["a", "b"])
    with pytest.raises(ValueError):
        S.encode_levels(df, "q", ["a", "b", "c", "d"])
    declared = S.encode_levels(df, "q", ["a", "b", "c", "d"], codes=[1, 3, 7, 9])
    assert [r.q for r in declared.collect()] == ["c", "b", "d", "b", None]


def test_split_commuters_null_in_neither(spark):
    df = spark.createDataFrame([("Everyday",), ("Never use PT",), (None,)], "Q4 string")
    com, non = S.split_commuters(df)
    assert [r.Q4 for r in com.collect()] == ["Everyday"]
    assert [r.Q4 for r in non.collect()] == ["Never use PT"]


def test_covariance_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(1, 10, size=(200, 4))
    cols = ["a", "b", "c", "d"]
    df = _df(spark, cols, [tuple(int(v) for v in r) for r in x])
    got = {(r.col1, r.col2): r.covariance for r in S.pairwise_covariance(df, cols).collect()}
    ref = np.cov(x, rowvar=False, ddof=1)
    assert len(got) == 6
    for (a, b), v in got.items():
        assert v == pytest.approx(ref[cols.index(a), cols.index(b)], rel=1e-12)


def test_covariance_null_makes_pair_null(spark):
    df = _df(spark, ["a", "b", "c"], [(1, 2, 3), (2, None, 4), (3, 5, 5)])
    got = {(r.col1, r.col2): r.covariance for r in S.pairwise_covariance(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("b", "c")] is None
    assert got[("a", "c")] == pytest.approx(1.0)


def test_cronbach_alpha_formula(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(1, 6, size=(300, 1))
    x = np.clip(base + rng.integers(-1, 2, size=(300, 5)), 1, 9)
    cols = list("abcde")
    rows = [tuple(int(v) for v in r) for r in x] + [(1, None, 2, 3, 4)]  # incomplete row dropped
    got = S.cronbach_alpha(_df(spark, cols, rows), cols).collect()[0]
    k = 5
    ref = k / (k - 1) * (1 - x.var(axis=0, ddof=1).sum() / x.sum(axis=1).var(ddof=1))
    assert got.n == 300 and got.alpha == pytest.approx(ref, rel=1e-12)
    const = S.cronbach_alpha(_df(spark, ["a", "b"], [(1, 1), (1, 1)]), ["a", "b"]).collect()[0]
    assert const.alpha is None


def _brute_box(vals):
    v = np.sort(np.asarray(vals, dtype=float))
    q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])  # linear = R type 7
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    # the whiskers reach from the box, even if no value near it is left inside
    return len(v), q1, med, q3, min(q1, inside.min()), max(q3, inside.max()), int(((v < lo) | (v > hi)).sum())


def test_box_stats_brute_force(spark):
    groups = {
        1: [5],                                   # one row
        2: [3, 3, 3, 3],                          # constant
        3: [1, 2, 3, 4, 5, 6, 7, 8, 9, 30],       # one outlier above
        4: [2, 4, 4, 5, 5, 5, 6, 6, 8, -10, 11],  # outliers both sides
        6: [0, 10, 10, 10],                       # no value inside below the box
        5: [1, 2, 3, 4, 7],                       # 7 exactly on the upper fence (q3=4, iqr=2)
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(3, None), (None, 4), (None, 6)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r.g: r for r in S.box_stats(df, ["g"], "v").collect()}
    for g, vs in list(groups.items()) + [(None, [4, 6])]:
        n, q1, med, q3, lw, uw, no = _brute_box(vs)
        r = got[g]
        assert (r.n, r.lower_quartile, r.median, r.upper_quartile, r.lower_whisker, r.upper_whisker, r.n_outliers) \
            == (n, q1, med, q3, lw, uw, no), g


def test_frequency_table_zero_level_and_unknown_code(spark):
    df = _df(spark, ["q"], [(1,), (1,), (4,), (None,)])
    out = {r.level: r for r in S.frequency_table(df, "q", {1: "a", 2: "b", 4: "c"}).collect()}
    assert [(out[i].label, out[i].code, out[i].n, out[i].pct) for i in (1, 2, 3)] == [
        ("a", 1, 2, 66.67), ("b", None, 0, 0.0), ("c", 4, 1, 33.33)]
    with pytest.raises(Exception, match="no label for code 4"):
        S.frequency_table(df, "q", {1: "a", 2: "b"}).collect()


def test_frequency_of_the_first_codes(spark):
    df5 = _df(spark, ["q"], [(1,), (2,), (3,), (4,), (5,), (5,)])
    first4 = S.frequency_of_first(df5, "q", ["w", "x", "y", "z"]).collect()
    assert sorted((r.code, r.label, r.pct) for r in first4) == [
        (1, "w", 25.0), (2, "x", 25.0), (3, "y", 25.0), (4, "z", 25.0)]


def test_codes_keep_their_type(spark):
    df = spark.createDataFrame([(1.0, 1), (1.5, 2), (2.0, 2)], "a double, b int")
    out = S.encode_many(df, {"a": ["x", "y", "z"], "b": ["p", "q"]}).collect()
    assert sorted(map(tuple, out)) == [("x", "p"), ("y", "q"), ("z", "q")]
    with pytest.raises(ValueError):
        S.encode_many(df, {"a": ["x", "y"], "b": ["p", "q"]})


def test_box_outliers_lists_values_beyond_the_fences(spark):
    rows = [(1, v) for v in (3, 3, 3, 3, 3, 3, 5, 5, -2)] + [(None, 1), (None, 2), (1, None)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = sorted(tuple(r) for r in S.box_outliers(df, ["g"], "v").collect())
    q1, q3 = np.quantile([3, 3, 3, 3, 3, 3, 5, 5, -2], [0.25, 0.75])
    assert (q1, q3) == (3, 3) and got == [(1, -2.0, 1), (1, 5.0, 2)]


def test_melt_and_relabel(spark):
    df = _df(spark, ["Q3", "a", "b"], [(1, 5, None), (2, 7, 8)])
    long = S.relabel(S.melt(df, ["Q3"], ["a", "b"]), "Aspects", {"a": "Alpha"})
    assert sorted((r.Q3, r.Aspects, r.Ratings) for r in long.collect()) == [
        (1, "Alpha", 5), (1, "b", None), (2, "Alpha", 7), (2, "b", 8)]


def test_fused_boxes_equal_single_boxes(spark):
    from conftest import SF0001

    from faretrail.plans.survey_plan import BOXED, SurveyPlan
    from faretrail.sources import adapters as AD

    plan = SurveyPlan(AD.survey(spark, SF0001))
    fused = plan.boxes()
    for col in BOXED:
        a = plan.box(col)
        b = plan.box_from(fused, col).select(*a.columns)
        assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect()), col


def test_covariance_use_options(spark):
    rows = [(1, 2, 3), (2, None, 4), (3, 5, 5), (4, 4, None), (5, 9, 8)]
    df = _df(spark, ["a", "b", "c"], rows)
    pw = {(r.col1, r.col2): r.covariance for r in S.pairwise_covariance(df, ["a", "b", "c"], use="pairwise").collect()}
    x = np.array([(1, 2), (3, 5), (4, 4), (5, 9)], dtype=float)
    assert pw[("a", "b")] == pytest.approx(np.cov(x, rowvar=False)[0, 1], rel=1e-12)
    cc = {(r.col1, r.col2): r.covariance for r in S.pairwise_covariance(df, ["a", "b", "c"], use="complete").collect()}
    full = np.array([(1, 2, 3), (3, 5, 5), (5, 9, 8)], dtype=float)
    assert cc[("b", "c")] == pytest.approx(np.cov(full, rowvar=False)[1, 2], rel=1e-12)


def test_melted_boxes_from_fused(spark):
    from conftest import SF0001

    from faretrail.plans.survey_plan import Q9_ASPECT_MAP, SurveyPlan
    from faretrail.sources import adapters as AD

    plan = SurveyPlan(AD.survey(spark, SF0001), materialize_data=True)
    a = plan.box_melted(plan.cfg.q9, Q9_ASPECT_MAP)
    b = plan.box_melted_from(plan.boxes(), plan.cfg.q9, Q9_ASPECT_MAP).select(*a.columns)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_encode_many_one_job_and_mismatch(spark):
    df = _df(spark, ["a", "b"], [(1, 10), (2, 20), (2, None), (1, 30)])
    out = S.encode_many(df, {"a": ["x", "y"], "b": ["p", "q", "r"]}).collect()
    assert [(r.a, r.b) for r in out] == [("x", "p"), ("y", "q"), ("y", None), ("x", "r")]
    with pytest.raises(ValueError):
        S.encode_many(df, {"a": ["x", "y"], "b": ["p", "q"]})


def test_covariance_of_doubles_uses_covar_samp(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (4.0, 5.0)], "a double, b double")
    got = S.pairwise_covariance(df, ["a", "b"]).collect()[0].covariance
    assert got == pytest.approx(np.cov([1, 2, 4], [2, 2.5, 5])[0, 1])


def test_crosstab_wide_fills_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", "x")], "r string, c string")
    wide = {r.r: (r.x, r.y, r.z) for r in S.crosstab_wide(df, "r", "c", ["x", "y", "z"]).collect()}
    assert wide == {"a": (2, 1, 0), "b": (1, 0, 0)}


def test_contingency_counts_all_cells_in_one_scan(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(int(v) if v else None for v in r) for r in rng.integers(0, 4, size=(500, 3))]
    df = _df(spark, ["a", "b", "q"], rows)
    cells = S.contingency(df, [("a",), ("a", "b"), ("b", "q")], by="q")
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = {tuple(r) for r in S.cell_rows(cells, {("a",): "a", ("a", "b"): "ab"}, by_codes=[1, 2]).collect()}
    want = {}
    for a, b, q in rows:
        if q in (1, 2):
            want["a", a, None] = want.get(("a", a, None), 0) + 1
            want["ab", a, b] = want.get(("ab", a, b), 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def test_a_wrong_number_of_codes_names_the_column(spark):
    df = _df(spark, ["a", "b"], [(i % 2, i) for i in range(50)])
    with pytest.raises(ValueError, match="^b: 50 distinct codes for 3 labels$"):
        S.level_maps(df, {"a": ["x", "y"], "b": ["x", "y", "z"]})
    with pytest.raises(ValueError, match="^a: 2 distinct codes for 1 labels; b: 50"):
        S.level_maps(df, {"a": ["x"], "b": ["x", "y", "z"]})


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_quantiles_of_a_hot_group_match_numpy(spark, limit):
    rng = np.random.default_rng(9)
    groups = {"hot": rng.normal(size=900), "few": np.repeat(rng.normal(size=3), 40), "one": np.array([4.0]), None: rng.normal(size=11)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None)], "g string, v double").repartition(5)
    probs = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "top": 1.0}
    out = S.quantiles(S.histogram(df, ["g"], "v"), ["g"], probs, limit)
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r["g"]: r for r in out.collect()}
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)
    every = np.concatenate(list(groups.values()))
    alone = S.quantiles(S.histogram(df, [], "v"), [], probs, limit).collect()
    assert [alone[0][p] for p in probs] == pytest.approx([np.quantile(every, p) for p in probs.values()])


def test_running_totals_over_ranges(spark):
    from faretrail.operators.ordered import running_total

    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, w int").repartition(4)
    for limit in (10, 1000):
        got = {(r["g"], r["i"]): r["t"] for r in running_total(df, ["g"], ["i"], "w", "t", limit, ranges=7).collect()}
        assert got == {(g, i): sum(j % 5 for j in range(i)) for g, i, _ in rows}
