"""Cases of the second review: each operator does its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faretrail.llm import pii, registry, secret_scan, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def table(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source) for i, t in enumerate(texts)], DOCS)


def found(text, spans):
    return [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def test_context_finds_phones_of_shapes_no_seed_has(spark):
    rng = np.random.default_rng(11)
    texts = [f"call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} now" for _ in range(40)]
    want = {
        "please call (212) 555-0123 now": [("phone", "(212) 555-0123")],
        "please call 212-555-0123 now": [("phone", "212-555-0123")],
        "please call 020 7946 0958, 42 of us": [("phone", "020 7946 0958")],
        "call +1 (212) 555-0123 4918187128635271 now": [("phone", "+1 (212) 555-0123")],
        "order 020-7946-0959 shipped": [],
        "call 5 now": [],
    }
    rows = pii.personal_data(table(spark, [*texts, *want])).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    for i, (text, spans) in enumerate(want.items(), len(texts)):
        assert found(text, got[i]) == spans, text


def test_identifiers_of_many_groups(spark):
    rng = np.random.default_rng(12)

    def groups(n):
        return " ".join(f"{x:02}" for x in rng.integers(10, 99, n))

    texts = [f"appel +33 6 {groups(4)} merci" for _ in range(40)]
    want = {
        # the base pattern runs on over both numbers and drops them
        "appel +33 6 12 34 56 78 4918187128635271 merci": [("phone", "+33 6 12 34 56 78")],
        "appel 01 23 45 67 89 merci": [("phone", "01 23 45 67 89")],
        "appel 1 2 3 4 5 6 7 8 9 0 merci": [("phone", "1 2 3 4 5 6 7 8 9 0")],
    }
    rows = pii.personal_data(table(spark, [*texts, *want])).collect()
    got = {r["doc_id"]: r["spans"] for r in rows}
    for i, (text, spans) in enumerate(want.items(), len(texts)):
        assert found(text, got[i]) == spans, text


def test_the_query_counts_base_spans_only(spark, tmp_dir):
    rng = np.random.default_rng(12)
    texts = [f"call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} now" for _ in range(40)]
    texts += ["please call 212-555-0123 now", "call +1 (212) 555-0123 4918187128635271 now", "a@b.c 1.2.3.4 1.2.3.4 x 4111111111111111 x +49 30 1234567", None]
    table(spark, texts).write.parquet(f"{tmp_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in registry.op5_pii(spark, tmp_dir).collect()}
    n = [[r[f"n_{k}"] for k in pii.KINDS] for _, r in sorted(rows.items())]
    assert n == [[0, 0, 0, 1]] * 40 + [[0, 0, 0, 0]] * 2 + [[1, 2, 1, 1], [0, 0, 0, 0]]
    assert rows[41]["spans"] == "phone:5:22" and rows[41]["n_added"] == 1
    assert rows[40]["spans"] == "phone:12:24" and rows[40]["n_added"] == 1


def test_a_dropped_span_hides_no_other(spark):
    spans = [("t", "phone", 0, 10), ("t", "phone", 5, 15), ("t", "phone", 12, 20), ("t", "card", 12, 14), ("u", "ip", 3, 4)]
    long = [("v", "phone", 10 * i, 10 * i + 15) for i in range(2_000)]  # a chain: every other one stays
    got = {tuple(r) for r in pii._apart(spark.createDataFrame([*spans, *long], "key string, kind string, start long, end long")).collect()}
    assert got == {spans[0], spans[2], spans[4], *long[::2]}


def _plain(rng, n):
    return " ".join(f"w{rng.integers(150)}" for _ in range(n))


def test_the_toxic_dictionary_holds_a_large_vocabulary():
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 10)) for _ in range(2_000)]
    ordinary = [_plain(rng, 60) for _ in range(200)]
    toxic = [f"{_plain(rng, 3)} {a} {b} {_plain(rng, 3)}" for a, b in zip(words[::2], words[1::2])]
    toxic *= 4
    grams, n, common = toxicity.common_grams([*ordinary * 20, f"w1 {words[0]} w2"], toxic)
    parts = [toxicity.stretches(t, common) for t in toxic]
    got = toxicity.toxic_dictionary(toxicity.distinctive(parts, grams, n, 4001, toxicity.SURE[1]))
    assert 2048 < len(got) <= toxicity.DICTIONARY
    assert sum(w.encode() in got for w in words) > 0.9 * len(words)


def test_grams_are_compared_by_rate_not_by_one_ordinary_text():
    rng = np.random.default_rng(14)
    ordinary = [_plain(rng, 30) for _ in range(200)] + ["w1 horridness w2"]
    toxic = [f"{_plain(rng, 30)} horridness" for _ in range(50)]
    assert b"horridness" in toxicity.stretches(toxic[0], toxicity.common_grams(ordinary, toxic)[2])


def test_passages_late_in_long_texts_are_learned(spark):
    rng = np.random.default_rng(15)
    texts, marks = [], []
    for i in range(300):
        bad = i % 2 == 0
        words = _plain(rng, 6_000).split()
        if bad:
            for at in 5_500 + rng.integers(0, 400, 6):
                words[at] = rng.choice(["horridness", "vilecreature", "despicable"])
        texts.append(" ".join(words))
        marks.append((i, int(bad)))
    assert min(t.find("horridness") for t in texts if "horridness" in t) > 20_000
    got = toxicity.toxicity(table(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int"), cut=0.5).where("held_out").collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 2 == 0) for r in got]) >= 0.9


def test_assigned_values_and_url_passwords_are_candidates(spark):
    cases = {
        "password=hunter2": "hunter2", "pwd: P@ss!word9, and": "P@ss!word9", "see postgres://u:pa55@host/db": "pa55",
        'passphrase = "correct horse battery"': "correct horse battery", '{"secret": "qwertyuiopasdf"}': "qwertyuiopasdf", "s3://u:abcdef@h": "abcdef",
    }
    for text, value in cases.items():
        assert value in [c[2] for c in secret_scan.find_candidates(text)], text
    assert secret_scan.candidates(table(spark, list(cases))).where(F.col("value").isin(*cases.values())).count() >= len(cases)
    rng = np.random.default_rng(16)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    secrets = ["".join(rng.choice(letters, 8)) for _ in range(150)]
    texts = [f"{_plain(rng, 8)} password={s} {_plain(rng, 5)} note: {rng.choice(['please', 'again', 'today'])} {_plain(rng, 3)}" for s in secrets]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(table(spark, texts, "repo/app.cfg")).collect()}
    assert sum([t[x["start"] : x["end"]] for x in got[i]] == [secrets[i]] for i, t in enumerate(texts)) >= 145


def test_long_values_are_judged_whole():
    words = secret_scan.Language.of({"house", "garden", "river"})
    of = lambda v: secret_scan.features(v, "", "", "", "", words)
    slug = "house-garden-river-" * 300 + "1"
    assert of(slug)[11] == pytest.approx(of(slug[:190])[11], abs=0.01) and of(slug)[11] > 0.8
    assert of("a" * 5_000 + "1B2" * 5_000)[6:9] != pytest.approx(of("a" * 5_000)[6:9])
