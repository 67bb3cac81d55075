"""Every operator against a brute-force version, and on awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faretrail.llm import (
    embedding_dedup, exact_dedup, language_id, line_dedup, ngram_join, packing, pii, secret_scan, source_mixing, textops, toxicity,
)
from faretrail.llm.common import Scratch
from faretrail.llm.graph import connected_components
from faretrail.llm.registry import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size int, component_id string, _row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"token{i % 977}" for i in range(40_000)) + "x" * 30_000
    return table(spark, [
        (1, "The same Text here", "en", "a"), (2, "the SAME text HERE", "en", "a"), (2, "the SAME text HERE", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, "   \n\t ", "de", "b"), (None, "the same text here", "fr", "a"),
        (None, None, None, None), (6, long, "en", "b"), (7, long, None, "b"), (8, "...", "en", ""), (9, "É ä ß line\nline", "fr", "c"),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def closure(nodes, links):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def test_word_hashes_do_not_depend_on_place_and_survive_long_words():
    import pyarrow as pa

    texts = ["ab cd", None, "", " cd  ab", "z" * (textops.BLOCK * 2 + 5), "y" + "z" * (textops.BLOCK * 2 + 5)]
    data, offsets = textops.text_bytes(pa.array(texts))
    s, e, owner = textops.word_bounds(data, offsets)
    h = textops.span_hashes(data, s, e)
    assert owner.tolist() == [0, 0, 3, 3, 4, 5]
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4


def test_components_of_a_chain_a_hub_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == closure(range(1, 31), edges[:29]) | {k: 100 for k in range(100, 140)}
    assert not connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect()


def test_ngram_join_matches_brute_force_in_a_hot_group(spark):
    rng = np.random.default_rng(1)
    base = prose(rng, 60, 10_000).split()
    rows = [(500, " ".join(base)), (501, " ".join(base)), (502, "one two"), (503, "One TWO"), (504, None), (505, "")]
    for i in range(60):  # near copies with 0 to 4 changed words: links, chains and misses
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            words[at] = f"new{i}_{at}"
        rows.append((i, " ".join(words)))
    shared = prose(rng, 30, 10_000)
    rows += [(100 + i, shared + " " + prose(rng, 40, 10_000)) for i in range(40)]
    rows += [(500, " ".join(base))]
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = ngram_join.ngram_components(table(spark, [(d, t, None, None) for d, t in rows]), 4, (85, 100)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(links) > 100 and len(set(want.values())) < len(sets)


def test_ngram_join_on_awkward_rows(spark, awkward, empty):
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(awkward).collect())
    assert got == Counter([(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, 1), (None, None), (6, 6), (7, 6), (8, 8), (9, 9)])
    assert ngram_join.first_of_groups(empty).collect() == []


def test_exact_dedup_with_and_without_colliding_fingerprints(spark, awkward, empty):
    texts = Counter()
    rows = awkward.select("doc_id", "text").collect()
    for r in rows:
        texts[lower(r["text"])] += 1
    keep = {t: max((r["doc_id"] for r in rows if lower(r["text"]) == t and r["doc_id"] is not None), default=None) for t in texts}
    want = Counter((r["doc_id"], keep[lower(r["text"])], texts[lower(r["text"])], r["doc_id"] == keep[lower(r["text"])],
                    hashlib.sha256(lower(r["text"]).encode()).hexdigest()) for r in rows)
    for bits in (64, 1):  # one bit: nearly all chunks collide and are told apart by their bytes
        got = exact_dedup.exact_dedup(awkward, average=64, bits=bits).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == want
    kept = exact_dedup.kept_documents(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8, 9]
    clashing = awkward.select(*awkward.columns, F.lit(9).alias("_key"), F.lit("k").alias("key"), F.lit("d").alias("doc"))
    assert {(r["_key"], r["key"], r["doc"]) for r in exact_dedup.kept_documents(clashing).collect()} == {(9, "k", "d")}
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_chunks_follow_content_not_place():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 20_000).astype(np.uint8)
    both = np.r_[rng.integers(97, 123, 777).astype(np.uint8), body]
    cut = lambda d: textops.span_hashes(d, np.r_[0, (e := exact_dedup.chunk_ends(d, np.array([0, len(d)]), 512, 8192)[0])[:-1]], e)
    a, b = cut(body), cut(both)
    assert len(a) > 10 and len(set(a.tolist()) & set(b.tolist())) >= len(a) - 2


def test_mixing_meets_targets_and_repeats(spark, awkward, empty):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(1, 120))), None, ["a", "b", "c", None][i % 4]) for i in range(800)]
    docs = table(spark, rows)
    got = source_mixing.mix_sources(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mixing.mix_sources(docs.repartition(5)).collect()))
    total = sum(r["size"] for r in got)
    for s, w in zip(("a", "b", "c", None), (5, 2, 1, 5)):
        own = [r for r in got if r["source"] == s]
        assert abs(own[0]["target"] - total * w / 13) < 1e-6  # nothing reaches three copies here
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10, s
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in own)
    mixed = source_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got if r["copies"] > 0)
    odd = source_mixing.mix_sources(awkward).collect()
    assert len(odd) == awkward.count() and all(r["taken"] <= 3 * r["size"] for r in odd)
    assert source_mixing.mix_sources(empty).collect() == []


def test_targets_stop_at_three_copies(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_mixing.source_targets(sizes, (5, 2, 1), 3).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] == pytest.approx(1480 * 2 / 3) and got["c"] == pytest.approx(1480 / 3)


def test_packing_round_trip(spark, awkward, empty):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(0, 900))), None, None) for i in range(60)] + [(60, "a <|endoftext|> b", None, None), (61, "日本語 text", None, None)]
    docs = table(spark, rows).union(awkward)
    packed = packing.pack_documents(docs, tokenizer_path(), with_ids=True)
    got = packed.collect()
    pieces = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        assert r["piece"] == 0 or r["length"] == 2048
        pieces.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in rows[10:]:
        assert sum((r["ids"] for r in sorted(pieces[d], key=lambda r: r["piece"])), []) == slow.encode(t, add_special_tokens=False).ids + [0]
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0, *(n for _, n in b)]))[:-1] and sum(n for _, n in b) <= 2048
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 2048 + 1
    assert sorted(len(r["ids"]) for r in packing.sequences(packed).collect()) == sorted(sum(n for _, n in b) for b in bins.values())
    assert packing.pack_documents(empty, tokenizer_path()).collect() == []


def test_both_tokenizers_agree_on_every_plain_character():
    tok = packing.ByteTokenizer(tokenizer_path())
    texts = [f"a{c}b 1{c}2 {c}{c} {c}x{c} \n{c}{c}{c} 's{c}" for c in packing._PLAIN]
    assert [tok.fast.encode_ordinary(t) for t in texts] == [e.ids for e in tok.slow.encode_batch(texts, add_special_tokens=False)]


def test_configurations_use_up_any_histogram():
    rng = np.random.default_rng(4)
    for scale in (1, 50, 40_000):
        hist = Counter({int(k): int(rng.integers(1, 9)) * scale for k in rng.integers(1, 257, 60)}) + Counter({256: 3})
        plan, share = packing.plan_configurations(hist, 256, tail=2000)
        assert share > 0  # the program runs at every size
        used = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= 256
            used.update({k: v * n for k, v in Counter(lengths).items()})
        assert used == hist
        least = sum(k * v for k, v in hist.items()) / 256
        assert sum(n for _, n in plan) <= 1.05 * max(least, sum(v for k, v in hist.items() if k > 128)) + 5


def test_personal_data_base_matches_brute_force_and_patterns_find_more(spark, awkward, empty):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def base(text):
        out = []
        for o, (kind, pattern) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text or ""):
                d = re.sub("[^0-9]", "", m.group())
                if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                        "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                    out.append((m.start(), o, m.end(), kind))
        return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))

    rng = np.random.default_rng(5)
    rows = [(300 + i, f"é call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} now", None, None) for i in range(40)]
    # the base pattern takes phone and number together and drops them
    rows.append((100, "call +1 (212) 555-0123 4918187128635271 now", None, None))
    rows += [(200 + i, t, None, None) for i, t in enumerate([
        "a@b.c@d.e f_x@y.zz a@b.c_d@e.f @x a@ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111-1111 1111, 4111111111111112 12",
        "+1 2 +123456789 +1234567890123456 (+49) 30-1234-567.", "x" * 1_000 + "@" + "1" * 1_000, "٣٤٥@é.com a b@c.de",
    ])]
    docs = table(spark, rows).union(awkward)
    got = pii.personal_data(docs).collect()
    assert len(got) == docs.count()
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        want = base(texts.get(r["doc_id"]))
        if r["doc_id"] in texts:
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]][:60]
            spans = [x for x in r["spans"].split(",") if x]
            assert set(x for x in want.split(",") if x) <= set(spans)
            assert [sum(x.startswith(k) for x in spans) for k in kinds] == [r[f"n_{k}"] for k in kinds]
    assert next(r for r in got if r["doc_id"] == 100)["spans"] == "phone:5:22"
    assert pii.personal_data(empty).collect() == []


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    vecs = [c + rng.normal(size=16) * 0.12 for c in centres for _ in range(20)] + [centres[0]] * 5
    rows = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(vecs)]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_neardup(df, block=16).collect()}
    a = np.array([r[1] for r in rows])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    near = a @ a.T >= 0.95
    np.fill_diagonal(near, False)
    comp = closure(range(len(a)), list(zip(*np.nonzero(near))))
    assert near.sum() > 500
    found = sum(got[i]["n_links"] for i in range(len(a)))
    assert found <= near.sum() and found >= 0.99 * near.sum()
    assert sum(got[i]["component_id"] == comp[i] for i in range(len(a))) >= 0.99 * len(a)
    assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["component_id"] == b[0] for b in bad)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.values())
    assert embedding_dedup.embedding_neardup(df.limit(0)).collect() == []


def test_tables_reach_the_recall_asked_for():
    for n in (500, 50_000, 10**9):
        bits, tables = embedding_dedup.plan_tables(n, 0.95, 0.999)
        agree = 1 - np.arccos(0.95) / np.pi
        assert 1 - (1 - agree**bits) ** tables >= 0.999


def test_line_dedup_matches_brute_force(spark, awkward, empty):
    rng = np.random.default_rng(7)
    base = [prose(rng, 40, 10_000).split() for _ in range(4)]
    rows = []
    for i in range(50):
        lines = []
        for b in base:
            words = list(b)
            for at in rng.choice(40, rng.integers(0, 3), replace=False):
                words[at] = f"x{rng.integers(9)}"
            lines.append(" ".join(words))
        rows.append((i, "\n".join([*lines, "short Line", "", prose(rng, 3, 6)]) + "\n" * (i % 2), None, None))
    order, seen, want = sorted(rows), [], {}
    for d, t, *_ in order:
        gone = []
        for at, line in enumerate(t.split("\n")):
            w = WORD.findall(lower(line))
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
            if s and any(100 * len(s & x) >= 80 * len(s | x) for x in seen):
                gone.append(at)
            if s:
                seen.append(s)
        want[d] = (len(t.split("\n")), gone)
    docs = table(spark, rows)
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == want
    odd = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.line_dedup(awkward).collect()}
    assert odd == {1: (1, []), 2: (2, [0]), 3: (0, []), 4: (0, []), 5: (2, []), 6: (1, []), 7: (1, [0]), 8: (1, []), 9: (2, []), None: (1, [0])}
    assert line_dedup.line_dedup(empty).collect() == []


def test_gru_gradient_is_right():
    net = language_id.ByteBiGRU.fresh(3, ["a", "b"], 0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(97, 100, (5, 4)), np.array([0, 1, 1, 0])
    _, grad = net.gradient(x, y)
    for k in net.p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old, eps = net.p[k][at], 1e-4
        net.p[k][at] = old + eps
        up, _ = net.gradient(x, y)
        net.p[k][at] = old - eps
        down, _ = net.gradient(x, y)
        net.p[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grad[k][at], rel=2e-2, abs=1e-5), k


def test_language_is_learned_and_judged_on_whole_texts(spark, awkward, empty):
    rng = np.random.default_rng(8)
    forms = {"aa": ["zu", "und", "chen"], "bb": ["the", "ing", "wh"]}
    rows = [(i, " ".join("".join(rng.choice(forms[g], 2)) for _ in range(30)), g, None) for i, g in enumerate(["aa", "bb"] * 60)]
    got = language_id.language_id(table(spark, rows), steps=150).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in held]) >= 0.95
    odd = language_id.language_id(awkward, steps=5).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5, 8)) for r in odd if r["doc_id"] is not None)
    kept = language_id.identified_documents(awkward, least=0.0, steps=5)
    assert kept.columns == awkward.columns and kept.count() == 7
    assert language_id.language_id(empty).collect() == []


def test_windowed_scores_equal_a_plain_pass():
    net = language_id.ByteBiGRU.fresh(4, ["a", "b", "c"], 1)
    texts = [b"hello world, ", b"", b"abc" * 7, b"z"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = net.document_scores(data, offsets, window=64)
    for t, g in zip(texts, got):
        if t:
            x = np.frombuffer(t, np.uint8)[:, None]
            hf, hb = np.stack(net._layer("f", x)["h"][1:]), np.stack(net._layer("b", x[::-1])["h"][1:])[::-1]
            z = np.exp(hf @ net.p["of"] + hb @ net.p["ob"] + net.p["bias"])
            assert np.allclose(g, (z / z.sum(axis=2, keepdims=True)).mean(axis=(0, 1)), atol=1e-5)
        else:
            assert (g == 0).all()


def test_toxicity_finds_held_out_documents(spark, awkward, empty):
    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(600):
        words = prose(rng, 60, 150).split()
        bad = i % 3 == 0
        if bad:
            for at in rng.integers(0, 60, 4):
                words[at] = rng.choice(["horridness", "vilecreature", "despicable"])
        rows.append((i, " ".join(words), None, None))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(table(spark, rows), labels).collect() if r["held_out"]]
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600))
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in got]) >= 0.95
    odd = toxicity.toxicity(awkward, labels).collect()
    assert len(odd) == 12 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert all(r["score"] == 0 for r in toxicity.toxicity(awkward, labels.limit(0)).collect())


def test_forest_learns_and_secrets_are_found(spark, awkward, empty):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = secret_scan.RandomForest.fit(x[:300], y[:300])
    assert ((forest.predict(x[300:]) > 0.5) == y[300:]).mean() > 0.8
    rows = []
    for i in range(120):
        secret = "".join(rng.choice(list("0123456789abcdef"), 18))
        number = "".join(rng.choice(list("0123456789"), 16))
        rows.append((i, f"{prose(rng, 8)} password={secret} {prose(rng, 5)} order {number} é", None, "repo/app.cfg"))
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(table(spark, rows)).collect()}
    right = 0
    for i, t, *_ in rows:
        s = t.index("password=") + 9
        spans = [(x["start"], x["end"]) for x in got[i]["spans"]]
        right += spans == [(s, s + 18)]
        assert got[i]["n_candidates"] >= 2
    assert right >= 115
    odd = secret_scan.secret_scan(awkward).collect()
    assert len(odd) == 12 and secret_scan.secret_scan(empty).collect() == []
