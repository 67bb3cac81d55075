"""The corpus pipeline against plain versions of its stages, one after another."""

import itertools
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from faretrail.llm import language_id, source_mixing
from faretrail.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def corpus(rng):
    vocabulary = {lang: ["".join(rng.choice(list(letters), int(rng.integers(3, 8)))) for _ in range(120)]
                  for lang, letters in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    rows = []
    for i in range(90):
        lang = ["en", "de"][i % 2]
        rows.append((i, prose(lang, int(rng.integers(30, 90))), lang, ["a", "b", None][i % 3]))
    for i in range(10):  # exact copies up to case, and near copies
        rows.append((100 + i, rows[i][1].upper(), rows[i][2], "b"))
        words = rows[20 + i][1].split()
        rows.append((200 + i, " ".join([*words, "more"]), rows[20 + i][2], "a"))
    return [*rows, (300, None, "en", "a"), (301, "123 456", "en", "b"), (302, "", None, None), (7, rows[7][1], "de", "b")]


def test_run_equals_plain_stages(spark, tmp_dir):
    rows = corpus(np.random.default_rng(12))
    cols = list(zip(*rows))
    extra = [len(t or "") for t in cols[1]]
    names = ["doc_id", "text", "lang", "source", "n_chars", "key", "_k"]
    pq.write_table(pa.table([*map(pa.array, cols), pa.array(extra), pa.array(["k"] * len(rows)), pa.array([1] * len(rows))], names=names),
                   os.path.join(tmp_dir, "documents.parquet"))
    got = corpus_pipeline.run(spark, tmp_dir).collect()

    # language: the network's own decisions (its accuracy is tested by itself); documents without a letter go
    docs = spark.read.parquet(os.path.join(tmp_dir, "documents.parquet"))
    kept = [(r["doc_id"], r["text"], r["source"]) for r in language_id.identified_documents(docs, least=0.3).collect()]
    assert {300, 301, 302}.isdisjoint(d for d, _, _ in kept) and len(kept) > 90
    # exact copies: the largest id of equal lower-cased texts
    best = {}
    for d, t, s in kept:
        if lower(t) not in best or d > best[lower(t)][0]:
            best[lower(t)] = (d, t, s)
    kept = list(best.values())
    # near copies: linked at 0.8 by five-word shingles, the smallest id stays
    sets = {}
    for d, t, _ in kept:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    group = {d: d for d in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) >= 8
    for _ in range(len(sets)):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    kept = [(d, t, s) for d, t, s in kept if group[d] == d]
    # mixing: the statement's row-by-row walk
    con = duckdb.connect()
    con.register("documents", pa.table([pa.array(c) for c in zip(*kept)], names=["doc_id", "text", "source"]))
    mixed = Counter()
    for d, size, _, _, taken in con.execute(source_mixing.SQL).fetchall():
        mixed[d] += taken // size if size else 0
    # packing: ids of every mixed document, in sequences without gaps
    slow, texts = Tokenizer.from_file(tokenizer_path()), {d: t for d, t, _ in kept}
    want = Counter({(d, len(slow.encode(texts[d], add_special_tokens=False).ids) + 1): n for d, n in mixed.items() if n})
    assert Counter((r["doc_id"], r["length"]) for r in got) == want  # all shorter than a sequence
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_an_empty_table_gives_no_sequences(spark, tmp_dir):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(schema.empty_table(), os.path.join(tmp_dir, "documents.parquet"))
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []
