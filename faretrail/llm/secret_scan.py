"""Secret scan: generic candidates, false positives removed by a random forest."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch, prepare

#: A candidate: a run of at least twelve of the characters that keys are made
#: of, with a digit in it, not inside a longer run.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+=*+")
#: A name (of letters, digits, _ . and -, with a letter) and its sign; a value follows.
NAME = re.compile(r"""(?<![A-Za-z0-9_.\-])(?=[0-9_.\-]*+[A-Za-z])([A-Za-z0-9_.\-]{2,}+)["']?[ \t]{0,2}[:=][ \t]{0,2}(?!//)""")
#: The password in a URL.
URL_PASSWORD = re.compile(r"://[^\s:/@]*+:([^\s/@]++)@")
#: A text can only hold a candidate if this pattern of Spark's finds something.
HAS_CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}+"
    r"""|[A-Za-z0-9_.\-]["']?[ \t]{0,2}[:=][ \t]{0,2}[^\s]|://"""
)
_ASSIGNED = re.compile(r"""([A-Za-z0-9_.\-]{2,})["']?\s{0,2}[:=]\s{0,2}["']?$""")
#: Characters that end a value where another name follows, and that are cut from its end.
_NEXT, _TRAIL = "&;,?", """.,;)]}"'"""
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Characters looked at on either side of a candidate.
CONTEXT = 64
_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")):
    for _c in _chars:
        _CLASSES[ord(_c)] = _k + 1
#: Longest word of the corpus dictionary.
WORD_LENGTH = 16
#: Buckets that neighbouring words are hashed to; each is a yes/no feature.
NEIGHBOURS = 24
FEATURES = 18 + NEIGHBOURS


def assigned_values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name in lower case) of values of four characters or more
    that a name is assigned: all between quotes on a line, or all up to white
    space or ``&;,?`` before another name, without closing punctuation. A value
    may itself hold names and values. Linear in the text: where a value ends
    is looked up among the places of all quotes, breaks and names."""
    names = [(m.start(), m.end(), m.group(1).lower()) for m in NAME.finditer(text)]
    if not names:
        return
    places = {c: [m.start() for m in re.finditer(c, text)] for c in ('"', "'", r"\n", r"\s")}
    cuts = [s - 1 for s, _, _ in names if s and text[s - 1] in _NEXT]

    def following(where: list[int], at: int) -> int:
        k = bisect.bisect_left(where, at)
        return where[k] if k < len(where) else len(text)

    for _, v, name in names:
        mark = text[v : v + 1]
        if mark in ('"', "'"):
            start, end = v + 1, following(places[mark], v + 1)
            if end >= following(places[r"\n"], start):
                continue
        else:
            start, end = v, min(following(places[r"\s"], v), following(cuts, v))
            while end > start and text[end - 1] in _TRAIL:
                end -= 1
        if end - start >= 4:
            yield start, end, name


def find_candidates(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, candidate, assigned name, text before, text after), code
    points. Candidates of different kinds may overlap; the forest judges each."""
    spans: dict[tuple[int, int], str | None] = {m.span(): None for m in CANDIDATE.finditer(text)}
    for m in URL_PASSWORD.finditer(text):
        spans[m.span(1)] = "password"
    for start, end, name in assigned_values(text):
        spans[start, end] = spans.get((start, end)) or name
    out = []
    for (start, end), name in sorted(spans.items()):
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        if name is None:
            found = _ASSIGNED.search(before)
            name = found.group(1).lower() if found else ""
        out.append((start, end, text[start:end], name, before, after))
    return out


@dataclass(frozen=True)
class Language:
    """The corpus's words and how their letters follow each other."""

    words: frozenset[str]
    moves: dict[str, float]
    usual: tuple[float, float]  # the 5th and the 25th percentile of the words' own scores

    @staticmethod
    def of(words) -> Language:
        words = frozenset(words)
        counts: dict[str, int] = {}
        total: dict[str, int] = {}
        for w in words:
            for x, y in zip(" " + w, w):
                counts[x + y] = counts.get(x + y, 0) + 1
                total[x] = total.get(x, 0) + 1
        moves = {p: math.log2((n + 0.05) / (total[p[0]] + 0.05 * 64)) for p, n in counts.items()}
        moves |= {x: math.log2(0.05 / (n + 0.05 * 64)) for x, n in total.items()}
        bare = Language(words, moves, (0.0, 0.0))
        scores = sorted(bare.likeness(w) for w in words) or [0.0]
        return Language(words, moves, (scores[len(scores) // 20], scores[len(scores) // 4]))

    def likeness(self, value: str) -> float:
        """Mean log2 probability of the letters of ``value`` under the words'
        letter transitions; runs of letters begin like words. 0 without letters."""
        score, n = 0.0, 0
        for run in _WORD.findall(value.lower()):
            for x, y in zip(" " + run, run):
                score += self.moves.get(x + y, self.moves.get(x, -7.0))
                n += 1
        return score / n if n else 0.0

    def coverage(self, value: str) -> float:
        """Share of the characters of ``value`` inside words of the corpus."""
        low = value.lower()
        covered = np.zeros(len(low), bool)
        for run in _WORD.finditer(low):  # words are of letters
            for at in range(run.start(), run.end() - 2):
                for size in range(min(WORD_LENGTH, run.end() - at), 2, -1):
                    if low[at : at + size] in self.words:
                        covered[at : at + size] = True
                        break
        return float(covered.mean()) if len(low) else 0.0


def features(value: str, name: str, before: str, after: str, path: str, language: Language) -> np.ndarray:
    """Length, character transitions, dictionary coverage, path and neighbours."""
    out = np.zeros(FEATURES, np.float32)
    raw = np.frombuffer(value.encode("latin-1", "replace"), np.uint8)
    kind = _CLASSES[raw]
    n = len(raw)
    out[0] = math.log2(n)
    out[1:5] = np.bincount(kind, minlength=4)[:4] / n
    step = kind[1:] * 4 + kind[:-1]
    moves = np.bincount(step, minlength=16)
    out[5] = (kind[1:] != kind[:-1]).mean() if n > 1 else 0  # class changes
    out[6] = moves[[7, 13]].sum() / n  # digit and lower case meet
    out[7] = moves[[11, 14]].sum() / n  # digit and upper case meet
    share = np.bincount(raw) / n
    share = share[share > 0]
    out[8] = -(share * np.log2(share)).sum()
    out[9] = len(share) / n
    hexa = np.isin(raw, np.frombuffer(b"0123456789abcdef", np.uint8))
    out[10] = hexa.mean()
    out[11] = language.coverage(value)
    words = [w.lower() for w in _WORD.findall(before)[-3:]] + [w.lower() for w in _WORD.findall(after)[:2]]
    out[12] = sum(w in language.words for w in words) / max(1, len(words))
    out[13] = float(bool(name))
    out[14] = float(before[-1:] in "\"'=:" and before[-1:] != "")
    out[15] = path.count("/") + path.count(".")
    out[16] = zlib.crc32(path.rsplit("/", 1)[-1].encode()) % 64
    out[17] = language.likeness(value)
    for w in {name, *words[-4:]} - {""}:
        out[18 + zlib.crc32(w.encode()) % NEIGHBOURS] = 1
    return out


@dataclass
class RandomForest:
    """Binary trees as arrays: feature (-1 at a leaf), cut, left child, probability."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, leaf: int = 3, seed: int = 0) -> RandomForest:
        rng = np.random.default_rng(seed)
        width = max(1, int(math.sqrt(x.shape[1]) * 1.5))
        return RandomForest([_grow(x, y, rng, width, depth, leaf) for _ in range(trees)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, prob in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, left[at] + right, at)
            total += prob[at]
        return total / len(self.trees)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, width: int, depth: int, leaf: int):
    """One tree on a bootstrap sample; Gini splits over a random set of features."""
    rows = rng.integers(0, len(y), len(y))
    feature, cut, left, prob = [-1], [0.0], [0], [float(y[rows].mean())]
    todo = [(0, rows, 0)]
    while todo:
        node, rows, level = todo.pop()
        p = y[rows].mean()
        prob[node] = float(p)
        if level >= depth or len(rows) < 2 * leaf or p in (0.0, 1.0):
            continue
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], width, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            size = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (size >= leaf) & (len(order) - size >= leaf)
            if not ok.any():
                continue
            a, b = t[:-1] / size, (t[-1] - t[:-1]) / (len(order) - size)
            impurity = (size * a * (1 - a) + (len(order) - size) * b * (1 - b)) / len(order)
            gain = np.where(ok, p * (1 - p) - impurity, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            continue
        feature[node], cut[node], left[node] = best[1], best[2], len(feature)
        go = x[rows, best[1]] > best[2]
        for side in (~go, go):
            todo.append((len(feature), rows[side], level + 1))
            feature.append(-1), cut.append(0.0), left.append(0), prob.append(0.0)
    return np.array(feature), np.array(cut), np.array(left), np.array(prob)


# ------------------------------------------------------------------- Spark

_FINDING = "doc_id long, start int, end int, value string, name string, before string, after string, path string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [
            (d, s, e, v, n, x, y, p or "")
            for d, t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            for s, e, v, n, x, y in find_candidates(t)
        ]
        cols = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _FINDING.split(", ")])


def candidates(docs: DataFrame) -> DataFrame:
    """All candidate findings with their surroundings; ``source`` is the path.
    Texts that cannot hold one never leave the JVM."""
    prepare(docs.sparkSession)
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")
    ).where(F.col("text").rlike(HAS_CANDIDATE))
    return src.mapInArrow(_extract, _FINDING)


def frequent_words(docs: DataFrame, size: int = 5000, documents: int = 3) -> frozenset[str]:
    """The corpus dictionary: the ``size`` words of three to ``WORD_LENGTH``
    letters that most documents use, at least ``documents`` of them (counted
    over all documents, ties by word). A value of letters that one document
    holds is no word."""
    pattern = r"(?<!\p{L})\p{L}{3,%d}+(?!\p{L})" % WORD_LENGTH
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("w")
    counts = docs.select(word).groupBy("w").count().where(F.col("count") >= documents)
    return frozenset(r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(size).collect())


#: Parts of names that credentials are assigned to, and key formats that
#: issuers publish (fixed values).
CREDENTIAL = re.compile(
    r"(?:^|[_.\-])(?:password|passwd|passphrase|pwd|pass|secret|token|api_?-?key|access_?-?key|auth)(?:[0-9]*$|[_.\-])"
)
ISSUED = re.compile(
    r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
)


def evidence(value: str, name: str, language: Language) -> int | None:
    """What the value itself tells a reviewer, whatever the forest would say.

    1: an issuer's key format, or a credential's value that is unlike the
    corpus's language (letters that do not follow each other like its words',
    or letters mixed with digits or signs and few words in them).
    0: a value made of the corpus's words or of letters like theirs, a number,
    a date or a version, under any name, a credential's too; and a value that
    is no credential's. None (not used): a credential's value in between.
    """
    if ISSUED.fullmatch(value):
        return 1
    letters = [c for c in value if c.isalpha()]
    plain = len(letters) == len(value.strip())
    words, like = language.coverage(value), language.likeness(value)
    if not letters or words >= 0.8 or (plain or " " in value) and like >= language.usual[1]:
        return 0
    if not CREDENTIAL.search(name):
        return 0
    if words < 0.5 and (not plain or like < language.usual[0]):
        return 1
    return None


def _label(language: Language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [evidence(v, n, language) for v, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], names=[*b.schema.names, "label"])

    return run


def reviewed(findings: DataFrame, language: Language) -> DataFrame:
    """Findings with a ``label`` for training where no human labels exist: the
    ``evidence`` of the value. Of the values assigned to a credential's name,
    those that are words are labelled 0, so the name alone decides nothing."""
    return findings.mapInArrow(_label(language), _FINDING + ", label int").where("label is not null")


def train(labelled: DataFrame, language: Language, per_label: int = 2000, seed: int = 9, **options) -> RandomForest | None:
    """Fit on findings with ``label`` 0 or 1: a bounded sample of about
    ``per_label`` of each, by a hash of the finding. Findings of label 0 under
    a credential's name are drawn as a kind of their own, so that many others
    do not crowd them out. None without both labels."""
    strata = F.when(F.col("label") == 1, 1).when(F.col("name").rlike(CREDENTIAL.pattern), 2).otherwise(0)
    kinds = labelled.withColumn("kind", strata)
    counts = kinds.groupBy("kind").count().select("kind", (F.lit(float(per_label)) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64("value", "before", F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rows = (
        kinds.join(F.broadcast(counts), "kind").where(draw < F.col("rate"))
        .orderBy("value", "before", "after", "path", "label").limit(6 * per_label).collect()
    )
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([features(r["value"], r["name"], r["before"], r["after"], r["path"], language) for r in rows])
    return RandomForest.fit(x, y, seed=seed, **options)


def _judge(forest: RandomForest | None, language: Language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3, 8)))
            score = np.ones(b.num_rows)
            if forest is not None and b.num_rows:
                x = np.stack([features(v, n, before, after, path, language) for v, n, before, after, path in rows])
                score = forest.predict(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return run


def scan(findings: DataFrame, forest: RandomForest | None, language: Language) -> DataFrame:
    """Findings with the forest's ``score``; all score 1 without a forest."""
    return findings.mapInArrow(_judge(forest, language), _FINDING + ", score double")


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, cut: float = 0.5) -> DataFrame:
    """Find secrets in every whole text.

    Returns a row per document row: ``doc_id, n_candidates, n_secrets, spans``
    (array of start, end, score of the findings kept, in order, code points).

    ``labelled`` findings (``candidates`` and a ``label``) train the forest;
    without them ``reviewed`` labels all of this table's own findings, of which
    those with crc32(value) mod 4 = 0 are left out of training. A null text has
    no findings; a null path is empty; rows with the same id (or none) share
    the findings of all of them, each counted once. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "secret-scan")
    found = scratch.keep(candidates(docs))
    language = Language.of(frequent_words(docs))
    learn = labelled
    if learn is None:
        learn = scratch.keep(reviewed(found.where(F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(4)) != 0), language))
    forest = train(learn, language)
    scored = scan(found.dropDuplicates(["doc_id", "start", "end", "value", "before", "after"]), forest, language)
    per_doc = scored.groupBy("doc_id").agg(
        F.count("*").alias("n_candidates"),
        F.sum((F.col("score") >= cut).cast("long")).alias("n_secrets"),
        F.sort_array(F.collect_list(F.when(F.col("score") >= cut, F.struct("start", "end", F.round("score", 6).alias("score"))))).alias("spans"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    got = per_doc.withColumnRenamed("doc_id", "_d")
    return ids.join(got, ids["doc_id"].eqNullSafe(got["_d"]), "left").select(
        "doc_id",
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,score:double>>)")).alias("spans"),
    )
