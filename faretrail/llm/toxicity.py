"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import Scratch, prepare, crc_mod

#: Words and bytes of a window at most; windows end between words.
WORDS, BYTES = 8, 512
#: Bytes of the stretches that make toxic text distinctive, and how many times
#: as often, of the texts of a class, toxic ones must have them as ordinary ones.
GRAM, RATIO = 5, 4
#: Standard errors by which the class rates must differ: rare ordinary words fill
#: the dictionary at a low one, rare toxic words are lost at a high one. The one
#: that calibrates best is taken.
SURE = (1.0, 2.5, 3.5, 5.0)
#: Bytes of a dictionary at most.
DICTIONARY = 65536
#: Places that the excerpt of a very long text is taken from.
PLACES = 20
LEVEL = 9


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text index) of every window: eight words, or one very
    long word cut into stretches of ``BYTES``."""
    starts, ends, text = X.word_bounds(data, offsets)
    if not len(starts):
        return starts, ends, text
    index = np.arange(len(text))
    first = np.r_[True, text[1:] != text[:-1]]
    nth = index - np.maximum.accumulate(np.where(first, index, 0))
    at = np.flatnonzero(nth % WORDS == 0)
    lo, owner = starts[at], text[at]
    hi = ends[np.r_[at[1:] - 1, len(starts) - 1]]
    parts = np.maximum(1, -(-(hi - lo) // BYTES))
    if parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo, hi, owner = np.repeat(lo, parts), np.repeat(hi, parts), np.repeat(owner, parts)
        lo = lo + k * BYTES
        hi = np.minimum(hi, lo + BYTES)
    return lo, hi - lo, owner


def _grams(data: np.ndarray) -> np.ndarray:
    n = max(0, len(data) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = (out << np.uint64(8)) | data[j : j + n]
    return out


def _spaced(text: str) -> np.ndarray:
    return X.LOWER[np.frombuffer((" " + " ".join(text.split()) + " ").encode(), np.uint8)]


@dataclass
class CompressionModel:
    """Two dictionaries, and the weights that turn window differences into a score."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    threshold: int = 2

    def compressors(self):
        import zstandard as Z

        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(Z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def savings(self, pair, data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes by which the toxic dictionary shortens each window."""
        import zstandard as Z

        out = np.zeros(len(lo), np.int64)
        raw = data.tobytes()
        for at in range(0, len(lo), 20_000):
            seg = np.stack([lo[at : at + 20_000], size[at : at + 20_000]], 1).astype("<u8").tobytes()
            buf = Z.BufferWithSegments(raw, seg)
            plain, toxic = (c.multi_compress_to_buffer(buf, threads=0) for c in pair)
            out[at : at + 20_000] = [len(a) - len(b) for a, b in zip(plain, toxic)]
        return out

    def features(self, pair, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: 1, largest saving, windows over the threshold (log), their
        share, mean positive saving, and the length (log)."""
        low = X.LOWER[data]
        lo, size, owner = windows(low, offsets)
        n = len(offsets) - 1
        save = self.savings(pair, low, lo, size) if len(lo) else np.zeros(0, np.int64)
        count = np.bincount(owner, minlength=n).astype(float)
        top = np.zeros(n)
        np.maximum.at(top, owner, save)
        over = np.bincount(owner, save >= self.threshold, n)
        gain = np.bincount(owner, np.maximum(save, 0), n)
        many = np.maximum(count, 1)
        return np.stack(
            [np.ones(n), np.minimum(top, 12) / 4, np.log1p(over), np.minimum(over / many, 1.0), np.minimum(gain / many, 3.0), np.log1p(count) / 5], 1
        )

    def scores(self, pair, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(pair, data, offsets) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams of texts, sorted, and the number of texts with each."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_grams(a)) for a in texts)]), return_counts=True)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), absent)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], absent)


def common_grams(ordinary: list[str], toxic: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ordinary texts' 5-grams, sorted; the number of texts with each; and
    those that cannot set toxic text apart, as their share of the toxic texts
    (one text at least) is below ``RATIO`` times their share of the ordinary ones."""
    grams, n = _counted([_spaced(t) for t in ordinary])
    hits = np.maximum(_look_up(*_counted([_spaced(t) for t in toxic]), grams, 1), 1)
    return grams, n, grams[hits / max(1, len(toxic)) < RATIO * n / max(1, len(ordinary))]


def _cut(a: np.ndarray, new: np.ndarray) -> list[bytes]:
    """The distinct stretches of ``a`` that the marked 5-grams cover."""
    cover = np.zeros(len(a), bool)
    for j in range(GRAM):
        cover[j : j + len(new)] |= new
    edge = np.flatnonzero(np.diff(np.r_[0, cover, 0]))
    b = a.tobytes()
    return list(dict.fromkeys(b[s:e] for s, e in edge.reshape(-1, 2)))


def stretches(text: str, common: np.ndarray, budget: int = 20_000) -> bytes:
    """What may set a whole text apart: its stretches of 5-grams that are not
    ``common``, or an even choice of them that fits ``budget`` bytes."""
    a = _spaced(text)
    parts = _cut(a, _look_up(common, np.ones(len(common), int), _grams(a), 0) == 0)
    size = sum(map(len, parts)) + len(parts)
    return b"\n".join(parts[:: -(-size // budget)] if size > budget else parts)[:budget]


def distinctive(parts: list[bytes], grams: np.ndarray, n: np.ndarray, ordinary: int, sure: float) -> list[bytes]:
    """Of every toxic text's ``stretches``, what is surely more frequent in toxic
    text: 5-grams whose rates differ by ``RATIO`` and by ``sure`` standard errors
    (of square roots of counts)."""
    texts = [np.frombuffer(x, np.uint8) for x in parts]
    bad, m = _counted(texts)
    o = _look_up(grams, n, bad, 0)
    share = len(parts) / max(1, ordinary)
    more = (m >= RATIO * share * o) & (2 * (np.sqrt(m + 0.375) - np.sqrt(share * (o + 0.375))) >= sure)
    for j in range(GRAM):  # not across the ends of stretches
        more &= (bad >> np.uint64(8 * j)) & np.uint64(255) != 10
    return [b"\n".join(_cut(a, _look_up(bad, more, _grams(a), 0) > 0)) for a in texts]


def ordinary_dictionary(ordinary: list[str]) -> bytes:
    """Trained on windows of ordinary text."""
    import zstandard as Z

    data, offsets = X.text_bytes(pa.array(ordinary, pa.large_string()))
    low = X.LOWER[data]
    lo, size, _ = windows(low, offsets)
    raw = low.tobytes()
    plain = [raw[s : s + k] for s, k in zip(lo.tolist(), size.tolist())]
    return _train(Z, DICTIONARY, plain[:: max(1, len(plain) // 80_000)], 24, 6)


def toxic_dictionary(apart: list[bytes]) -> bytes:
    """Of what sets toxic text apart (``distinctive``): all of it where that
    fits the size of the ordinary dictionary, the more frequent the nearer to
    its end. Toxic text is mostly ordinary prose; when a window is compressed,
    the toxic side has both dictionaries and the ordinary side only its own, at
    the same distances, so a window without toxic content comes out alike."""
    import zstandard as Z

    counts = Counter(s for x in apart for s in x.split(b"\n") if len(s) >= GRAM)
    whole = b" ".join(sorted(counts, key=lambda s: (counts[s], s)))
    return _train(Z, DICTIONARY, [x for x in apart if len(x) >= 8], 16, 8) if len(whole) > DICTIONARY else whole or b" " * 8


def _train(zstd, size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A trained dictionary's content; of too few samples, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstd.ZstdError:
        return b" ".join(samples)[:size] or b" " * 8


def _excerpt(longest: int) -> Column:
    """A text, or of a longer one ``longest`` characters from places spread over it."""
    n, piece = F.length("text"), longest // PLACES
    places = F.transform(
        F.sequence(F.lit(0), F.lit(PLACES - 1)),
        lambda i: F.substring(F.col("text"), (F.floor(i * (n - piece) / (PLACES - 1)) + 1).cast("int"), F.lit(piece)),
    )
    return F.when(n <= longest, F.col("text")).otherwise(F.array_join(places, " "))


def _stretches(common: np.ndarray, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [stretches(t, common, budget) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["code", "part"])

    return run


def _features(models: list[CompressionModel]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [m.compressors() for m in models]
        for whole in batches:
            for b in X.text_slices(whole, "text", 2 << 20):
                x = np.concatenate([m.features(p, *X.text_bytes(b.column(1))) for m, p in zip(models, pairs)], 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), b.column(2)], names=["code", "x", "toxic"])

    return run


def train(labelled: DataFrame, per_label: int = 4000, longest: int = 20_000, seed: int = 3) -> CompressionModel | None:
    """Fit on rows of (doc_id, text, toxic).

    The sample is bounded: about ``per_label`` texts of each label, picked by a
    hash of id and text. Three quarters train the dictionaries, the rest
    calibrates the weights on texts that trained neither. Tasks read whole
    texts; the driver gets at most ``longest`` characters of a training text,
    from places spread over it, as much of what sets a toxic one apart, and six
    numbers of a text that calibrates for each model tried. None if a label has no text.
    """
    prepare(labelled.sparkSession)
    known = labelled.where("toxic in (0, 1) and text is not null").select("doc_id", "text", "toxic")
    counts = known.groupBy("toxic").count().select("toxic", (F.lit(float(per_label)) / F.col("count")).alias("rate"))
    scratch = Scratch(labelled.sparkSession, "toxicity")
    rows = scratch.keep(
        known.join(F.broadcast(counts), "toxic").withColumn("code", F.xxhash64("doc_id", "text", F.lit(seed)))
        .where(F.pmod("code", F.lit(1 << 30)).cast("double") / float(1 << 30) < F.col("rate"))
        .select("code", "text", "toxic")
    )
    codes = {k: [] for k in (0, 1)}
    for r in rows.select("code", "toxic").orderBy("code").collect():
        codes[r["toxic"]].append(r["code"])
    if not codes[0] or not codes[1]:
        return None
    last = {k: c[-(-3 * len(c) // 4) - 1] for k, c in codes.items()}
    teaches = F.col("code") <= F.when(F.col("toxic") == 1, F.lit(last[1])).otherwise(F.lit(last[0]))
    texts = rows.where(teaches).select("code", "toxic", _excerpt(longest).alias("text")).orderBy("code", "text").collect()
    toxic, ordinary = ([r["text"] for r in texts if r["toxic"] == k] for k in (1, 0))
    grams, n, common = common_grams(ordinary, toxic)
    apart = rows.where(teaches & (F.col("toxic") == 1)).select("code", "text").mapInArrow(_stretches(common, longest), "code long, part binary")
    parts = [bytes(r["part"]) for r in apart.orderBy("code", "part").collect()]
    plain = ordinary_dictionary(ordinary)
    weights = np.array([-4.0, 2.0, 1.0, 0.0, 0.0, 0.0])
    models = [CompressionModel(plain, toxic_dictionary(distinctive(parts, grams, n, len(ordinary), s)), weights) for s in SURE]
    checks = rows.where(~teaches).mapInArrow(_features(models), "code long, x array<double>, toxic int").orderBy("code", "toxic").collect()
    y = np.array([r["toxic"] for r in checks], float)
    if not len(y) or y.min() == y.max():
        return models[-1]
    x = np.array([r["x"] for r in checks]).reshape(len(y), len(models), -1)
    losses = []
    for k, model in enumerate(models):
        model.weights = _logistic(x[:, k], y)
        z = np.clip(x[:, k] @ model.weights, -30, 30)
        losses.append(float(np.mean(np.logaddexp(0, z) - y * z)))
    return models[int(np.argmin(losses))]


def _scorer(model: CompressionModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model is not None else None
        for whole in batches:
            for b in X.text_slices(whole, "text", 2 << 20):
                score = np.zeros(b.num_rows) if model is None else model.scores(pair, *X.text_bytes(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 3) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **options) -> DataFrame:
    """Score every text for toxicity.

    Learns from labelled documents whose crc32(id) mod 3 is not 1 and returns
    a row per document row: ``doc_id, held_out, score, predicted`` (1 from
    ``cut`` on). A null text counts as empty and has a score like any other;
    rows without an id are scored but never learned from; several labels of a
    document count as several examples; labels other than 0 and 1 are ignored.
    Without examples of both labels every score is 0. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    usable = marks.where(crc_mod("doc_id", 3) != 1)
    options_known = {"per_label": options.get("per_label", 4000), "seed": options.get("seed", 3)}
    drawn = _draw(usable, **options_known)
    model = train(src.join(F.broadcast(drawn), "doc_id"), **options)
    return (
        src.mapInArrow(_scorer(model), "doc_id long, score double")
        .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
    )


def _draw(marks: DataFrame, per_label: int, seed: int) -> DataFrame:
    """About ``2 * per_label`` ids of each label (a bounded table), by a hash of the id."""
    counts = marks.groupBy("toxic").count().select("toxic", (F.lit(2.0 * per_label) / F.col("count")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return marks.join(F.broadcast(counts), "toxic").where(draw < F.col("rate")).select("doc_id", "toxic")
