"""Language identification with a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import prepare, crc_mod

#: Windows that run through the network side by side.
LANES = 4096


class ByteBiGRU:
    """Two gated recurrent layers, one per direction, over byte windows, and a
    softmax at every position. All arrays are float32."""

    def __init__(self, params: dict[str, np.ndarray], labels: list[str]):
        self.p, self.labels = params, labels

    @staticmethod
    def fresh(hidden: int, labels: list[str], seed: int) -> ByteBiGRU:
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        params = {}
        for side in "fb":
            params[f"w{side}"] = normal(256, 3 * hidden, scale=0.3)
            params[f"u{side}"] = normal(hidden, 3 * hidden, scale=hidden**-0.5)
            params[f"o{side}"] = normal(hidden, len(labels), scale=hidden**-0.5)
        params["bias"] = np.zeros(len(labels), np.float32)
        return ByteBiGRU(params, labels)

    # ------------------------------------------------------------- training

    def _layer(self, side: str, x: np.ndarray) -> dict[str, list[np.ndarray]]:
        """Forward pass over x (time, lanes), keeping what the gradient needs."""
        w, u = self.p[f"w{side}"], self.p[f"u{side}"]
        n = u.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        keep: dict[str, list[np.ndarray]] = {k: [] for k in ("h", "z", "r", "c", "m")}
        for t in range(x.shape[0]):
            g, m = w[x[t]], h @ u
            z = 1 / (1 + np.exp(-(g[:, :n] + m[:, :n])))
            r = 1 / (1 + np.exp(-(g[:, n : 2 * n] + m[:, n : 2 * n])))
            c = np.tanh(g[:, 2 * n :] + r * m[:, 2 * n :])
            for k, v in zip(("h", "z", "r", "c", "m"), (h, z, r, c, m[:, 2 * n :])):
                keep[k].append(v)
            h = c + z * (h - c)
        keep["h"].append(h)
        return keep

    def _back(self, side: str, x: np.ndarray, keep: dict, dh_out: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of one layer; dh_out is (time, lanes, hidden)."""
        u = self.p[f"u{side}"]
        n = u.shape[0]
        dw, du = np.zeros_like(self.p[f"w{side}"]), np.zeros_like(u)
        dh = np.zeros_like(dh_out[0])
        for t in range(x.shape[0] - 1, -1, -1):
            h, z, r, c, m = (keep[k][t] for k in ("h", "z", "r", "c", "m"))
            dh = dh + dh_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            gate = np.concatenate([dz, dr, dc], axis=1)
            np.add.at(dw, x[t], gate)
            rec = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ rec
            dh = dh * z + rec @ u.T
        grad[f"w{side}"], grad[f"u{side}"] = dw, du

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of windows x (time, lanes)
        whose lanes carry labels y, and its gradient."""
        back = x[::-1]
        kf, kb = self._layer("f", x), self._layer("b", back)
        hf, hb = np.stack(kf["h"][1:]), np.stack(kb["h"][1:])[::-1]
        logits = hf @ self.p["of"] + hb @ self.p["ob"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        lanes = np.arange(len(y))
        loss = float(-np.log(prob[:, lanes, y] + 1e-9).mean())
        d = prob.copy()
        d[:, lanes, y] -= 1
        d /= d.shape[0] * d.shape[1]
        grad = {"bias": d.sum(axis=(0, 1))}
        grad["of"] = np.tensordot(hf, d, ((0, 1), (0, 1)))
        grad["ob"] = np.tensordot(hb, d, ((0, 1), (0, 1)))
        self._back("f", x, kf, d @ self.p["of"].T, grad)
        self._back("b", back, kb, (d @ self.p["ob"].T)[::-1], grad)
        return loss, grad

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int, lanes: int = 256, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over random minibatches of windows (rows of bytes). Returns the last loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = float("nan")
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), lanes)
            loss, grad = self.gradient(windows[pick].T, y[pick])
            scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grad.values())) + 1e-6))
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * scale
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                fix = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                self.p[k] -= (lr * (first[k] / (1 - 0.9**step)) / fix).astype(np.float32)
        return loss

    # ------------------------------------------------------------ inference

    def _run(self, side: str, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Logits of one direction over x (time, lanes); lanes are ordered by
        length, ``live[t]`` of them reach step t."""
        u = self.p[f"u{side}"].copy()
        w = self.p[f"w{side}"].copy()
        n = u.shape[0]
        u[:, : 2 * n] *= 0.5  # sigmoid(a) = 0.5 + 0.5 tanh(a / 2)
        w[:, : 2 * n] *= 0.5
        out_w = self.p[f"o{side}"]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.zeros((*x.shape, out_w.shape[1]), np.float32)
        for t in range(x.shape[0]):
            k = live[t]
            hk = h[:k]
            g, m = w.take(x[t, :k], axis=0), hk @ u
            gate = np.tanh(g[:, : 2 * n] + m[:, : 2 * n])
            gate *= 0.5
            gate += 0.5
            c = gate[:, n:] * m[:, 2 * n :]
            c += g[:, 2 * n :]
            np.tanh(c, out=c)
            hk -= c
            hk *= gate[:, :n]
            hk += c
            np.matmul(hk, out_w, out=out[t, :k])
        return out

    def document_scores(self, data: np.ndarray, offsets: np.ndarray, window: int = 128) -> np.ndarray:
        """Per text, the mean over all its bytes of the label probabilities.

        A text is dealt into windows of at most ``window`` bytes, each of which
        runs through both layers from a zero state; every byte is labelled.
        """
        n, labels = len(offsets) - 1, len(self.labels)
        size = np.diff(offsets)
        count = -(-size // window)
        owner = np.repeat(np.arange(n), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[owner] + nth * size[owner] // np.maximum(count[owner], 1)
        end = offsets[owner] + (nth + 1) * size[owner] // np.maximum(count[owner], 1)
        total = np.zeros((n, labels))
        order = np.argsort(begin - end, kind="stable")
        for at in range(0, len(order), LANES):
            pick = order[at : at + LANES]
            length = end[pick] - begin[pick]
            steps = np.arange(length[0])
            live = np.searchsorted(-length, -steps, side="left")
            ahead = np.minimum(begin[pick] + steps[:, None], len(data) - 1)
            aback = np.maximum(end[pick] - 1 - steps[:, None], 0)
            logits = self._run("f", data[ahead], live)
            behind = self._run("b", data[aback], live)
            mirror = np.clip(length - 1 - steps[:, None], 0, None)
            logits += behind[mirror, np.arange(len(pick))]
            logits += self.p["bias"]
            logits -= logits.max(axis=2, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(axis=2, keepdims=True)
            logits *= (steps[:, None] < length)[:, :, None]
            np.add.at(total, owner[pick], logits.sum(axis=0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def train(
    labelled: DataFrame, per_label: int = 400, excerpt: int = 384, window: int = 64, hidden: int = 10,
    steps: int = 500, seed: int = 5, most_labels: int = 256,
) -> ByteBiGRU | None:
    """Fit a network on rows of (doc_id, text, lang).

    The sample is bounded: at most ``per_label`` different texts of each of the
    ``most_labels`` most frequent labels, picked by a hash of the text (copies
    of a text teach once, however many there are), and of each an excerpt of
    ``excerpt`` characters from a place picked likewise, cut into windows of
    ``window`` bytes. None if there is no labelled text.
    """
    known = labelled.where("lang is not null and text is not null and text rlike '\\\\p{L}'").withColumn("code", F.xxhash64("text", F.lit(seed)))
    # twice the rate that the estimated number of different texts asks for, then exactly the first of them
    counts = (
        known.groupBy("lang").agg(F.approx_count_distinct("code").alias("texts"), F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "lang").limit(most_labels)
        .withColumn("rate", F.lit(2.0 * per_label) / F.col("texts"))
    )
    draw = F.pmod("code", F.lit(1 << 30)).cast("double") / float(1 << 30)
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    part = F.substring("text", (F.pmod(F.xxhash64("text", F.lit(seed + 1)), room) + 1).cast("int"), F.lit(excerpt))
    drawn = (
        known.join(F.broadcast(counts.select("lang", "rate")), "lang").where(draw < F.col("rate"))
        .groupBy("lang", "code").agg(F.min(part).alias("part"))
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("code"))
    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= per_label).select("lang", "part").orderBy("lang", "part").collect()
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    windows, y = [], []
    for r in sample:
        raw = np.frombuffer(r["part"].encode(), np.uint8)
        raw = np.resize(raw, max(window, len(raw)))  # short texts are repeated
        for at in range(0, len(raw) - window + 1, window):
            windows.append(raw[at : at + window])
            y.append(labels.index(r["lang"]))
    net = ByteBiGRU.fresh(hidden, labels, seed)
    net.fit(np.stack(windows), np.array(y), steps, seed=seed)
    return net


def _score(net: ByteBiGRU | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in X.text_slices(whole, column, 4 << 20):
                at = b.schema.get_field_index(column)
                letters = np.asarray(b.column(b.schema.get_field_index("_letters")).fill_null(False))
                pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if net is not None:
                    prob = net.document_scores(*X.text_bytes(b.column(at)))
                    best = prob.argmax(axis=1)
                    score = np.where(letters, np.clip(prob[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                    pred = [net.labels[k] if ok else "und" for k, ok in zip(best, letters)]
                keep = [i for i, name in enumerate(b.schema.names) if name != "_letters"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                    names=[*(b.schema.names[i] for i in keep), "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, net: ByteBiGRU | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole of each text.

    ``und`` with score 0 if the text is null or has no letter, or if there was
    nothing to learn from. ``docs`` must not have columns of these names.
    """
    prepare(docs.sparkSession)
    src = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return src.mapInArrow(_score(net, "text"), f"{fields}, lang_pred string, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(column, 4) == 2, F.lit(False))


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Predict each document's language from its text alone.

    Learns from documents with a text and a language whose
    crc32(id) mod 4 is not 2 (never from rows without an id) and returns a row
    per input row: ``doc_id, held_out, lang_pred, score``. Repeated rows are
    predicted alike; an empty table gives an empty result.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = train(src.where(crc_mod("doc_id", 4) != 2), **options)
    return identify(src.select("doc_id", held_out().alias("held_out"), "text"), net).drop("text")


def identified_documents(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """Documents, with their columns, whose language is identified with a
    probability of at least ``least``; ``und`` is rejected."""
    src = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = train(src.where(crc_mod("doc_id", 4) != 2), **options)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    kept = identify(packed, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
