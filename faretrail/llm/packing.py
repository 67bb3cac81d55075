"""Best-fit packing of token sequences by a configuration linear program."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faretrail.llm import textops as X
from faretrail.llm.common import Scratch, prepare

#: Patterns that one round of multiplicative weights may price.
ITERATIONS = 300
#: Items left over from the rounds that are packed largest first.
TAIL = 20_000
#: A round that places less than this share of the items is the last one.
WORTH = 0.03
#: Texts made of these characters only are split into words alike by both
#: tokenizer libraries (tested for each of them); others go the slow way.
_PLAIN = "\t\n\r" + "".join(map(chr, range(32, 127))) + "".join(map(chr, range(0xA1, 0x250)))
_LONG_RUN = 512


# ---------------------------------------------------------------- tokenizing

def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: each printable
    Latin-1 byte stands for itself, the others for U+0100 and up in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Ids of a byte-level BPE file.

    The file's own library defines the ids. Words of plain texts are encoded
    by a faster library from the same file's vocabulary (an id is also its
    merge rank); texts with other characters, with the spelling of a special
    token, or with very long runs take the defining library.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        back = _byte_alphabet()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._drop = dict.fromkeys(map(ord, _PLAIN))

    def _is_plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        return text.isascii() and text.isprintable() or not text.translate(self._drop)

    def encode(self, texts: list[str], long_run: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for text, run in zip(texts, long_run):
            if not text:
                out.append(np.zeros(0, np.uint32))
            elif run <= _LONG_RUN and self._is_plain(text):
                out.append(np.array(self.fast.encode_ordinary(text), dtype=np.uint32))
            else:
                out.append(np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
        return out


def _longest_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the longest stretch of only separators or of none."""
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    if not len(data):
        return out
    sep = X.SEPARATOR[data]
    cut = np.zeros(len(data), bool)
    cut[0] = True
    cut[1:] = sep[1:] != sep[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut[inner] = True
    at = np.flatnonzero(cut)
    np.maximum.at(out, np.searchsorted(offsets, at, side="right") - 1, np.diff(np.r_[at, len(data)]))
    return out


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ByteTokenizer(path)
        for whole in batches:
            for b in X.text_slices(whole, "text", 4 << 20):
                runs = _longest_runs(*X.text_bytes(b.column(1)))
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, seq in zip(b.column(0).to_pylist(), tok.encode([t or "" for t in b.column(1).to_pylist()], runs)):
                    seq = np.append(seq, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(seq) % capacity or capacity, len(seq) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        doc.append(d)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(seq[s:e].tobytes()))
                        if with_ids:
                            ids.append(seq[s:e].tolist())
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``capacity`` where it
    is longer; only its first piece may be shorter. A null text is empty."""
    prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)


# ------------------------------------------------------------- configurations

def best_configuration(price: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: item counts per length that
    fit ``capacity`` at the highest total price (absent lengths cost -inf)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1][:room]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], took[room] = value[k], k + 1
        else:
            best[room] = best[room - 1]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    room = capacity
    while room > 0:
        if took[room]:
            counts[took[room]] += 1
            room -= took[room]
        else:
            room -= 1
    return counts


def fractional_cover(left: np.ndarray, capacity: int, iterations: int, step: float, rate: float) -> list[tuple[np.ndarray, float]]:
    """Configurations and amounts that cover each length's count to a like
    share, never beyond it.

    Multiplicative weights: a length's price starts in proportion to its size
    (the dual of a perfect packing) and falls by exp(-rate * share covered);
    the knapsack prices the best configuration, which is used until its
    scarcest length has gained ``step`` of its count.
    """
    live = np.flatnonzero(left)
    size = np.arange(capacity + 1) / capacity
    share = np.zeros(capacity + 1)
    out: list[tuple[np.ndarray, float]] = []
    for _ in range(iterations):
        price = np.full(capacity + 1, -np.inf)
        price[live] = size[live] * np.exp(-rate * share[live])
        counts = best_configuration(price, capacity)
        used = np.flatnonzero(counts)
        amount = float((left[used] / counts[used]).min()) * step
        share[used] += counts[used] * amount / left[used]
        out.append((counts, amount))
    top = share.max()
    return [(c, a / top) for c, a in out]


def _fill(counts: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """``counts`` as far as they last, with the largest lengths that still fit."""
    counts = np.minimum(counts, left)
    room = capacity - int(counts @ np.arange(capacity + 1))
    for length in np.flatnonzero(left[: room + 1] > counts[: room + 1])[::-1]:
        k = min(room // length, left[length] - counts[length])
        counts[length] += k
        room -= k * length
        if not room:
            break
    return counts


def plan_configurations(
    histogram: dict[int, int], capacity: int, tail: int = TAIL
) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(lengths of a sequence's pieces, number of such sequences), using up the
    histogram exactly, and the share of its items that configurations of the
    program placed. Work and size depend on ``capacity``, not on the counts.

    A round solves the fractional program over all that is left and uses every
    configuration the whole part of its amount. What a round leaves is solved
    again. In the last round, over at most ``tail`` items (the only one of a
    small histogram), configurations are also used once more by falling
    fraction while the fractions last, where their items have become scarce
    filled up with the largest that fit. The rest, and what a round that
    places less than ``WORTH`` leaves, is packed largest first.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    items = max(1, int(left.sum()))
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(counts: np.ndarray, n: int) -> None:
        left[:] -= counts * n
        lengths = tuple(int(x) for x in np.repeat(np.arange(capacity + 1), counts)[::-1])
        plan.append((lengths, int(n)))

    if left[capacity]:
        whole = np.zeros(capacity + 1, dtype=np.int64)
        whole[capacity] = 1
        use(whole, left[capacity])
    last = False
    while left.any() and not last:
        before = left.sum()
        last = before <= tail
        iterations = min(ITERATIONS, 20 + 2 * int(np.count_nonzero(left)))
        amounts: dict[bytes, tuple[np.ndarray, float]] = {}
        for counts, amount in fractional_cover(left, capacity, iterations, 0.25, 4.0):
            key = counts.tobytes()
            amounts[key] = (counts, amount + (amounts[key][1] if key in amounts else 0.0))
        for counts, amount in amounts.values():
            used = np.flatnonzero(counts)
            n = min(int(amount), int((left[used] // counts[used]).min()))
            if n:
                use(counts, n)
        if not last and left.sum() > (1 - WORTH) * before:
            break
        if last:
            once = sorted((a - int(a), k) for k, (_, a) in amounts.items())[::-1]
            for fraction, key in once[: round(sum(f for f, _ in once))]:
                if left.any():
                    use(_fill(amounts[key][0], left, capacity), 1)
    share = 1 - int(left.sum()) / items
    while left.any():
        counts = _fill(np.zeros(capacity + 1, dtype=np.int64), left, capacity)
        used = np.flatnonzero(counts)
        use(counts, int((left[used] // counts[used]).min()))
    return plan, share


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """Rows (length, first rank, last rank + 1, per sequence, first sequence, offsets)."""
    rows, taken, base = [], {}, 0
    for lengths, n in plan:
        places: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            places.setdefault(length, []).append(at)
            at += length
        for length, offsets in places.items():
            lo = taken.get(length, 0)
            taken[length] = lo + n * len(offsets)
            rows.append((length, lo, taken[length], len(offsets), base, offsets))
        base += n
    return rows


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Number the pieces of each length from 0. A length is dealt to ``salts``
    windows, whose first numbers follow from their counts."""
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(own) - 1).join(first, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("first")).drop("first", "salt")
    )


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 2048, salts: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table).

    Only the histogram of lengths, at most ``capacity`` rows, reaches the
    driver. The configurations become rank intervals per length, a table whose
    size is bounded by the solver's rounds, which is joined to the pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = _slots(plan_configurations(histogram, capacity)[0])
    slots = spark.createDataFrame(rows, "length long, lo long, hi long, per long, base long, places array<long>")
    at = F.col("rank") - F.col("lo")
    return (
        ranked(pieces, salts).join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("base") + F.floor(at / F.col("per")).cast("long"))
        .withColumn("offset", F.col("places")[F.pmod(at, F.col("per")).cast("int")])
        .drop("rank", "lo", "hi", "per", "base", "places")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack documents into as few sequences of ``capacity`` ids as it can.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids``). Pieces of a sequence lie one after
    another from offset 0.

    A null or empty text is its ``end_id`` alone; a null id is kept as null;
    repeated rows are packed as documents of their own; equal lengths are told
    apart by rank. Other columns are not read; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep(token_pieces(docs, tokenizer, capacity, end_id, with_ids)), scratch, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences (of a result ``with_ids``), one row each; a
    group holds at most ``capacity`` ids."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
